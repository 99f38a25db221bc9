"""Resolution and ancestors of hierarchical hexagon ids given as hex text.

Such an id is a 64-bit number: bits 52-55 hold the resolution and below them
sit fifteen 3-bit digits, coarse to fine, unused digits being all ones. Written
as fifteen hex digits, the resolution is the second one, and an ancestor only
changes that digit and the tail, so plain text functions do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = "0123456789abcdef"


def cell_resolution(h3: Column) -> Column:
    return F.instr(F.lit(HEX), F.lower(F.substring(h3, 2, 1))) - 1


def cell_parent(h3: Column, resolution: int) -> Column:
    """Ancestor at a coarser resolution: set its digit, blank the finer digits."""
    whole, rest = divmod(3 * (15 - resolution), 4)
    mixed = "".join(HEX[int(d, 16) | ((1 << rest) - 1)] for d in HEX)
    keep = 15 - 2 - whole - 1
    text = F.lower(h3)
    return F.concat(
        F.substring(text, 1, 1), F.lit(HEX[resolution]), F.substring(text, 3, keep),
        F.translate(F.substring(text, 3 + keep, 1), HEX, mixed), F.lit("f" * whole),
    )
