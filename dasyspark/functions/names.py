"""Name folding and text normalisation as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


HANGUL = ("\uac00", "\ud7a3")  # syllables, composed by arithmetic
_LEADS, _VOWELS, _TAILS, _PER_LEAD, _PER_VOWEL = 0x1100, 0x1161, 0x11A7, 588, 28


@lru_cache(maxsize=1)
def _decomposition() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition of every assigned character, derived by rule from the character database.

    Characters that become one character (combining marks dropped) make a translate table,
    whose tail without counterpart is deleted; those that become several are returned apart.
    """
    source, target, deleted, wide = [], [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        char = chr(point)
        if HANGUL[0] <= char <= HANGUL[1] or unicodedata.category(char) in ("Cn", "Cs", "Co"):
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base == char:
            continue
        if len(base) == 1:
            source.append(char)
            target.append(base)
        elif base:
            wide[char] = base
        else:
            deleted.append(char)
    return "".join(source + deleted), "".join(target), wide


def _ranges(chars: Iterable[str]) -> str:
    """The body of a character class of these characters."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:x}}}" + (rf"-\x{{{b:x}}}" if b > a else "") for a, b in out)


def _jamo(offset: Column, base: int) -> Column:
    """The character ``offset`` places after ``base``."""
    return F.decode(F.unhex(F.lpad(F.hex(offset + base), 4, "0")), "UTF-16BE")


def _syllable(char: Column) -> Column:
    """Lead, vowel and tail of a Hangul syllable."""
    place = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int") - ord(HANGUL[0])
    tail = place % _PER_VOWEL
    vowel = F.floor(place % _PER_LEAD / _PER_VOWEL).cast("int")
    return F.concat(
        _jamo(F.floor(place / _PER_LEAD).cast("int"), _LEADS), _jamo(vowel, _VOWELS),
        F.when(tail == 0, "").otherwise(_jamo(tail, _TAILS)),
    )


def strip_marks(col: Column) -> Column:
    """Compatibility-decompose (NFKD) and drop combining marks, for all scripts.

    Most texts are told by two quick looks: one without anything beyond ASCII stays as it
    is, and one without a character that expands to several goes to one translate table.
    Only in the others are those characters replaced, all in one pass, Hangul by arithmetic.
    """
    source, target, wide = _decomposition()
    table = F.create_map(*[F.lit(x) for pair in wide.items() for x in pair])
    group = _ranges(wide) + f"{HANGUL[0]}-{HANGUL[1]}"
    early = _ranges(c for c in wide if c < "\u0180")
    runs = F.regexp_extract_all(col, F.lit(f"[{group}]|[^{group}]+"), F.lit(0))
    spelt = F.transform(
        runs,
        lambda r: F.when(r.between(*HANGUL) & (F.length(r) == 1), _syllable(r)).otherwise(F.coalesce(F.try_element_at(table, r), r)),
    )
    open_ = F.when(col.rlike(rf"[{early}\x{{180}}-\x{{10FFFF}}]") & col.rlike(f"[{group}]"), F.array_join(spelt, "")).otherwise(col)
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(open_, source, target)).otherwise(col)


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def fold_name(col: Column) -> Column:
    return F.lower(collapse_spaces(strip_marks(col)))


def clean_ws(col: Column) -> Column:
    return collapse_spaces(F.coalesce(col, F.lit("")))


def title_case(col: Column) -> Column:
    """Capitalise every run of letters, so also after hyphens, quotes and digits."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), ""
    )


def alias_key(col: Column) -> Column:
    """Folded name without footnote markers: the key of the alias table."""
    return collapse_spaces(F.regexp_replace(fold_name(col), r"[#$*+]+", ""))


def norm_unit_name(df: DataFrame, name: str, aliases: DataFrame, out: str = "unit", code: str = "code") -> DataFrame:
    """Canonical unit name: alias hit within the territory ``code``, else title case.

    ``aliases`` has unique (``code``, ``alias``) and ``canonical``, those of a single
    territory no ``code``; its size on disk or in memory decides whether Spark
    broadcasts it.
    """
    keyed = df.withColumn("_alias", alias_key(F.col(name)))
    codes = [code] if "code" in aliases.columns else []
    hits = aliases.select(*[F.col("code").alias(c) for c in codes], F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    return (
        keyed.join(hits, [*codes, "_alias"], "left")
        .withColumn(out, F.coalesce("_canonical", title_case(F.col("_alias"))))
        .drop("_alias", "_canonical")
    )


def slug(col: Column) -> Column:
    dashed = F.regexp_replace(strip_marks(col), "[^A-Za-z0-9]+", "-")
    bare = F.lower(F.regexp_replace(dashed, "^-+|-+$", ""))
    return F.when(bare.isNull() | (bare == ""), F.lit("unknown")).otherwise(bare)


def source_line(year: Column, basis: Column, base_year: Column) -> Column:
    """Readable ``FY y, basis prices (base b)``; missing pieces are skipped."""

    def given(c: Column) -> Column:
        return F.when(c != "", c)

    prices = F.concat(
        given(basis),
        F.lit(" prices"),
        F.coalesce(F.concat(F.lit(" (base "), given(base_year), F.lit(")")), F.lit("")),
    )
    return F.concat_ws(", ", F.concat(F.lit("FY "), given(year)), prices)
