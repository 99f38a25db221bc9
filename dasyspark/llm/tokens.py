"""Token ids of a public byte-level BPE from its rank file."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import numpy as np


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of a vocabulary in JSON form, which are matched inside texts before all else."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    odd = [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens with rules of their own: {odd}")
    return {t["content"]: t["id"] for t in found}


def byte_bpe(path: str, pattern: str, added: dict[str, int] | None = None) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """A maker of encoders (texts to id arrays) from a file of ranks and the splitting pattern.

    Ranks and the JSON form of the same vocabulary give the same ids; this form is
    several times faster. ``added`` are tokens that are matched whole, with their ids;
    other strings of special tokens count as ordinary text.
    """

    def make():
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        known = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
        return lambda texts: [np.asarray(known.encode_to_numpy(t, allowed_special="all"), np.uint32) for t in texts]

    return make
