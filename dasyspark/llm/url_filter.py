"""URL filter: host rules first, then exact membership in a Bloom filter cascade.

The cascade encodes which keys of a closed universe are listed. Level 1 is a
Bloom filter of the listed keys; level 2 holds the unlisted keys of the universe
that level 1 lets through; level 3 the listed keys that level 2 lets through; and
so on until nothing passes wrongly. A key of the universe is listed exactly if
the first level that refuses it is an even one. Filters of a few bits per key
stand in for a join with the list.

The universe is cut into shards by hash, so that each cascade is built in one
task from a bounded number of keys, and shards can be shipped apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasyspark.llm.common import small
from dasyspark.session import materialize

KEYS_PER_SHARD = 200_000
SEEDS = (0x51, 0xA7)


# ---------------------------------------------------------------- url parts


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    return F.coalesce(
        F.translate(
            F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1),
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz",
        ),
        F.lit(""),
    )


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` from (verdict, host, path) rules; needs ``host`` and ``path``.

    A rule fits its host and every subdomain when the path starts with its path.
    The longest fitting rule wins, of equally long ones the first in text order.
    Rules are literals of the plan, meant for a policy of tens of lines.
    """
    rule = verdict = None
    for decision, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return df.withColumn("rule", none if rule is None else rule).withColumn(
        "rule_verdict", none if verdict is None else verdict
    )


# ------------------------------------------------------------------ cascade


def _hashes(keys) -> tuple[np.ndarray, np.ndarray]:
    raw = [k.encode() for k in keys]
    return tuple(np.array([xxhash.xxh3_64_intdigest(k, seed) for k in raw], dtype=np.uint64) for seed in SEEDS)


class Bloom:
    """Bits and hash count for one level; the level number salts the hashes."""

    def __init__(self, level: int, bits: np.ndarray, probes: int):
        self.level, self.bits, self.probes = level, bits, probes

    @classmethod
    def of(cls, level: int, h1: np.ndarray, h2: np.ndarray, rate: float) -> Bloom:
        size = max(64, int(np.ceil(-len(h1) * np.log(rate) / np.log(2) ** 2)))
        made = cls(level, np.zeros((size + 7) // 8, np.uint8), max(1, round(-np.log2(rate))))
        for i in range(made.probes):
            spot = made._spot(h1, h2, i)
            np.bitwise_or.at(made.bits, spot >> np.uint64(3), (1 << (spot & np.uint64(7))).astype(np.uint8))
        return made

    def _spot(self, h1, h2, i):
        salt = np.uint64(self.level * 0x9E3779B97F4A7C15 % 2**64)
        step = (h2 ^ salt) * np.uint64(2 * i + 1)
        return ((h1 ^ (step + (step >> np.uint64(31)))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)) % np.uint64(
            8 * len(self.bits)
        )

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for i in range(self.probes):
            spot = self._spot(h1, h2, i)
            found &= (self.bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def build_levels(keys, listed: np.ndarray, first_rate: float = 0.05, rate: float = 0.5) -> list[Bloom]:
    """Levels over distinct ``keys``; ends when no key is decided wrongly."""
    h1, h2 = _hashes(keys)
    levels, inside, outside = [], np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        levels.append(Bloom.of(len(levels) + 1, h1[inside], h2[inside], rate if levels else first_rate))
        passed = outside[levels[-1].has(h1[outside], h2[outside])]
        inside, outside = passed, inside
    return levels


def is_listed(levels: list[Bloom], keys) -> np.ndarray:
    """Exact for keys of the universe the levels were built over."""
    h1, h2 = _hashes(keys)
    answer = np.zeros(len(h1), bool)
    alive = np.arange(len(h1))
    for depth, level in enumerate(levels):
        through = level.has(h1[alive], h2[alive])
        # Refused at an odd level: not listed; at an even level: listed.
        answer[alive[~through]] = depth % 2 == 1
        alive = alive[through]
    answer[alive] = len(levels) % 2 == 1
    return answer


LEVELS = "shard int, level int, probes int, bits binary"


def build_cascades(universe: DataFrame, key: str = "key", listed: str = "listed") -> tuple[DataFrame, int]:
    """Cascades of all shards of a table of keys, and the number of shards.

    Repeated keys count once, listed if any of their rows is; null keys are left
    out. The table must hold every key that will ever be asked for.
    """
    keys = materialize(
        universe.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
        .agg(F.max(F.coalesce(F.col(listed), F.lit(False)).cast("int")).alias("listed")),
        "keys",
    )
    shards = max(1, -(-keys.count() // KEYS_PER_SHARD))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = build_levels(pdf["key"], pdf["listed"].to_numpy() == 1)
        return pd.DataFrame({
            "shard": pdf["shard"].iloc[0], "level": [x.level for x in levels], "probes": [x.probes for x in levels],
            "bits": [x.bits.tobytes() for x in levels],
        })

    made = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return materialize(made.groupBy("shard").applyInPandas(build, LEVELS), "cascades"), shards


def _loaded(rows) -> dict[int, list[Bloom]]:
    shards: dict[int, list[Bloom]] = {}
    for shard, level, probes, bits in sorted(rows, key=lambda r: (r[0], r[1])):
        shards.setdefault(shard, []).append(Bloom(level, np.frombuffer(bits, np.uint8), probes))
    return shards


def _decide(pdf: pd.DataFrame, key: str, shards: dict[int, list[Bloom]]) -> pd.DataFrame:
    answer = np.zeros(len(pdf), bool)
    for shard, rows in pdf.groupby("shard").indices.items():
        values = pdf[key].iloc[rows]
        there = values.notna().to_numpy()
        answer[rows[there]] = is_listed(shards.get(shard, []), values[there])
    return pdf.drop(columns=["shard", "salt"], errors="ignore").assign(listed=answer)


def probe(df: DataFrame, cascades: DataFrame, shards: int, key: str = "key", salts: int = 64) -> DataFrame:
    """Add boolean ``listed`` to every row; a null key is not listed.

    The filters go to every task while their measured size stays bounded. Beyond
    that, rows and filters meet by (shard, salt), so that a key with a third of
    all rows is still spread over ``salts`` groups.
    """
    spark = df.sparkSession
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", listed boolean"
    placed = df.withColumn("shard", F.coalesce(F.pmod(F.xxhash64(key), F.lit(shards)), F.lit(0)).cast("int"))
    size = cascades.agg(F.sum(F.length("bits"))).first()[0] or 0
    if size <= 32 << 20 and small(cascades, 64):
        shared = spark.sparkContext.broadcast([tuple(r) for r in cascades.collect()])

        def local(batches):
            known = _loaded(shared.value)
            for pdf in batches:
                yield _decide(pdf, key, known)

        return placed.mapInPandas(local, schema)

    def together(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _decide(left, key, _loaded(right[["shard", "level", "probes", "bits"]].itertuples(index=False)))

    spread = placed.withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    copies = cascades.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(together, schema)


def filter_urls(
    pages: DataFrame, listed: Column, rules: list[tuple[str, str, str]], url: str = "url", key: Column | None = None
) -> DataFrame:
    """Judge every row of ``pages``: adds ``host, path, rule, listed, verdict``.

    ``listed`` says of a row with ``host`` and ``path`` whether its key (host and
    path unless ``key`` is given) belongs to the block list; a key is listed if
    any row says so. Rules go before the list. Null urls have an empty host and
    path; they are judged like the empty key. Columns of the same names as the
    added ones are replaced, and ``shard``, ``salt``, ``rule_verdict`` and ``_key``
    dropped. An empty table stays empty.
    """
    parts = pages.drop("host", "path", "rule", "listed", "verdict", "rule_verdict", "shard", "salt", "_key").withColumns(
        {"host": host_of(F.col(url)), "path": path_of(F.col(url))}
    )
    whole = F.concat("host", "path") if key is None else key
    cascades, shards = build_cascades(parts.select(whole.alias("key"), listed.alias("listed")))
    judged = probe(parts.withColumn("_key", whole), cascades, shards, "_key")
    return with_rules(judged, rules).withColumn(
        "verdict", F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    ).drop("_key", "rule_verdict")
