"""Fitting a non-negative per-capita intensity per territory, from unit totals alone.

``s = scale * softplus(w.x + b)`` with weights of its own for every (territory, seed).
The cells come as a design matrix (``graph.design_matrix``) that lies range-partitioned
by territory and unit. An epoch is one Spark job for all territories and seeds: tasks sum
``s * pop`` and its gradient per unit, the sums of a unit meet and turn into residuals,
and the gradient of every (territory, seed) is summed up. The floor term needs no unit;
its sums, one row per task, territory and seed, are spread over the residual tasks.
Weights and optimiser state are a table keyed by (territory, seed); where it outgrows a
broadcast, territories are fitted in several groups, as their fits do not depend on each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.functions.numbers import softplus
from dasyspark.operators.allocate import log_loss
from dasyspark.operators.joins import UNIT_KEY, unit_key
from dasyspark.session import BROADCAST_BYTES, TEXT_BYTES

FLUSH_UNITS = 2_000
START = math.log(math.e - 1)  # softplus is 1 here, so the first sums have the right size


@dataclass
class Fit:
    """Best weights (bias last), output scale and loss history per territory and seed."""

    width: int
    weights: dict[tuple, np.ndarray]
    scale: dict[object, float]
    history: list[tuple] = field(default_factory=list)
    state_type: str = "string"

    def table(self, like: DataFrame) -> DataFrame:
        """The weight table: ``state, seed, scale, weights``."""
        rows = [(state, seed, self.scale[state], w.tolist()) for (state, seed), w in self.weights.items()]
        return like.sparkSession.createDataFrame(rows, f"state {self.state_type}, seed int, scale double, weights array<double>")

    def of_seed(self, seed: int) -> Fit:
        kept = {key: w for key, w in self.weights.items() if key[1] == seed}
        return Fit(self.width, kept, self.scale, [h for h in self.history if h[2] == seed], self.state_type)

    def history_table(self, like: DataFrame) -> DataFrame:
        kind = f"tag string, state {self.state_type}, seed int, epoch int, loss double, l_agg double, l_floor double"
        return like.sparkSession.createDataFrame(self.history, kind)

    def runs(self, design: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep, seed, intensity_raw``: one row per cell and seed, from a single pass over the cells."""
        of_state = self.table(design).groupBy("state").agg(F.collect_list(F.struct("seed", "scale", "weights")).alias("_w"))
        small = len(self.weights) * (8 * self.width + 64) <= BROADCAST_BYTES
        rows = design if "state" in design.columns else design.withColumn("state", F.lit(None).cast(self.state_type))
        on = rows["state"].eqNullSafe(of_state["state"])
        met = rows.join(F.broadcast(of_state) if small else of_state, on).drop(of_state["state"])

        def intensity(run: Column) -> Column:
            terms = F.zip_with("x", run["weights"], lambda v, w: v * w)  # the bias meets no value
            z = F.aggregate(F.slice(terms, 1, self.width), run["weights"][self.width], lambda a, t: a + t)
            return run["scale"] * softplus(z)

        made = F.transform("_w", lambda run: F.struct(run["seed"].alias("seed"), intensity(run).alias("intensity_raw")))
        return met.select(*keep, F.inline(made))

    def mean_intensity(self, design: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and the mean over seeds as ``intensity_raw``; cells are named by ``cell``."""
        kept = [F.first(c).alias(c) for c in keep if c != "cell"]
        return self.runs(design, keep).groupBy("cell").agg(*kept, F.avg("intensity_raw").alias("intensity_raw"))


def _partial_sums(held_weights: Broadcast, tau: float, flush: int):
    """Task function: sums of one partition per (territory, unit) and seed, flushed every ``flush`` units.

    Rows without unit hold the floor term; their ``slot`` differs from task to task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        table: dict[str, tuple[float, np.ndarray]] = held_weights.value
        schema = pa.schema([("state", pa.string()), ("unit", pa.string()), ("slot", pa.int64()), ("k", pa.int32()),
                            ("z", pa.float64()), ("grad", pa.list_(pa.float64()))])
        held: dict = {}
        own = TaskContext.get().partitionId()

        def drain():
            keys = [(state, unit, k) for (state, unit), sums in held.items() for k in range(len(sums))]
            rows = [sums[k] for sums in held.values() for k in range(len(sums))]
            held.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([s for s, _, _ in keys]), pa.array([u for _, u, _ in keys], pa.string()),
                pa.array([own if u is None else 0 for _, u, _ in keys], pa.int64()), pa.array([k for _, _, k in keys], pa.int32()),
                pa.array([r[0] for r in rows]), pa.array([r[1:] for r in rows], pa.list_(pa.float64())),
            ], schema=schema)

        def add(key, sums):
            if key in held:
                held[key] += sums
            else:
                held[key] = sums.copy()

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.column_stack([x, np.ones(len(x))])
            pop = batch.column("population").to_numpy(zero_copy_only=False)[:, None]
            codes, states = pd.factorize(batch.column("state").to_pandas())
            units = batch.column("unit").to_pandas()
            for code, state in enumerate(states):
                if state not in table:
                    continue
                rows = np.flatnonzero(codes == code)
                scale, weights = table[state]
                xs, ps = x[rows], pop[rows]
                logits = xs @ weights.T
                s = scale * (np.maximum(logits, 0) + np.log1p(np.exp(-np.abs(logits))))
                slope = ps * scale / (1 + np.exp(-np.clip(logits, -700, 700)))
                short = np.maximum(tau - s, 0)
                add((state, None), np.column_stack([(ps * short**2).sum(0), (-2 * short * slope).T @ xs]))
                at, names = pd.factorize(units.iloc[rows])
                order = np.argsort(at, kind="stable")
                edges = np.searchsorted(at[order], np.arange(len(names) + 1))
                for u, name in enumerate(names):
                    mine = order[edges[u] : edges[u + 1]]
                    add((state, name), np.column_stack([(s[mine] * ps[mine]).sum(0), slope[mine].T @ xs[mine]]))
            if len(held) > flush:
                yield drain()
        if held:
            yield drain()

    return run


PARTIAL = "state string, unit string, slot long, k int, z double, grad array<double>"
LOSSES = (-2, -1)  # places of the unit and floor losses, before those of the gradient


def _residuals(held_facts: Broadcast, seeds: int, width: int):
    """Task function: loss terms and gradient per (territory, seed) from partial sums that come sorted by unit.

    A row with k = -1 holds the published total of a unit to train on; units
    without one pull nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        facts: dict[str, tuple[int, float]] = held_facts.value
        out: dict[str, np.ndarray] = {}
        z, g = np.zeros(seeds), np.zeros((seeds, width))
        now, total = None, None

        def of(state):
            return out.setdefault(state, np.zeros((seeds, 2 + width)))

        def close():
            if now is not None and total is not None:
                n = facts[now[0]][0]
                gap = np.log10(z + C.LOG_EPS) - np.log10(total + C.LOG_EPS)
                mine = of(now[0])
                mine[:, 0] += gap * gap / n
                mine[:, 2:] += (gap * 2 / (z + C.LOG_EPS) / (math.log(10) * n))[:, None] * g

        for batch in batches:
            for state, unit, _, k, value, part in batch.itertuples(index=False):
                if unit is None or unit != unit:
                    pop = facts[state][1]
                    mine = of(state)
                    mine[k, 1] += value / pop
                    mine[k, 2:] += C.FLOOR_WEIGHT / pop * part
                    continue
                if (state, unit) != now:
                    close()
                    now, total = (state, unit), None
                    z[:], g[:] = 0, 0
                if k < 0:
                    total = value
                else:
                    z[k] += value
                    g[k] += part
        close()
        for state, sums in out.items():
            k, i = np.indices(sums.shape)
            yield pd.DataFrame({"state": state, "k": k.ravel(), "i": i.ravel() - 2, "v": sums.ravel()})

    return run


def _epoch(data: DataFrame, known: DataFrame, weights: dict[str, tuple[float, np.ndarray]], facts: Broadcast, seeds: int, width: int):
    """Loss terms and gradient of each territory and seed under the current weights: one job, a row per number back."""
    sent = data.sparkSession.sparkContext.broadcast(weights)
    partial = data.mapInArrow(_partial_sums(sent, C.FLOOR_TAU, FLUSH_UNITS), PARTIAL)
    met = partial.unionByName(known).repartition("state", "unit", "slot").sortWithinPartitions("state", "unit", "k")
    sums = met.mapInPandas(_residuals(facts, seeds, width), "state string, k int, i int, v double")
    rows = sums.groupBy("state", "k", "i").agg(F.sum("v").alias("v")).collect()
    sent.unpersist()
    out = {state: np.zeros((seeds, 2 + width)) for state in weights}
    for row in rows:
        out[row["state"]][row["k"], row["i"] + 2] = row["v"]
    return out


def _facts(data: DataFrame, known: DataFrame) -> dict[str, tuple[int, float, float]]:
    """Per territory: units to train on, the scale of the output, and people; territories without such a unit have none."""
    people = data.groupBy("state", "unit").agg(F.sum("population").alias("_p"))
    met = people.join(known.select("state", "unit", F.col("z").alias("_y")), ["state", "unit"], "left")
    held = met.groupBy("state").agg(
        F.count("_y").alias("n"), F.sum("_y").alias("y"), F.sum("_p").alias("p"), F.sum(F.when(F.col("_y").isNotNull(), F.col("_p"))).alias("t")
    ).where("n > 0")
    return {r["state"]: (r["n"], r["y"] / max(r["t"] or 0.0, 1.0), max(r["p"] or 0.0, 1.0)) for r in held.collect()}


def initial_weights(width: int, seed: int) -> np.ndarray:
    return np.append(np.random.default_rng(seed).normal(0, 0.01, width), START)


def learning_rate(epoch: int, epochs: int, lr: float) -> float:
    low = min(C.MIN_LEARNING_RATE, lr)
    return low + (lr - low) * (1 + math.cos(math.pi * (epoch - 1) / epochs)) / 2


def _descend(data: DataFrame, known: DataFrame, width: int, epochs: int, seeds: Sequence[int], lr: float, tag: str):
    """Best weights, scales and history of the territories in ``data``."""
    facts = _facts(data, known)
    if not facts:
        return {}, {}, []
    start = np.stack([initial_weights(width, s) for s in seeds])
    weights = {state: start.copy() for state in facts}
    first, second, kept = ({state: np.zeros_like(start) for state in facts} for _ in range(3))
    best = {state: np.full(len(seeds), np.inf) for state in facts}
    history: list[tuple] = []
    told = data.sparkSession.sparkContext.broadcast({state: (n, pop) for state, (n, _, pop) in facts.items()})
    for epoch in range(1, epochs + 1):
        sums = _epoch(data, known, {s: (facts[s][1], w) for s, w in weights.items()}, told, len(seeds), width + 1)
        rate = learning_rate(epoch, epochs, lr)
        for state, found in sums.items():
            l_agg, l_floor, step = found[:, 0], found[:, 1], found[:, 2:]
            loss = l_agg + C.FLOOR_WEIGHT * l_floor
            better = loss < best[state]
            best[state][better], kept[state][better] = loss[better], weights[state][better]
            history += [(tag, state, int(s), epoch, float(a), float(b), float(c)) for s, a, b, c in zip(seeds, loss, l_agg, l_floor)]
            norms = np.linalg.norm(step, axis=1, keepdims=True)
            step = step * np.minimum(1.0, C.GRADIENT_CLIP / np.maximum(norms, 1e-12))
            first[state] = 0.9 * first[state] + 0.1 * step
            second[state] = 0.999 * second[state] + 0.001 * step**2
            towards = (first[state] / (1 - 0.9**epoch)) / (np.sqrt(second[state] / (1 - 0.999**epoch)) + 1e-8)
            weights[state] = weights[state] - rate * towards
    told.unpersist()
    bad = [state for state in facts if not np.isfinite(best[state]).all()]
    if bad:
        raise ValueError(f"[{tag}] every epoch gave a non-finite loss in {bad[:20]}")
    return {(state, int(s)): kept[state][i] for state in facts for i, s in enumerate(seeds)}, {s: f[1] for s, f in facts.items()}, history


def fit_intensity(
    design: DataFrame,
    totals: DataFrame,
    epochs: int = C.EPOCHS,
    seeds: Sequence[int] = (0,),
    lr: float = C.LEARNING_RATE,
    tag: str = "main",
) -> Fit:
    """Minimise, for every territory, the mean squared log10 gap of unit sums plus the floor term.

    ``design``: unit, population, the vector ``x`` and, if there are several territories,
    ``state`` (``graph.design_matrix``). ``totals``: unit, y_inr, state as there, and
    optionally a boolean ``train``. Cells without unit count for the floor only; territories
    without a unit to train on get no weights. All territories and seeds share each scan.
    """
    keys = unit_key(design, totals)
    alone = "state" not in keys
    state = (F.lit("") if alone else F.coalesce(F.col("state").cast("string"), F.lit(""))).alias("state")
    kind = "string" if "state" not in design.columns else design.schema["state"].dataType.simpleString()
    width = design.select(F.size("x")).first()
    if width is None:
        raise ValueError("no cell to fit on")
    width = width[0]
    pop = F.coalesce(F.col("population").cast("double"), F.lit(0.0)).alias("population")
    data = design.select(state, F.col("unit").cast("string").alias("unit"), pop, "x").persist(StorageLevel.MEMORY_AND_DISK)
    trained = totals if "train" not in totals.columns else totals.where("train")
    known = trained.select(
        state, F.col("unit").cast("string").alias("unit"), F.lit(0).cast("long").alias("slot"), F.lit(-1).alias("k"),
        F.col("y_inr").cast("double").alias("z"), F.lit(None).cast("array<double>").alias("grad"),
    )
    # Totals of units that have no cell would be constants of the loss.
    known = known.join(data.select("state", "unit").distinct(), ["state", "unit"], "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        names = known.select("state").distinct()
        groups = -(-names.count() * (TEXT_BYTES + 8 * (width + 1) * len(seeds)) // BROADCAST_BYTES)
        if not groups:
            raise ValueError("no unit is left to train on")
        weights, scale, history = {}, {}, []
        for group in range(groups):
            one = F.lit(True) if groups == 1 else F.pmod(F.xxhash64("state"), F.lit(groups)) == group
            w, sc, h = _descend(data.where(one), known.where(one), width, epochs, seeds, lr, tag)
            weights, scale, history = weights | w, scale | sc, history + h
    finally:
        data.unpersist()
        known.unpersist()
    # Back from text to the territory's own type.
    typed = {k: k for k in scale}
    if alone and "state" in design.columns:
        typed = {"": design.select("state").first()[0]}
    elif kind != "string":
        back = design.sparkSession.createDataFrame([(k,) for k in scale], "k string").select("k", F.col("k").cast(kind).alias("v"))
        typed = {r["k"]: r["v"] for r in back.collect()}
    elif "state" not in design.columns:
        typed = {"": None}
    return Fit(
        width, {(typed[k], seed): w for (k, seed), w in weights.items()}, {typed[k]: v for k, v in scale.items()},
        [(t, typed[k], *rest) for t, k, *rest in history], kind,
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch of the least loss per tag, seed and, if named, territory; the earliest on ties."""
    keys = [c for c in ("tag", "state", "seed") if c in history.columns]
    least = F.min(F.struct("loss", "epoch")).alias("_b")
    return history.groupBy(*keys).agg(least).select(*keys, F.col("_b.epoch").alias("epoch"), F.col("_b.loss").alias("loss"))


def holdout_units(totals: DataFrame, fraction: float = C.HOLDOUT_FRACTION, seed: int = 0) -> DataFrame | None:
    """``state, unit, held``: a fixed pseudo-random share of the units of every territory.

    The units with the smallest hashes are held out, at least one. A territory with
    too few units holds out none: ``held`` is null there. Totals without ``state`` are
    one territory, and give None if they are too few.
    """
    if "state" not in totals.columns:
        one = holdout_units(totals.withColumn("state", F.lit(0)), fraction, seed)
        return None if totals.count() < C.MIN_HOLDOUT_UNITS else one.drop("state")
    order = F.md5(F.concat_ws(":", F.col("unit"), F.lit(str(seed))))
    place = F.row_number().over(Window.partitionBy("state").orderBy(order, "unit"))
    n = F.count(F.lit(1)).over(Window.partitionBy("state"))
    share = F.greatest(F.lit(1), F.bround(n * F.lit(fraction)))
    return totals.select("state", "unit", F.when(n >= C.MIN_HOLDOUT_UNITS, place <= share).alias("held"))


def _last_losses(fit: Fit, like: DataFrame) -> DataFrame:
    return fit.history_table(like).groupBy("state").agg(F.max_by("loss", "epoch").alias("final_loss"))


def spatial_holdout(
    design: DataFrame, totals: DataFrame, epochs: int = C.EPOCHS, seed: int = 0, lr: float = C.LEARNING_RATE
) -> DataFrame:
    """Per territory, the MAPE of the raw sums of held-out units, trained on the others.

    A territory with too few units has ``skipped`` true and its number of units. Units
    without cells are neither trained on nor held out.
    """
    present = totals.join(design.select(*UNIT_KEY).distinct(), list(UNIT_KEY), "left_semi")
    split = holdout_units(present, seed=seed)
    flagged = present.join(split, list(UNIT_KEY)).withColumn("train", ~F.coalesce("held", F.lit(False)))
    fit = fit_intensity(design, flagged, epochs, (seed,), lr, tag="holdout")
    sums = fit.runs(design, [*UNIT_KEY, "population"]).groupBy(*UNIT_KEY).agg(
        F.sum(F.col("intensity_raw") * F.col("population")).alias("predicted")
    )
    scored = flagged.join(sums, list(UNIT_KEY), "left")
    seen = F.col("held") & F.col("predicted").isNotNull()
    gap = F.when(seen, F.abs(F.col("predicted") - F.col("y_inr")) / F.greatest(F.abs("y_inr"), F.lit(1e-9)))
    told = scored.groupBy("state").agg(
        F.avg(gap).alias("holdout_mape"), F.count_if(seen).alias("n_holdout_units"), F.count(F.lit(1)).alias("n_units"),
        F.bool_and(F.col("held").isNull()).alias("skipped"),
    )
    return told.join(_last_losses(fit, design), "state", "left").withColumn("final_loss", F.when(~F.col("skipped"), F.col("final_loss")))


def ablation(
    designs: dict[str, DataFrame], totals: DataFrame, epochs: int = C.EPOCHS, seed: int = 0, lr: float = C.LEARNING_RATE,
    made: dict[str, Fit] | None = None,
) -> DataFrame:
    """Loss per territory for each of several design matrices, such as one with a feature group and one without.

    ``made`` holds fits that exist already under the same settings, with ``seed`` among their seeds.
    """
    parts = []
    for tag, design in designs.items():
        fit = (made or {}).get(tag) or fit_intensity(design, totals, epochs, (seed,), lr, tag=f"ablation_{tag}")
        fit = fit.of_seed(seed)
        sums = fit.runs(design, [*UNIT_KEY, "population"]).join(totals.select(*UNIT_KEY, "y_inr"), list(UNIT_KEY))
        losses = log_loss(sums, ("state",)).join(_last_losses(fit, design), "state")
        parts.append(losses.select(F.lit(tag).alias("tag"), "state", F.lit(fit.width).alias("n_features"), "log_loss", F.col("final_loss").alias("final_train_loss")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
