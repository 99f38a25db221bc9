import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dasyspark import config as C
from dasyspark.operators import allocate, fit, graph, joins, publish, ranks, targets
from dasyspark.operators.features import describe_inputs, engineer_features
from dasyspark.operators.explain import top_features


def frame(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "cell": np.arange(n), "unit": [f"u{i % 7}" for i in range(n)], "state": np.arange(n) % 7 % 2,
        "population": np.where(rng.random(n) < 0.2, 0.0, rng.integers(1, 500, n)).astype(float),
        "night_lights": np.where(rng.random(n) < 0.3, 0.0, rng.random(n) * 10), "road_km": rng.integers(0, 5, n).astype(float),
        "poi_count": rng.integers(0, 3, n).astype(float), "building_share": rng.random(n),
    })
    return pdf, spark.createDataFrame(pdf)


def unit_totals(spark, size):
    """The seven units of ``frame``, in two territories."""
    return spark.createDataFrame([(i % 2, f"u{i}", size * (i + 1)) for i in range(7)], "state long, unit string, y_inr double")


def test_worked_example(spark):
    cells = spark.createDataFrame([(1, "a", 100.0, 10.0), (2, "a", 200.0, 20.0), (3, "a", 300.0, 10.0)], "cell int, unit string, population double, intensity_raw double")
    totals = spark.createDataFrame([("a", 10000.0)], "unit string, y_inr double")
    rows = {r.cell: r for r in allocate.dasymetric_allocate(cells, totals).collect()}
    assert [rows[k].gdp_inr for k in (1, 2, 3)] == [1250.0, 5000.0, 3750.0]
    assert rows[1].dasymetric_scale == 1.25


def test_allocation_adds_up_and_ranks_like_pandas(spark):
    pdf, cells = frame(spark)
    cells = cells.withColumn("intensity_raw", F.col("night_lights") + 1)
    totals = unit_totals(spark, 1e9)
    out = allocate.ranked_wealth(allocate.dasymetric_allocate(cells, totals)).toPandas()
    sums = out.groupby("unit").agg(a=("gdp_inr", "sum"), y=("y_inr", "first"))
    assert ((sums.a - sums.y).abs() / sums.y).max() < 1e-9
    assert out.groupby("unit").dasymetric_scale.nunique().max() == 1
    for _, part in out.groupby("state"):
        live = part[part.population > 0]
        want = live.gdp_per_capita_inr.rank(method="average", pct=True) * 100
        assert np.allclose(live.wealth_index, want)
        assert (part[part.population == 0].wealth_index == 0).all()
    assert set(out[out.population == 0].wealth_quintile) == {1}


def test_zero_population_unit_keeps_its_scale_finite(spark):
    cells = spark.createDataFrame([(1, "a", 0.0, 1.0)], "cell int, unit string, population double, intensity_raw double")
    row = allocate.dasymetric_allocate(cells, spark.createDataFrame([("a", 5.0)], "unit string, y_inr double")).first()
    assert row.gdp_inr == 0.0 and row.gdp_per_capita_inr is None and row.dasymetric_scale == pytest.approx(5e9)


def test_ranks_and_quantiles_match_pandas_with_heavy_ties(spark):
    pdf, cells = frame(spark, n=1000)
    pdf["v"] = np.where(pdf.cell % 3 == 0, 5.0, pdf.road_km)  # a third of all rows share one value
    cells = spark.createDataFrame(pdf)
    got = ranks.with_rank(cells, ["state"], "v", "rk", ranks.average_rank()).toPandas().sort_values("cell")
    assert np.allclose(got.rk, pdf.groupby("state").v.rank(method="average"))
    q = ranks.exact_quantiles(cells, ["state"], "night_lights", {"a": 0.2, "b": 0.5, "c": 0.97}).toPandas().set_index("state")
    for state, part in pdf.groupby("state"):
        assert np.allclose(q.loc[state], part.night_lights.quantile([0.2, 0.5, 0.97]))
    d = describe_inputs(cells, ["state"], "night_lights").toPandas().set_index("state")
    for state, part in pdf.groupby("state"):
        w = part.night_lights.describe()
        assert np.allclose(d.loc[state, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]].astype(float), w.to_numpy())


def test_ranges_give_the_same_ranks_as_one_sort(spark, monkeypatch):
    """The way for many distinct values, on skewed data with ties across range cuts."""
    rng = np.random.default_rng(5)
    v = np.concatenate([np.exp(rng.normal(0, 4, 700)), np.full(400, 2.5), -rng.random(100)])
    pdf = pd.DataFrame({"cell": np.arange(len(v)), "state": np.arange(len(v)) % 3, "v": v})
    rows = spark.createDataFrame(pdf)
    whole = sorted(map(tuple, ranks.value_ranks(rows, ["state"], "v").collect()))
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 100)
    assert sorted(map(tuple, ranks.value_ranks(rows, ["state"], "v").collect())) == whole
    got = ranks.with_rank(rows, ["state"], "v", "rk", ranks.average_rank()).toPandas().sort_values("cell")
    assert np.allclose(got.rk, pdf.groupby("state").v.rank(method="average"))
    assert ranks.value_ranks(rows.where("v = 2.5"), ["state"], "v").count() == 3


def test_hot_values_and_nulls_are_ranked_without_meeting(spark, monkeypatch):
    """A value over a third of all rows has a range of its own; its rows and the nulls are spread, the ranks exact."""
    rng = np.random.default_rng(8)
    v = np.concatenate([np.full(500, 3.0), rng.random(400) * 10, np.full(300, np.nan), np.full(300, 7.0)])
    pdf = pd.DataFrame({"cell": np.arange(len(v)), "state": rng.integers(0, 3, len(v)), "v": v})
    rows = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 100)
    got = ranks.placed(rows, ["state"], "v").toPandas().sort_values("cell").reset_index(drop=True)
    for _, part in pdf.groupby("state"):
        mine = got.loc[part.index]
        assert np.allclose(mine.n_below + 1, part.v.rank(method="min"), equal_nan=True)
        assert np.allclose(mine.n_below + mine.n_eq, part.v.rank(method="max"), equal_nan=True)
        assert set(mine.n_all.dropna()) == {part.v.notna().sum()}
    keyed, _ = ranks._with_range(rows.withColumn("_v", F.col("v")), len(v))
    parts = keyed.groupBy("_range", "_spread", "v").count().where("v IN (3, 7)").toPandas()
    assert parts.groupby("v").size().min() > 20 and keyed.where("v IN (3, 7)").select("_range").distinct().count() == 2
    pairs = {"p": ("v", "cell")}
    rho = {r.state: r.rho for r in ranks.spearman(rows, ["state"], pairs).collect()}
    for state, part in pdf.groupby("state"):
        some = part[part.v.notna()]
        assert rho[state] == pytest.approx(some.v.rank().corr(some.cell.rank()))


def test_index_follows_sorted_names(spark):
    names = [f"n{i:03d}" for i in np.random.default_rng(1).permutation(300)]
    rows = spark.createDataFrame([(n,) for n in names + names[:50]], "unit string").repartition(5)
    got = {r.unit: r.idx for r in graph.feature_index(rows, "unit").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_disaggregate_adds_up_with_seed_ranges(spark):
    from dasyspark.plans.disaggregate import disaggregate

    _, cells = frame(spark, n=200)
    totals = unit_totals(spark, 1e6)
    out, result = disaggregate(cells, totals, epochs=2, seeds=(0, 1), lr=0.05, units=totals)
    pdf = out.toPandas()
    assert len(pdf) == 200 and len(result.history) == 8
    sums = pdf.groupby("unit").gdp_inr.sum()
    assert all(abs(sums[f"u{i}"] / (1e6 * (i + 1)) - 1) < 1e-9 for i in range(7))
    live = pdf[pdf.population > 0]
    assert (live.wealth_index_min <= live.wealth_index_max).all() and pdf.wealth_index.between(0, 100).all()
    assert fit.best_epoch(result.history_table(cells)).count() == 4 and len(result.weights) == 4


def test_spearman_matches_pandas_and_null_when_constant(spark):
    pdf, cells = frame(spark)
    cells = cells.withColumn("flat", F.lit(1.0)).withColumn("gap", F.when(F.col("cell") % 4 > 0, F.col("night_lights")))
    pairs = {"p": ("night_lights", "road_km"), "c": ("flat", "road_km"), "g": ("gap", "road_km")}
    got = ranks.spearman(cells, ["state"], pairs).toPandas()
    for state, part in pdf.groupby("state"):
        some = part[part.cell % 4 > 0]
        row = got[(got.pair == "g") & (got.state == state)]
        assert row.rho.iloc[0] == pytest.approx(some.night_lights.rank().corr(some.road_km.rank()))
        want = part.night_lights.rank().corr(part.road_km.rank())
        row = got[(got.pair == "p") & (got.state == state)]
        assert row.rho.iloc[0] == pytest.approx(want)
    assert got[got.pair == "c"].rho.isna().all()


def test_join_targets_refuses_totals_without_cells(spark):
    _, cells = frame(spark)
    nameless = spark.createDataFrame([("u1", 1.0)], "unit string, y_inr double")
    with pytest.raises(ValueError, match="without state"):
        joins.join_targets(cells, nameless)
    totals = spark.createDataFrame([(1, "u1", 1.0), (1, "nowhere", 2.0)], "state long, unit string, y_inr double")
    with pytest.raises(ValueError, match="nowhere"):
        joins.join_targets(cells, totals)
    assert {r.unit for r in joins.join_targets(cells, totals.where("unit = 'u1'")).select("unit").distinct().collect()} == {"u1"}


def test_attach_without_bound_gives_the_same_rows(spark):
    _, cells = frame(spark)
    stats = cells.groupBy("unit").agg(F.sum("population").alias("p"))
    a = joins.attach(cells, stats, "unit", bound=stats).select("cell", "p").collect()
    assert sorted(a) == sorted(joins.attach(cells, stats, "unit").select("cell", "p").collect())


def test_features_match_numpy(spark):
    pdf, cells = frame(spark)
    out, names = engineer_features(cells, ("state",))
    got = out.toPandas().sort_values("cell").reset_index(drop=True)
    assert "night_lights_log_z" in names and "building_share_exists_z" in names
    for state, part in pdf.groupby("state"):
        log = np.where(part.night_lights > 0, np.log10(part.night_lights.where(part.night_lights > 0, 1)), 0)
        assert np.allclose(got.loc[part.index, "night_lights_log_z"], (log - log.mean()) / log.std())
        assert np.allclose(got.loc[part.index, "building_share_exists_z"], 0)
    _, dark = engineer_features(cells.withColumn("night_lights", F.lit(0.0)), ("state",))
    assert not [n for n in dark if n.startswith("night_lights")]


def test_top_features_orders_by_size_then_name(spark):
    row = spark.createDataFrame([(1, 2.0, -3.0, None, 3.0)], "cell int, a double, b double, c double, d double")
    got = [(r.rank, r.feature, r.z) for r in top_features(row, ["a", "b", "c", "d"], top=2).collect()]
    assert got == [(1, "b", -3.0), (2, "d", 3.0)]


def test_pack_and_unpack_round_trip(spark):
    rows = [("u", 1, 10, 1.26, 0.0), ("u", 1, 11, None, 0.0), ("u", 2, 12, 3.0, 2.5), ("v", 2, 13, 4.0, 0.0)]
    cells = spark.createDataFrame(rows, "unit string, block int, hex int, population double, poi_count double")
    known = spark.createDataFrame([("u", 5.25, 1.5), ("v", None, 2.0)], "unit string, y double, s double")
    packed = publish.pack_columnar(cells, ["unit"], "block", "hex", ["population", "poi_count"], constants=known, res=7)
    first = {(r.unit, r.block): r for r in packed.collect()}
    # A field goes only where it is empty in the whole payload.
    assert first["u", 1].poi == [0, 0] and first["v", 2].poi is None and first["u", 1].p == [1.3, None]
    back = sorted(tuple(r) for r in publish.unpack_columnar(packed, ["unit"]).select("block", "h", "unit", "p", "poi", "y", "s").collect())
    assert back == [(1, 10, "u", 1.3, 0, 5.25, 1.5), (1, 11, "u", None, 0, 5.25, 1.5), (2, 12, "u", 3.0, 2, 5.25, 1.5), (2, 13, "v", 4.0, None, None, 2.0)]
    text = {(r.unit, r.block): r.payload for r in publish.payload_json(packed, ["unit"]).collect()}
    assert text["u", 2] == (
        '{"res":7,"n":1,"district":"u","per_district":{"u":{"y":5.25,"s":1.5}},"columnar":true,"cols":{"h":[12],"p":[3.0],"poi":[2]}}')


def test_overview_payload_codes_units_by_a_dictionary(spark):
    rows = [("S", "b", 1, 10, 1.0), ("S", "a", 1, 11, 2.0), ("S", "b", 1, 12, 3.0), ("S", None, 1, 13, 4.0), ("T", "a", 2, 14, 0.0)]
    cells = spark.createDataFrame(rows, "state string, unit string, block int, hex int, population double")
    known = spark.createDataFrame([("S", "a", 1.0, 2.0), ("S", "b", 3.0, 4.0), ("T", "a", 5.0, 6.0)], "state string, unit string, y double, s double")
    packed = publish.pack_columnar(cells, ["state"], "block", "hex", ["population"], constants=known)
    got = {r.state: r for r in packed.collect()}
    assert got["S"].d_vals[:2] == ["a", "b"] and got["S"].d[:3] == [1, 0, 1] and got["T"].p is None
    assert {k: tuple(v) for k, v in got["S"].per_district.items()} == {"a": (1.0, 2.0), "b": (3.0, 4.0)}
    back = {r.h: (r.state, r.unit, r.p, r.y, r.s) for r in publish.unpack_columnar(packed, ["state"]).collect()}
    assert back == {10: ("S", "b", 1.0, 3.0, 4.0), 11: ("S", "a", 2.0, 1.0, 2.0), 12: ("S", "b", 3.0, 3.0, 4.0),
                    13: ("S", None, 4.0, None, None), 14: ("T", "a", None, 5.0, 6.0)}


def plain_fit(cells, totals, epochs, seed, lr):
    """The same descent for one territory, cell by cell in memory: best weights and losses."""
    x = np.column_stack([np.stack(cells.x.to_numpy()), np.ones(len(cells))])
    pop, y = cells.population.to_numpy(), cells.unit.map(totals).to_numpy(float)
    units = [np.flatnonzero(cells.unit == u) for u in totals]
    scale = sum(totals.values()) / max(pop[~np.isnan(y)].sum(), 1)
    w, m, v, best, kept, losses = fit.initial_weights(x.shape[1] - 1, seed), 0, 0, np.inf, None, []

    def loss(w):
        s = scale * np.logaddexp(0, x @ w)
        gaps = [np.log10((s[r] * pop[r]).sum() + C.LOG_EPS) - np.log10(y[r[0]] + C.LOG_EPS) for r in units]
        return np.mean(np.square(gaps)) + C.FLOOR_WEIGHT * (pop * np.maximum(C.FLOOR_TAU - s, 0) ** 2).sum() / max(pop.sum(), 1)

    for epoch in range(1, epochs + 1):
        losses.append(loss(w))
        if losses[-1] < best:
            best, kept = losses[-1], w
        steps = np.eye(len(w)) * 1e-6
        g = np.array([(loss(w + d) - loss(w - d)) / 2e-6 for d in steps])
        g = g * min(1, C.GRADIENT_CLIP / np.linalg.norm(g))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - fit.learning_rate(epoch, epochs, lr) * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return kept, losses


@pytest.fixture(scope="module")
def design(spark):
    pdf, cells = frame(spark, n=300)
    x = F.array(F.col("night_lights") / 10, F.col("road_km") / 5)
    return pdf.assign(x=[[a / 10, b / 5] for a, b in zip(pdf.night_lights, pdf.road_km)]), cells.withColumn("x", x)


@pytest.mark.parametrize("grouped", [False, True])
def test_each_territory_is_fitted_by_itself(spark, design, monkeypatch, grouped):
    """Weights of every territory and seed are those of a plain descent on its own cells, also in several groups."""
    pdf, cells = design
    if grouped:
        monkeypatch.setattr(fit, "BROADCAST_BYTES", 300)
    result = fit.fit_intensity(cells, unit_totals(spark, 1e6), epochs=6, seeds=(0, 1), lr=0.1)
    assert set(result.weights) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for state in (0, 1):
        part = pdf[pdf.state == state]
        totals = {f"u{i}": 1e6 * (i + 1) for i in range(7) if i % 2 == state}
        for seed in (0, 1):
            want, losses = plain_fit(part, totals, 6, seed, 0.1)
            assert np.allclose(result.weights[state, seed], want, atol=1e-4)
            got = [h[4] for h in result.history if h[1:3] == (state, seed)]
            assert np.allclose(got, losses, rtol=1e-4)
    runs = result.runs(cells, ["cell", "state", "population"]).toPandas()
    row = runs[(runs.cell == 5) & (runs.seed == 1)].iloc[0]
    w = result.weights[row.state, 1]
    assert row.intensity_raw == pytest.approx(result.scale[row.state] * np.logaddexp(0, np.dot(w, [*pdf.x[5], 1])))
    assert result.mean_intensity(cells, ["cell", "state"]).count() == 300


def test_fit_gradient(spark, design):
    """Against finite differences, with a unit that is not trained on and cells without unit."""
    _, cells = design
    data = cells.select(F.lit("s").alias("state"), F.when(F.col("cell") % 11 > 0, F.col("unit")).alias("unit"), "population", "x")
    totals = [("s", f"u{i}", 0, -1, 1e6 * (i + 1), None) for i in range(6)]
    known = spark.createDataFrame(totals, fit.PARTIAL)
    weights = np.array([[0.3, -0.2, 0.1], [0.0, 0.1, -4.0]])
    facts = spark.sparkContext.broadcast({"s": (6, 1e4)})

    def loss(w):
        out = fit._epoch(data, known, {"s": (3.0, w)}, facts, 2, 3)["s"]
        return out[:, 0] + C.FLOOR_WEIGHT * out[:, 1], out[:, 2:]

    _, grad = loss(weights)
    for j in range(3):
        step = np.zeros_like(weights)
        step[:, j] = 1e-5
        up, down = loss(weights + step)[0], loss(weights - step)[0]
        assert np.allclose((up - down) / 2e-5, grad[:, j], rtol=1e-4, atol=1e-7)


def test_fit_of_odd_tables(spark, design):
    """One territory without a name; totals that nothing can be trained on raise; flushing often changes nothing."""
    pdf, cells = design
    alone = cells.drop("state")
    totals = spark.createDataFrame([(f"u{i}", 1e6 * (i + 1)) for i in range(7)] + [("nowhere", 5.0)], "unit string, y_inr double")
    result = fit.fit_intensity(alone, totals, epochs=3, lr=0.1)
    want, _ = plain_fit(pdf, {f"u{i}": 1e6 * (i + 1) for i in range(7)}, 3, 0, 0.1)
    assert np.allclose(result.weights[None, 0], want, atol=1e-4)
    assert result.runs(alone, ["cell"]).count() == 300
    with pytest.raises(ValueError, match="train"):
        fit.fit_intensity(alone, totals.withColumn("train", F.lit(False)), epochs=1)
    with pytest.raises(ValueError, match="train"):
        fit.fit_intensity(alone, totals.where("unit = 'nowhere'"), epochs=1)
    with pytest.raises(ValueError, match="no cell"):
        fit.fit_intensity(alone.limit(0), totals, epochs=1)


def test_design_matrix_stays_within_territories(spark):
    """Neighbours and parents of another territory send nothing."""
    rows = [(1, "a", "A", 10.0, 1.0), (2, "a", "A", 10.0, 3.0), (3, "b", "B", 10.0, 100.0)]
    cells = spark.createDataFrame(rows, "cell long, unit string, state string, population double, f double")
    edges = spark.createDataFrame([(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b], "src long, dst long")
    edges = graph.within_territories(edges, cells)
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (2, 1)}
    links = cells.select(F.col("cell").alias("child"), F.concat("state", F.lit(":7")).alias("parent"))
    got = {r.cell: r.x for r in graph.design_matrix(cells, ["f"], edges, links, hops=1).collect()}
    assert got == {1: [1.0, 1.5, 2.0], 2: [3.0, 0.5, 2.0], 3: [100.0, 0.0, 100.0]}
    assert {r.cell: r.x for r in graph.design_matrix(cells, ["f"]).collect()} == {1: [1.0], 2: [3.0], 3: [100.0]}


def test_a_written_table_goes_with_its_successor(spark):
    import glob

    from dasyspark.session import Superseding, shared_dir

    here = lambda: glob.glob(f"{shared_dir(spark)}/round-*")
    tables, now = Superseding(), spark.range(5)
    for k in range(3):
        now = tables.write(now.select((F.col("id") + 1).alias("id")), "round")
        assert len(here()) == 1
    assert sorted(r.id for r in now.collect()) == [3, 4, 5, 6, 7]


def test_metros_and_missing_units_tell_namesakes_apart(spark):
    units = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y")], "state string, unit string")
    metros = spark.createDataFrame([("A", "m", ["x", "y"]), ("B", "n", ["y", "x", "z"])], "state string, metro string, units array<string>")
    got = sorted((r.state, r.position, r.unit) for r in joins.metro_units(metros, units).collect())
    assert got == [("A", 0, "x"), ("B", 0, "y"), ("B", 1, "x")]
    totals = spark.createDataFrame([("A", "x", 1.0), ("A", "y", 1.0), ("B", "y", 1.0)], "state string, unit string, y_inr double")
    assert {tuple(r) for r in joins.missing_units(totals, units).collect()} == {("A", "y", "cells"), ("B", "x", "totals")}


def test_holdout_needs_five_units(spark):
    few = spark.createDataFrame([(f"u{i}", 1.0) for i in range(4)], "unit string, y_inr double")
    assert fit.holdout_units(few) is None
    some = spark.createDataFrame([(f"u{i}", 1.0) for i in range(12)], "unit string, y_inr double")
    assert fit.holdout_units(some).where("held").count() == 2


def test_score_layers_match_numpy(spark):
    rng = np.random.default_rng(3)
    n, parents, tops, dim, hidden = 12, 4, 2, 3, 5
    x = {"fine": rng.normal(size=(n, dim)), "mid": rng.normal(size=(parents, dim)), "coarse": rng.normal(size=(tops, dim))}
    up = np.arange(n) % parents
    up[n - 1] = -1  # an orphan
    up_mid = np.arange(parents) % tops
    pairs = {"fine": [(i, (i + 1) % (n - 2)) for i in range(n - 2)], "mid": [(0, 1), (1, 0)], "coarse": [(0, 1)]}
    w = graph.init_weights(dim, hidden, 2, seed=1)
    elu = lambda v: np.where(v > 0, v, np.expm1(np.minimum(v, 0)))

    h = {k: elu(x[k] @ w[f"in.{k}.w"].T + w[f"in.{k}.b"]) for k in x}
    h0 = dict(h)
    for k in range(2):
        a = {}
        for lvl in h:
            msg, deg = np.zeros_like(h[lvl]), np.ones(len(h[lvl]))
            for s, d in pairs[lvl]:
                msg[d] += h[lvl][s]
                deg[d] += 1
            a[lvl] = elu(h[lvl] @ w[f"self.{lvl}.{k}.w"].T + w[f"self.{lvl}.{k}.b"] + (msg / deg[:, None]) @ w[f"near.{lvl}.{k}.w"].T + w[f"near.{lvl}.{k}.b"])
        pool = lambda child, to, size: np.stack([child[to == p].mean(0) for p in range(size)])
        down_fine = np.where((up >= 0)[:, None], h["mid"][np.maximum(up, 0)] @ w[f"down.fine.{k}.w"].T + w[f"down.fine.{k}.b"], 0)
        down_mid = h["coarse"][up_mid] @ w[f"down.mid.{k}.w"].T + w[f"down.mid.{k}.b"]
        new = {
            "fine": elu(np.hstack([a["fine"], down_fine]) @ w["mix.w"].T + w["mix.b"]),
            "mid": elu(a["mid"] + pool(h["fine"], up, parents) @ w[f"up.mid.{k}.w"].T + w[f"up.mid.{k}.b"] + down_mid),
            "coarse": elu(a["coarse"] + pool(h["mid"], up_mid, tops) @ w[f"up.coarse.{k}.w"].T + w[f"up.coarse.{k}.b"]),
        }
        h = {lvl: 0.9 * new[lvl] + 0.1 * h0[lvl] for lvl in h}
    want = np.log1p(np.exp(h["fine"] @ w["out.w"].T + w["out.b"]))[:, 0]

    table = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "cell int, x array<double>")
    edge = lambda e: spark.createDataFrame(e, "src int, dst int")
    links = spark.createDataFrame([(i, int(p)) for i, p in enumerate(up) if p >= 0], "child int, parent int")
    mid_links = spark.createDataFrame([(i, int(p)) for i, p in enumerate(up_mid)], "child int, parent int")
    out = graph.score_layers(
        table(x["fine"]), table(x["mid"]), table(x["coarse"]), {k: edge(v) for k, v in pairs.items()}, links, mid_links, w, dim, hidden, 2)
    got = {r.cell: r.intensity_raw for r in out.collect()}
    assert np.allclose([got[i] for i in range(n)], want)


def test_settings(spark):
    assert C.territory(" mh ")["name"] == "Maharashtra"
    with pytest.raises(KeyError, match="MH"):
        C.territory("ZZ")
    aliases = {(r.code, r.alias): r.canonical for r in C.alias_table(spark).collect()}
    assert aliases[("MH", "greater mumbai")] == "Mumbai" and aliases[("BR", "kaimur (bhabua)")] == "Kaimur"
    assert C.poi_table(spark).where("poi_group = 'shop_luxury'").count() == 4
    assert C.total_source_table(spark).count() == C.territory_table(spark).count() == 8
    assert C.metro_table(spark).count() == 7
    assert len(C.MAGNITUDE_COLUMNS) == 42 and 2 * len(C.MAGNITUDE_COLUMNS) + 2 * len(C.SHARE_COLUMNS) == 94


def test_sources_precedence(spark):
    mk = lambda rows: spark.createDataFrame(rows, "state string, y double")
    out = targets.resolve_sources([mk([("A", 1.0)]), mk([("A", 2.0), ("B", 3.0)]), mk([("B", 4.0), ("C", 5.0)])])
    assert sorted((r.state, r.y) for r in out.collect()) == [("A", 1.0), ("B", 3.0), ("C", 5.0)]


def test_units_of_one_name_in_two_territories_stay_apart(spark):
    cells = spark.createDataFrame(
        [(1, "UP", "Pratapgarh", 10.0, 1.0), (2, "RJ", "Pratapgarh", 30.0, 1.0), (3, "RJ", "Alwar", 5.0, 2.0)],
        "cell int, state string, unit string, population double, intensity_raw double")
    totals = spark.createDataFrame(
        [("UP", "Pratapgarh", 100.0), ("RJ", "Pratapgarh", 900.0), ("RJ", "Alwar", 50.0)], "state string, unit string, y_inr double")
    rows = {r.cell: r.gdp_inr for r in allocate.dasymetric_allocate(cells, totals).collect()}
    assert rows == {1: 100.0, 2: 900.0, 3: 50.0}
    assert joins.join_targets(cells, totals).count() == 3
    assert allocate.reconstruction_error(allocate.dasymetric_allocate(cells, totals)).count() == 3
    with pytest.raises(Exception, match="several totals"):
        allocate.dasymetric_allocate(cells, totals.union(totals)).collect()
    with pytest.raises(ValueError, match="totals without cells"):
        joins.join_targets(cells, totals.union(spark.createDataFrame([("UP", "Alwar", 1.0)])))


def test_holdout_is_per_territory(spark):
    rows = [("A", f"u{i}", 1.0) for i in range(12)] + [("B", f"u{i}", 1.0) for i in range(4)]
    found = fit.holdout_units(spark.createDataFrame(rows, "state string, unit string, y_inr double"))
    assert found.where("state = 'A' AND held").count() == 2 and found.where("state = 'B' AND held IS NULL").count() == 4


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from dasyspark.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_people_are_packed_from_values_without_the_noise_of_a_sum(spark):
    """A seventh of whole cents may end in a 5 exactly, and what a sum adds behind that must not decide the last digit."""
    from registry import publishing

    people = [r.population for r in publishing.to_pack(spark, "/root/testdata/sf0.001").collect()]
    assert people and all(p == round(p, 6) for p in people)


def test_a_preset_cell_has_one_dossier():
    """A territory of one cell has it as both presets."""
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for t in ("region", "nation"):
        db.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    db.sql("create view customer as select * from '/root/testdata/sf0.001/customer.parquet' where c_custkey in (select min(c_custkey) from '/root/testdata/sf0.001/customer.parquet' join '/root/testdata/sf0.001/orders.parquet' on c_custkey = o_custkey where c_acctbal > 0)")
    db.sql("create view orders as select * from '/root/testdata/sf0.001/orders.parquet' where o_custkey in (select c_custkey from customer)")
    assert len(db.sql(entry.oracle_sql()["cell_dossier"]).fetchall()) == 1


def test_published_totals_do_not_depend_on_the_order_of_their_rows(spark, tmp_path):
    from registry import core

    given = {
        "nation": ([(3, "NATION_3", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(7, 3)], "c_custkey bigint, c_nationkey int"),
        "orders": (
            [(i, 7, "1-URGENT", 0.1) for i in range(10)] + [(10, 7, "2-HIGH", 1e9 + 0.07)],
            "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double",
        ),
    }
    for descending in (False, True):
        folder = tmp_path / str(descending)
        for name, (rows, schema) in given.items():
            ordered = spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions(schema.split()[0], ascending=not descending)
            ordered.write.parquet(f"{folder}/{name}.parquet")
        assert [r.y_crore for r in core.totals(spark, str(folder)).collect()] == [1000000001.07]
