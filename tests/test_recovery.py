"""Synthetic recovery: what is put into series, ramps and networks comes back out."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalake.functions import basis as B
from stratalake.functions import geometry as G
from stratalake.functions import phase as P
from stratalake.functions import ramps as R
from stratalake.functions.basis import Term
from stratalake.operators import algebra, constrained, correction, factor, iterate, masks, network, pairs, solve, spatial, stats, stencil, views

T0, DATES = 2007.0, [2007.0 + k / 12 for k in range(24)]


def series(spark, model, pixels=6, drop=()):
    rows = [(p, p // 3, p % 3, k, t, None if (p, k) in drop else float(model(p, t))) for p in range(pixels) for k, t in enumerate(DATES)]
    return spark.createDataFrame(rows, "pixel long, line long, col long, date int, dec double, disp double")


def test_decomposition_recovers_coefficients(spark):
    model = lambda p, t: 3 + p * (t - T0) + 2 * math.sin(2 * math.pi * (t - T0)) - 1.5 * math.cos(2 * math.pi * (t - T0)) + 4 * (t >= 2008) + 0.7 * math.log10(1 + max((t - 2008) / 0.3, 0))
    terms = B.terms(F.col("dec"), T0, seasonal=True, steps=[2008.0], postseismic_terms=[(2008.0, 0.3)])
    got = {r["pixel"]: r for r in solve.fit_pixels(series(spark, model), F.col("disp"), terms, 24, cond=1e-8).collect()}
    for p, r in got.items():
        assert [r[f"m_{t.name}"] for t in terms] == pytest.approx([3, p, 2, -1.5, 4, 0.7], abs=1e-5)
        assert r["s_linear"] == pytest.approx(0, abs=1e-4)


def test_a_sixth_of_the_dates_is_too_few(spark):
    keep = {0: 4, 1: 5}
    drop = {(p, k) for p, n in keep.items() for k in range(n, 24)}
    terms = B.terms(F.col("dec"), T0)
    got = {r["pixel"]: r["m_linear"] for r in solve.fit_pixels(series(spark, lambda p, t: t - T0, 2, drop), F.col("disp"), terms, 24).collect()}
    assert got[0] is None and got[1] == pytest.approx(1)


def test_rank_deficient_groups_get_the_minimum_norm_solution(spark):
    df = spark.createDataFrame([(1, float(x), 2.0 * x) for x in range(5)], "k int, x double, y double")
    row = solve.fit(df, F.col("y"), [Term("a", F.col("x")), Term("b", F.col("x"))], ["k"]).first()
    assert row["m_a"] == pytest.approx(1) and row["m_b"] == pytest.approx(1)


def test_constrained_fit_keeps_bounds_and_never_loses_to_a_feasible_start(spark):
    rng = np.random.default_rng(1)
    noise = {(p, t): rng.normal() for p in range(6) for t in DATES}
    df = series(spark, lambda p, t: (p - 3) * (t >= 2008) + noise[p, t])
    terms = B.terms(F.col("dec"), T0, steps=[2008.0], postseismic_terms=[(2008.0, 0.3)])
    for r in constrained.fit_constrained(df, F.col("disp"), terms, 24).collect():
        assert r["m_step_0"] * r["m_post_0"] >= -1e-9


def test_phase_constraint_holds(spark):
    season = lambda t: 2 * math.sin(2 * math.pi * (t - T0)) + math.cos(2 * math.pi * (t - T0))
    df = series(spark, lambda p, t: season(t) * (1 + 0.3 * p * (t - T0)))
    terms = B.terms(F.col("dec"), T0, seasonal=True, seasonal_increase=True)
    for r in constrained.fit_constrained(df, F.col("disp"), terms, 24).collect():
        assert r["m_increase_sin"] * r["m_seasonal_cos"] == pytest.approx(r["m_increase_cos"] * r["m_seasonal_sin"], abs=1e-6)
        assert r["m_increase_sin"] == pytest.approx(0.6 * r["pixel"], abs=1e-4)


def test_quantiles_of_rows_that_come_otherwise_each_time(spark, monkeypatch):
    """Values are of one evaluation: sums come in another order each time, which a function of chance stands in for."""
    monkeypatch.setattr(masks, "SORTED_VALUES", 50)
    df = spark.range(4000, numPartitions=3).select((F.floor(F.col("id") / 60) + 1e-9 * F.udf(lambda i: __import__("random").random(), "double").asNondeterministic()("id")).alias("value"))
    for _ in range(3):
        assert masks.quantiles(df, "value", (0.1, 0.8)) == pytest.approx([6, 53], abs=1e-6)
    cells = df.select(F.col("value").alias("sigma"), F.lit(1.0).alias("elev"), F.lit(1.0).alias("amp"), F.lit(0.5).alias("phi"))
    got = masks.clean_seasonal(cells, max_sigma_percent=80, min_elev=0, min_amp=0, max_amp=2)
    assert got.where("amp is not null").count() == 3200


@pytest.mark.parametrize("by", [["k"], ["k", "j"]])
def test_quantiles_of_large_groups(spark, monkeypatch, by):
    """Groups above and below the limit, one of them named null, one of equal values, by histograms as by sorting."""
    rng, held = np.random.default_rng(3), {}
    for k, n, values in ((1, 900, rng.normal(size=900)), (2, 40, rng.normal(size=40)), (None, 700, np.exp(4 * rng.normal(size=700))), (4, 300, np.full(300, 2.5)), (5, 500, np.round(rng.normal(size=500), 1))):
        held[k] = values
    rows = [(k, "a", float(v)) for k, values in held.items() for v in values] + [(1, "a", float("nan")), (2, "a", None)]
    df = spark.createDataFrame(rows, "k int, j string, value double").repartition(5)
    shares = (0.005, 0.5, 0.98)
    for limit in (1_000_000, 50, 3):
        monkeypatch.setattr(masks, "SORTED_VALUES", limit)
        got = masks.group_quantiles(df, "value", shares, by)
        assert {r["k"]: r["n"] for r in got.collect()} == {k: len(v) for k, v in held.items()}
        for r in got.collect():
            assert r["b"] == pytest.approx(np.quantile(held[r["k"]], shares).tolist(), rel=1e-12)
        assert {r["k"] for r in masks.group_quantiles(df, "value", shares, by, 600).collect()} == {1, None}


def test_reconstruction_shuffles_rows_of_pixels_and_not_of_dates(spark):
    rng = np.random.default_rng(8)
    maps = [(p, c, float(rng.normal())) for p in range(300) for c in range(4) if (p, c) != (7, 0) and p != 9] + [(3, 1, 2.0)]
    vectors = [(c, i, float(rng.normal())) for c in range(4) for i in range(64) if (c, i) != (2, 5)]
    want = {}
    for p, c, x in maps:
        for c2, i, v in vectors:
            if c == c2 and c in (0, 2):
                want[p, i] = want.get((p, i), 0.0) + x * v
    maps, vectors = spark.createDataFrame(maps, "pixel long, component int, value double"), spark.createDataFrame(vectors, "component int, idx int, value double")
    out = factor.reconstruct(maps, vectors, [0, 2])
    assert {(r["pixel"], r["idx"]): r["model"] for r in out.collect()} == pytest.approx(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "idx" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    assert factor.reconstruct(maps, vectors, []).count() == 0


def test_source_of_percentiles_is_evaluated_once(spark):
    """A stack's ramp and the offsets' median: the rows that they come from are counted as they are made."""
    for job in (lambda df: correction.stack_ramp(df), lambda df: algebra.correlation_to_displacement(df, "stack", "value", 2.0)):
        made = spark.sparkContext.accumulator(0)

        def count(batches, made=made):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        rows = spark.range(200).select((F.col("id") % 20).alias("line"), F.floor(F.col("id") / 20).alias("col"), F.sin("id").alias("stack"), F.cos("id").alias("value"))
        assert job(rows.mapInArrow(count, rows.schema)).count() == 200
        assert made.value == 200


def test_rescaled_maps_stay_where_they_are(spark):
    """Components are few: their ranges go to the maps, whatever Spark makes of the sizes."""
    maps = spark.range(1000).select((F.col("id") % 3).alias("component"), "id", F.lit(2.0).alias("value"))
    vectors = spark.createDataFrame([(c, float(c * i)) for c in range(3) for i in range(5)], "component long, value double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = algebra.rescale_components(maps, vectors)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r["component"], r["value"]) for r in out.collect()} == {(c, 8.0 * c) for c in range(3)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_lookup_of_points_by_brute_force(spark):
    rng = np.random.default_rng(4)
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1.2, (300, 2)))]
    lookup = [(i, j, j * 0.11, i * 0.07) for i in range(15) for j in range(12) if (i + j) % 3]
    got = spatial.geo_to_cell(spark.createDataFrame(points, "station long, lon double, lat double"), spark.createDataFrame(lookup, "line long, col long, lon double, lat double"), 0.02, 5)
    rows, want = {r["station"]: tuple(r[c] for c in ("line", "col", "step", "far")) for r in got.collect()}, {}
    for k, x, y in points:
        steps = [(max(1, math.ceil(max(abs(lon - x), abs(lat - y)) / 0.02)), i, j) for i, j, lon, lat in lookup]
        first = min(s for s, _, _ in steps)
        if first <= 5:
            i, j = (np.array([s[n] for s in steps if s[0] == first]) for n in (1, 2))
            want[k] = (np.median(i), np.median(j), first, bool(max(np.ptp(i), np.ptp(j)) > 5))
    assert rows == want and len(rows) > 200


@pytest.mark.parametrize("kinds", [["linear", "linear", "step", "post"], ["linear", "linear", "seasonal", "seasonal", "increase", "increase"], ["linear", "step", "seasonal", "seasonal", "increase", "increase", "post"]])
def test_constrained_fits_of_many_series_are_those_of_each(spark, monkeypatch, kinds):
    """Series of many lengths, some without a step's later dates, by few calls for all of them together."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for pixel in range(120):
        n = int(rng.integers(3, 40))
        a, b, sigma = rng.normal(size=(n, len(kinds))), 3 * rng.normal(size=n), rng.uniform(0.5, 2, n)
        if pixel % 9 == 0:
            a[:, kinds.index("step") if "step" in kinds else 0] = 0
        rows += [(pixel, float(y), float(s), *map(float, x)) for y, s, x in zip(b, sigma, a, strict=True)]
        if n > 4:
            want[pixel] = (a, b, sigma)
    names = [f"x{i}" for i in range(len(kinds))]
    df = spark.createDataFrame(rows, "pixel int, y double, s double, " + ", ".join(f"{n} double" for n in names)).repartition(2)
    terms = [Term(n, F.col(n), k) for n, k in zip(names, kinds, strict=True)]
    got = {r["pixel"]: r for r in constrained.fit_constrained(df, F.col("y"), terms, 24, sigma=F.col("s")).collect()}
    assert len(got) == 120 and {k for k, r in got.items() if r["m_x0"] is not None} == set(want)
    for pixel, (a, b, sigma) in want.items():
        order = np.lexsort(a.T[::-1])
        x = np.array([got[pixel][f"m_{n}"] for n in names])
        alone = constrained.constrained_series(a[order], b[order], sigma[order], kinds)
        cost = lambda x, a=a, b=b, sigma=sigma: (((a @ x - b) / sigma) ** 2).sum()
        assert cost(x) <= cost(alone) * (1 + 1e-6) + 1e-9
        if len(b) > 2 * len(kinds):
            assert x == pytest.approx(alone, abs=2e-3)
    calls = []
    monkeypatch.setattr(constrained, "same_phase", lambda *a: calls.append(1))
    big = rng.normal(size=(500, 30, len(kinds)))
    constrained.constrained_many(big, rng.normal(size=(500, 30)), np.ones((500, 30)), np.full(500, 30), kinds)
    assert not calls


def test_bounded_lsq_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.normal(size=(12, 4)), rng.normal(size=12)
        low, high = np.sort(rng.normal(size=(2, 4)), axis=0)
        x = constrained.bounded_lsq(a, b, low, high)
        g = a.T @ (a @ x - b)
        assert (x >= low - 1e-9).all() and (x <= high + 1e-9).all()
        assert (g[x <= low + 1e-9] >= -1e-6).all() and (g[x >= high - 1e-9] <= 1e-6).all()
        assert np.abs(g[(x > low + 1e-9) & (x < high - 1e-9)]).max(initial=0) < 1e-6


@pytest.mark.parametrize("flat", range(10))
def test_ramps_vanish(spark, flat):
    rows = [(1, i, j, float(i * j % 7), 0.0) for i in range(9) for j in range(8)]
    cells = spark.createDataFrame(rows, "date int, line int, col int, elev double, zero double")
    names = R.names(flat, 0, 0, elevation=True)
    value = R.apply({n: F.lit(0.5 + 0.1 * k) for k, n in enumerate(names)}, F.col("col"), F.col("line"), F.col("elev"))
    cells = cells.withColumn("value", value)
    fitted = correction.fit_ramps(cells, ["date"], flat, elevation=True)
    rest = correction.remove_ramps(cells, fitted, ["date"], elevation=True)
    assert rest.agg(F.max(F.abs("value"))).first()[0] < 1e-4


def test_network_gives_dates_back(spark):
    truth = {1: 0.0, 2: 1.5, 3: -2.0, 4: 7.0, 8: 0.0, 9: 3.0}
    edges = [(1, 2), (1, 3), (2, 3), (3, 4), (2, 4), (8, 9), (1, 2)]
    df = spark.createDataFrame([(a, b, truth[b] - truth[a]) for a, b in edges], "date1 int, date2 int, v double")
    got = {r["date"]: (r["value"], r["part"]) for r in network.invert(df, "v").collect()}
    assert {d: v for d, (v, _) in got.items()} == pytest.approx(truth, abs=1e-9)
    assert {d: p for d, (_, p) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


@pytest.mark.parametrize(("sign", "pin", "non_negative"), [((-1, 1), True, False), ((-1, 1), False, False), ((1, 1), False, True)])
def test_large_networks_are_solved_where_their_entries_are(spark, monkeypatch, sign, pin, non_negative):
    """The same network by the driver's matrix and by iterations, with two parts, repeated pairs and weights."""
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a in range(40) for b in rng.choice(40, 4) if a < b] + [(100, 101), (101, 102), (100, 101)]
    df = spark.createDataFrame([(a, b, float(rng.normal()), float(rng.uniform(0.5, 2))) for a, b in edges], "date1 int, date2 int, v double, s double")
    solved = []
    for limit in (1500, 0):
        monkeypatch.setattr(network, "DENSE_DATES", limit)
        solved.append({r["date"]: (r["value"], r["part"]) for r in network.invert(df, "v", F.col("s"), sign, pin, non_negative).collect()})
    assert {d: p for d, (_, p) in solved[0].items()} == {d: p for d, (_, p) in solved[1].items()}
    assert max(abs(solved[0][d][0] - solved[1][d][0]) for d in solved[0]) < 1e-6
    empty = network.invert(spark.createDataFrame([], "date1 int, date2 int, v double"), "v")
    assert empty.columns == ["date", "value", "part"] and empty.count() == 0


@pytest.mark.parametrize("values", [list(range(1000)), [5.0] * 50, [0.0] * 30 + [1e9], [None, float("nan"), 3.0], []])
def test_quantiles_of_a_whole_map(spark, monkeypatch, values):
    monkeypatch.setattr(masks, "SORTED_VALUES", 3)
    monkeypatch.setattr(masks, "HISTOGRAM_BINS", 8)
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "value double").repartition(3)
    good = [float(v) for v in values if v is not None and v == v]
    for shares in ((0.02, 0.5, 0.98), (0.0, 1.0), (0.333,)):
        got = masks.quantiles(df, "value", shares)
        assert got == (pytest.approx([float(np.quantile(good, s)) for s in shares], rel=1e-12) if good else [None] * len(shares))


def test_growing_windows_look_further_only_where_they_must(spark):
    rng = np.random.default_rng(4)
    cells = [(int(i), int(j), float(rng.normal()), ) for i, j in {tuple(x) for x in rng.integers(0, 400, (60, 2)).tolist()}] + [(5, 5, None)]
    points = [(k, int(i), int(j)) for k, (i, j) in enumerate(rng.integers(-20, 420, (40, 2)).tolist())] + [(99, 5000, 5000)]
    sizes = [2, 4, 6, 8, 20, 50, 100, 198]
    got = {r["station"]: (r["size"], r["mean"], r["n"]) for r in spatial.growing_lookup(spark.createDataFrame(points, "station int, line int, col int"), spark.createDataFrame(cells, "line int, col int, value double"), sizes).collect()}
    want = {}
    for k, i, j in points:
        held = [(max(abs(a - i), abs(b - j)), v) for a, b, v in cells if v is not None]
        for s in sizes:
            if inside := [v for d, v in held if d <= s]:
                want[k] = (s, pytest.approx(sum(inside) / len(inside)), len(inside))
                break
    assert got == want and {s for s, _, _ in got.values()} > {20, 50} and 99 not in got


def test_interpolation_over_ranges(spark):
    rng = np.random.default_rng(6)
    t, v = np.sort(rng.uniform(0, 100, 300)), rng.normal(size=300)
    axis = np.concatenate([rng.uniform(-20, 120, 500), t[:40]])
    got = spatial.interpolate_onto(spark.createDataFrame([(float(x),) for x in axis], "t double").repartition(5), spark.createDataFrame(list(zip(t.tolist(), v.tolist(), strict=True)), "t double, value double").repartition(3))
    rows = sorted((r["t"], r["value"]) for r in got.collect())
    assert [x for x, _ in rows] == sorted(axis.tolist()) and [y for _, y in rows] == pytest.approx(np.interp(np.sort(axis), t, v).tolist(), abs=1e-9)


def test_truncated_solution_is_that_of_the_singular_values(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 3)) @ np.diag([5.0, 1.0, 0.01])
    y = rng.normal(size=30)
    df = spark.createDataFrame([(1, *map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "k int, a double, b double, c double, y double")
    terms = [Term(n, F.col(n)) for n in "abc"]
    for cond in (1e-6, 0.5, 10.0, 1e3):
        row = solve.fit_truncated(df, F.col("y"), terms, ["k"], cond).first()
        u, s, v = np.linalg.svd(x, full_matrices=False)
        keep = s >= cond
        assert [row[f"m_{n}"] for n in "abc"] == pytest.approx((v[keep].T @ ((u[:, keep].T @ y) / s[keep])).tolist(), abs=1e-8)


def test_variance_split_is_not_negative(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(6) for j in range(i + 1, 6)], "date1 int, date2 int, v double")
    assert min(r["value"] for r in network.invert(df, "v", sign=(1, 1), pin=False, non_negative=True).collect()) >= 0


def test_views_give_components_back(spark):
    rows = [(p, f, look, head) for p in range(4) for f, look, head in (("A", 34.0, -168.0), ("D", 39.0, -12.0), ("E", 30.0, -10.0)) if not (p == 3 and f != "A")]
    df = spark.createDataFrame(rows, "pixel int, frame string, look double, heading double")
    e, n, u = G.los_vector(F.col("look"), F.col("heading"))
    df = df.withColumn("los", (F.col("pixel") * e + 2 * u)).withColumn("sigma", F.lit(0.5))
    got = {r["pixel"]: r for r in views.decompose_los(df, (1, 3), vector=(e, n, u)).collect()}
    assert got[2]["east"] == pytest.approx(2) and got[2]["up"] == pytest.approx(2) and got[3]["east"] is None


def test_joint_tie_recovers_frame_planes(spark):
    truth = {"A": (1.0, -2.0, 0.5), "D": (0.3, 0.7, -1.0)}
    view = {"A": (0.6, 0.1, 0.79), "D": (-0.55, 0.1, 0.83)}
    rng = np.random.default_rng(5)
    where = rng.uniform(size=(40, 2))
    motion = rng.normal(size=(40, 2))
    rows = [(p, f, *map(float, where[p]), float(view[f][0] * motion[p, 0] + view[f][2] * motion[p, 1] + truth[f][0] * where[p, 0] + truth[f][1] * where[p, 1] + truth[f][2]), 1.0, *view[f]) for p in range(40) for f in truth]
    points = spark.createDataFrame(rows, "point int, frame string, x double, y double, los double, sigma double, e double, n double, u double")
    stations = spark.createDataFrame([(p, float(motion[p, 0]), 0.0, float(motion[p, 1])) for p in range(12)], "point int, ve double, vn double, vu double")
    got = {r["frame"]: (r["a"], r["b"], r["c"]) for r in views.tie_frames(points, stations).collect()}
    for f, plane in truth.items():
        assert got[f] == pytest.approx(plane, abs=1e-6)


def test_principal_components_rebuild_low_rank_series(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 10))
    x -= x.mean(axis=0)
    wide = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(99, [None] * 10)], "pixel int, disp array<double>")
    maps, vectors = factor.pca(wide, 2)
    got = {(r["pixel"], r["idx"]): r["model"] for r in factor.reconstruct(maps, vectors, [0, 1]).collect()}
    assert max(abs(got[i, j] - x[i, j]) for i in range(60) for j in range(10)) < 1e-8 and (99, 0) not in got


def test_independent_components_separate_sources(spark):
    rng = np.random.default_rng(4)
    s = np.stack([rng.uniform(-1, 1, 2000), rng.laplace(size=2000)], axis=1)
    x = s @ np.array([[1.0, 0.5, 0.2], [0.3, -1.0, 0.8]])
    wide = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pixel int, disp array<double>")
    maps, _ = factor.ica(wide, 2)
    found = np.zeros((2000, 2))
    for r in maps.collect():
        found[r["pixel"], r["component"]] = r["value"]
    c = np.abs(np.corrcoef(found.T, s.T)[:2, 2:])
    assert c.max(axis=1).min() > 0.97


def test_alternation_separates_ramps_from_trends(spark):
    df = series(spark, lambda p, t: 2 * (t - T0) + (p // 3) * 0.5 * math.sin(9 * t) + (p % 3) * 0.2, 9)
    done = iterate.alternate(df, B.terms(F.col("dec"), T0), 24, 2, 3)
    assert done.weights.agg(F.max("sigma")).first()[0] < 1.0
    assert done.coefficients.count() == 9


@given(st.lists(st.floats(-1e4, 1e4), min_size=1, max_size=20), st.floats(0.1, 10))
@settings(max_examples=15, deadline=None)
def test_wrap_stays_in_range(spark, values, half):
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", P.wrap(F.col("x"), half).alias("w"))
    for r in df.collect():
        assert -half - 1e-6 <= r["w"] <= half + 1e-6
        turns = (r["x"] - r["w"]) / (2 * half)
        assert turns == pytest.approx(round(turns), abs=1e-6)


def test_reference_date_is_zero_and_missing_stays_missing(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, None), (1, 4, float("nan")), (2, 2, 7.0)], "pixel int, date int, disp double")
    got = {(r["pixel"], r["date"]): r["disp"] for r in masks.reference_in_time(df, 1).collect()}
    assert got == {(1, 1): 0.0, (1, 2): None, (1, 3): None, (1, 4): None, (2, 2): 7.0}


def test_lowpass_of_a_constant_is_the_constant_with_holes(spark):
    rows = [(i, j, None if (i + j) % 3 == 0 else 4.0) for i in range(7) for j in range(5)]
    got = stencil.lowpass(spark.createDataFrame(rows, "line long, col long, value double"), 1.5, 7, 5).collect()
    assert len(got) == 35 and all(r["smooth"] == pytest.approx(4.0) for r in got)


def test_interpolation_holds_ends(spark):
    samples = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "t double, value double")
    axis = spark.createDataFrame([(0.0,), (1.0,), (1.25,), (2.0,), (3.0,)], "t double")
    assert [r["value"] for r in spatial.interpolate_onto(axis, samples).orderBy("t").collect()] == pytest.approx([10, 10, 12.5, 20, 20])


def test_utm_of_known_places(spark):
    # The origin; the edge of a zone on the equator; the meridian arc to 45 degrees, times the scale.
    df = spark.createDataFrame([(3.0, 0.0), (6.0, 0.0), (3.0, 45.0)], "lon double, lat double")
    e, n = G.utm(F.col("lon"), F.col("lat"), 31)
    got = [(r["e"], r["n"]) for r in df.select(e.alias("e"), n.alias("n")).collect()]
    assert got[0] == pytest.approx((500000, 0), abs=1e-3)
    assert got[1] == pytest.approx((833978.557, 0), abs=1e-2)
    assert got[2] == pytest.approx((500000, 0.9996 * 4984944.378), abs=1e-2)


def test_decimal_years_of_a_published_list(spark):
    from stratalake.functions import dates

    df = spark.createDataFrame([(20070218, 2007.1342098055327), (20080106, 2008.0164338537386), (20090108, 2009.021911804985)], "d int, dec double")
    for r in df.select("dec", dates.decimal_year(dates.from_yyyymmdd(F.col("d"))).alias("x")).collect():
        assert r["x"] == pytest.approx(r["dec"], abs=1e-9)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "date1 int, date2 int, line long, col long, phase double")
    assert pairs.coverage(empty).count() == 0 and stats.stack_pairs(empty).count() == 0
    assert stats.binned_trimmed(spark.createDataFrame([], "x double, y double"), "x", "y").count() == 0
    assert network.invert(spark.createDataFrame([], "date1 int, date2 int, v double"), "v").count() == 0
