"""Worked examples, edge cases and properties on small hand-made tables."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arealis.functions import calc, stats
from arealis.operators import autocorr, breaks, classify, explore, geometry, rank, rates, regression, select, tables, voronoi, weights


def frame(spark, values, schema="obs_id long, v double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], schema)


def test_hazen_example(spark):
    got = rank.hazen(frame(spark, [15.0, 20.0, 35.0, 40.0, 50.0]), "v", "obs_id", [1.0, 10.0, 11.0, 50.0, 89.0, 90.0, 99.0]).first()
    assert list(got) == pytest.approx([15, 15, 15.25, 35, 49.5, 50, 50])


def test_getis_example(spark):
    points = spark.createDataFrame([(0, 2.0, 10.0, 10.0), (1, 3.0, 20.0, 10.0), (2, 3.2, 40.0, 10.0), (3, 5.0, 15.0, 20.0), (4, 8.0, 30.0, 20.0), (5, 7.0, 30.0, 30.0)], "obs_id long, v double, x double, y double")
    got = autocorr.getis_ord(points.select("obs_id", "v"), weights.distance_band(points, 15.0), "obs_id", "v").orderBy("obs_id").collect()
    assert [r["g"] for r in got] == pytest.approx([0.152671756, 0.198412698, 0.32, 0.186781609, 0.225247525, 0.377358491], abs=1e-8)
    assert [r["z_g"] for r in got] == pytest.approx([-0.620745338, -0.017806119, 1.31558703, -0.128241714, 0.288434965, 1.77833941], abs=1e-6)


def test_domain_errors_are_null(spark):
    df = spark.createDataFrame([(0.0, -8.0)], "x double, y double")
    got = df.select(calc.invert("x"), calc.square_root("y"), calc.log_natural("x"), calc.log_ten("y"), calc.divide("y", "x"), calc.power("x", F.lit(-1)), calc.power("y", F.lit(0.5)), calc.power("y", F.lit(3))).first()
    assert list(got)[:7] == [None] * 7 and got[7] == -512


def test_whole_column_operations_need_every_value(spark):
    df = frame(spark, [1.0, None, 3.0])
    assert {r.r for r in calc.standardize(df, "v", "r").collect()} == {None}
    assert {r.r for r in calc.standardize(frame(spark, [2.0, 2.0]), "v", "r").collect()} == {0.0}


def test_isolates_and_missing_neighbours(spark):
    w = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src long, dst long")
    df = frame(spark, [1.0, 2.0, None, 4.0])
    strict = {r.obs_id: r.lag for r in autocorr.lag(df, w, "obs_id", "v", "lag").collect()}
    assert strict == {0: 2.0, 1: None, 2: 2.0, 3: None}
    full = autocorr.lisa(frame(spark, [1.0, 2.0, 3.0, 4.0]), w, "obs_id", "v").where("obs_id = 3").first()
    assert full["lag"] == 0 and full["cluster"] == 5
    r = spark.createDataFrame([(i, 1.0, 2.0) for i in range(4)], "obs_id long, e double, p double")
    assert rates.spatial_rate(r, w, "obs_id", "e", "p", "r").where("obs_id = 3").first()["r"] is None
    assert rates.spatial_empirical_bayes(r, w, "obs_id", "e", "p", "r").where("obs_id = 3").first()["r"] is None


def test_a_bad_base_aborts_rates(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 0.0)], "obs_id long, e double, p double")
    assert {r.r for r in rates.raw_rate(df, "e", "p", "r").collect()} == {None}


def test_hinges_for_each_parity(spark):
    want = {4: (1.5, 2.5, 3.5), 5: (2, 3, 4), 6: (2, 3.5, 5), 7: (2.5, 4, 5.5)}
    for n, (q1, q2, q3) in want.items():
        h = rank.hinges(frame(spark, [float(i) for i in range(1, n + 1)]), "v", "obs_id").first()
        assert (h["q1"], h["q2"], h["q3"]) == (q1, q2, q3)


def test_unique_values_fall_back_to_natural_breaks(spark):
    assert classify.unique_values(frame(spark, [float(i) for i in range(10)]), "v").agg(F.max("cat")).first()[0] == 10
    assert classify.unique_values(frame(spark, [float(i) for i in range(11)]), "v").agg(F.countDistinct("cat")).first()[0] == 10


def test_natural_breaks_find_the_groups():
    assert breaks.best_breaks(np.array([1.0, 2, 10, 11, 30]), np.ones(5), 3) == [10.0, 30.0]


def test_constant_data(spark):
    df = frame(spark, [5.0] * 4)
    assert [r["n"] for r in explore.histogram(df, "v").collect()] == [4]
    assert {r["cat"] for r in classify.equal_intervals(df, "v", 4).collect()} == {1}


def test_merge_constraints(spark):
    a = spark.createDataFrame([("x ", 1), ("y", 2)], "k string, v int")
    assert tables.merge_by_key(a, spark.createDataFrame([("x", 5), ("y", 6)], "k string, w int"), "k", "k").count() == 2
    for bad in ([("x", 5), ("x", 6)], [("x", 5), ("z", 6)]):
        with pytest.raises(ValueError):
            tables.merge_by_key(a, spark.createDataFrame(bad, "k string, w int"), "k", "k")
    with pytest.raises(ValueError):
        tables.merge_by_key(a, spark.createDataFrame([(1, 5)], "k int, w int"), "k", "k")
    assert tables.distinct_names(["A", "b"], ["a", "c"]) == {"a": "a (1)", "c": "c"}


def test_coincident_points_and_arcs(spark):
    pts = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.5, 1.0)], "obs_id long, x double, y double")
    w = {(r.src, r.dst): r.w for r in weights.distance_band(pts, 2.0).collect()}
    assert w[0, 1] == pytest.approx(2e-6) and w[0, 2] == 0.5
    assert pts.select(weights.arc_miles(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("d")).agg(F.max("d")).first()[0] == 0


def test_knn_is_not_symmetric_but_its_union_is(spark):
    pts = spark.createDataFrame([(i, float(i * i), 0.0) for i in range(6)], "obs_id long, x double, y double")
    near = weights.knn(pts, 1)
    assert near.count() == 6 and not weights.is_symmetric(near)
    assert weights.is_symmetric(weights.symmetrise(near.select("src", "dst")))


def test_donut(spark):
    outer = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5)]
    row = (0, {"type": 5, "parts": [0, 5], "points": [{"x": x, "y": y} for x, y in outer + hole]})
    got = spark.createDataFrame([row], f"obs_id long, geom {geometry.GEOM}").select(*[c.alias(f"a_{k}") for k, c in geometry.centroid().items()], *[c.alias(f"f_{k}") for k, c in geometry.centroid(full=True).items()], *[c.alias(k) for k, c in geometry.area_perimeter().items()]).first()
    assert (got["a_xcntrd"], got["area"], got["perimeter"]) == (2.0, 15.0, 20.0)
    assert got["f_xcntrd"] == pytest.approx((32 - 1) / 15)
    assert geometry.nesting([outer, hole]) == [0, 1]
    assert [geometry.ring_area(r) < 0 for r in geometry.orient([outer[::-1], hole[::-1]])] == [True, False]


def test_voronoi_cells_fill_the_box(spark):
    pts = spark.createDataFrame([(i, math.sin(i * 7) * 3, math.cos(i * 5) * 3) for i in range(30)], "obs_id long, x double, y double")
    cells = voronoi.thiessen(pts, (-4.0, -4.0, 4.0, 4.0)).withColumns(geometry.area_perimeter())
    assert cells.agg(F.sum("area")).first()[0] == pytest.approx(64)
    with pytest.raises(ValueError):
        voronoi.thiessen(pts.unionAll(pts.limit(1)), (-4.0, -4.0, 4.0, 4.0))


def test_selection_of_toggles_and_neighbours(spark):
    df = select.everything(frame(spark, [1.0, 2.0, None]), False)
    assert [r.selected for r in select.toggle(df, F.col("v") > 1).orderBy("obs_id").collect()] == [False, True, False]
    assert [r.selected for r in select.undefined(df, "v").orderBy("obs_id").collect()] == [False, False, True]


def test_cartogram_keeps_circles_apart():
    at = explore.cartogram([(0, 0, 1), (0.1, 0, 1), (5, 0, 1)], [(0, 1), (1, 2)], 400)
    assert min(np.hypot(*(at[i] - at[j])) for i, j in ((0, 1), (1, 2), (0, 2))) > 1.9


@settings(max_examples=60, deadline=None)
@given(st.floats(-1e6, 1e6), st.floats(0.001, 1e6))
def test_axis_ticks_cover_the_range(low, span):
    ticks = explore.axis_ticks(low, low + span)
    assert ticks[0] <= low + 1e-6 * span and ticks[-1] >= low + span - 1e-6 * span and 2 <= len(ticks) <= 13


def test_distribution_tails():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.f_tail(3.0, 2, 20) == pytest.approx(0.07253815, abs=1e-6)
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(0.5, 4) == pytest.approx(0.97350098, abs=1e-7)


@pytest.fixture(scope="module")
def lattice(spark):
    n = 7
    rng = np.random.default_rng(5)
    w = np.zeros((n * n, n * n))
    for i in range(n * n):
        for j in range(n * n):
            if abs(i % n - j % n) + abs(i // n - j // n) == 1:
                w[i, j] = 1
    ws = w / w.sum(1, keepdims=True)
    x = rng.normal(size=n * n)
    y = np.linalg.solve(np.eye(n * n) - 0.5 * ws, 1 + 2 * x + rng.normal(size=n * n) * 0.3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "obs_id long, x double, y double")
    pairs = spark.createDataFrame([(i, j) for i in range(n * n) for j in range(n * n) if w[i, j]], "src long, dst long")
    return df, pairs, ws, x, y


def test_ols_against_numpy(lattice):
    df, w, ws, x, y = lattice
    fit = regression.ols(df, "y", ["x"], w)
    design = np.column_stack([np.ones_like(x), x])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    e = y - design @ beta
    s2 = rss[0] / len(y)
    assert fit.coef == pytest.approx(beta)
    assert fit.fit["moran_residuals"] == pytest.approx(e @ ws @ e / (e @ e))
    t = np.trace(ws.T @ ws + ws @ ws)
    m = np.eye(len(y)) - design @ np.linalg.inv(design.T @ design) @ design.T
    wxb = ws @ design @ beta
    info = wxb @ m @ wxb / s2 + t
    assert fit.tests["lm_error"][0] == pytest.approx((e @ ws @ e / s2) ** 2 / t)
    assert fit.tests["lm_lag"][0] == pytest.approx((e @ ws @ y / s2) ** 2 / info)
    k, n = 2, len(y)
    mean = np.trace(m @ ws) / (n - k)
    var = (np.trace(m @ ws @ m @ ws.T) + np.trace(m @ ws @ m @ ws) + np.trace(m @ ws) ** 2) / ((n - k) * (n - k + 2)) - mean**2
    assert fit.tests["moran_z"][0] == pytest.approx((e @ ws @ e / (e @ e) - mean) / math.sqrt(var))


def test_spatial_models_find_the_maximum(lattice):
    df, w, ws, x, y = lattice
    fit = regression.spatial_lag(df, "y", ["x"], w)
    design = np.column_stack([np.ones_like(x), x])

    def log_l(rho):
        a = np.eye(len(y)) - rho * ws
        b = np.linalg.lstsq(design, a @ y, rcond=None)[0]
        s2 = ((a @ y - design @ b) ** 2).mean()
        return -len(y) / 2 * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(a)[1]

    assert fit.fit["log_likelihood"] == pytest.approx(log_l(fit.spatial))
    assert all(log_l(fit.spatial) >= log_l(fit.spatial + d) for d in (-1e-3, 1e-3))
    error = regression.spatial_error(df, "y", ["x"], w)
    assert error.fit["log_likelihood"] >= regression.ols(df, "y", ["x"]).fit["log_likelihood"]
    assert "LAMBDA" in error.text()
    saved = regression.save_lag(df, "y", ["x"], w, fit).orderBy("obs_id").toPandas()
    want = np.linalg.solve(np.eye(len(y)) - fit.spatial * ws, design @ fit.coef[:2])
    assert saved["LAG_PREDIC"].to_numpy() == pytest.approx(want, abs=1e-6)


def test_natural_breaks_are_exact_on_many_values(spark):
    rng = np.random.default_rng(3)
    values = np.unique(np.round(rng.gamma(1.2, 50, 2600), 4))
    assert len(values) > 2000
    n = np.arange(len(values) + 1.0)
    s, q = (np.concatenate([[0.0], np.cumsum(c)]) for c in (values, values * values))
    best = np.where(n > 0, q - s * s / np.maximum(n, 1), 0)
    for _ in range(3):
        best = np.array([0.0] + [min(best[i] + q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i) for i in range(j)) for j in range(1, len(values) + 1)])
    got = classify.natural_breaks(frame(spark, [float(v) for v in values]), "v", 4).groupBy("cat").agg((F.var_pop("v") * F.count("v")).alias("w")).agg(F.sum("w")).first()[0]
    assert got == pytest.approx(best[-1], rel=1e-9)


def test_thiessen_cells_outside_the_box_are_empty(spark):
    points = spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(400)], "obs_id long, x double, y double")
    got = voronoi.thiessen(points, (-1.0, -1.0, 11.0, 11.0)).withColumns(geometry.area_perimeter()).agg(F.count("obs_id"), F.sum("area"), F.sum((F.col("area") == 0).cast("int"))).first()
    assert got[0] == 400 and got[1] == pytest.approx(144) and got[2] > 200
    whole = voronoi.thiessen(points, geometry.extent(points, 1.0)).withColumns(geometry.area_perimeter()).agg(F.min("area"), F.sum("area")).first()
    assert whole[0] > 0 and whole[1] == pytest.approx(11 * 41)


def test_arc_band_over_dateline_and_pole(spark):
    rng = np.random.default_rng(5)
    at = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 180, 150), rng.uniform(-90, 90, 150), strict=True)] + [(179.5, 0.0), (-179.5, 0.0), (10.0, 89.5), (-170.0, 89.5), (10.0, 89.5)]
    got = {(r.src, r.dst) for r in weights.arc_band(spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "obs_id long, x double, y double"), 400.0).collect()}
    lon, lat = np.radians(at).T
    d = 3959.0 * np.arccos(np.clip(np.sin(lat)[:, None] * np.sin(lat) + np.cos(lat)[:, None] * np.cos(lat) * np.cos(lon[:, None] - lon), -1, 1))
    assert got == {(i, j) for i in range(len(at)) for j in range(len(at)) if i != j and d[i, j] <= 400} and {(150, 151), (152, 153), (152, 154)} <= got


def test_arc_neighbours(spark):
    """Across the dateline, at a pole, at one place, in a crowd far from the rest; against all pairs."""
    rng = random.Random(5)
    spots = [(179.9, 0.0), (-179.9, 0.0), (180.0, 0.1), (-180.0, 0.1), (12.0, 90.0), (-100.0, 90.0), (50.0, 89.9), (7.0, -90.0), (10.0, 10.0), (10.0, 10.0), (370.0, 10.0)]
    spots += [(40 + rng.random() * 1e-3, 20 + rng.random() * 1e-3) for _ in range(150)] + [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "obs_id long, x double, y double")

    def unit(x, y):
        lon, lat = math.radians(0 if abs(y) == 90 else x), math.radians(y)
        flat = 0.0 if abs(y) == 90 else math.cos(lat)
        return flat * math.cos(lon), flat * math.sin(lon), math.sin(lat)

    units = [unit(*p) for p in spots]
    miles = lambda a, b: round(2 * 3959 * math.asin(min(1.0, math.dist(a, b) / 2)), 6)
    got = {}
    for r in weights.arc_knn(points, 3).collect():
        got.setdefault(r.src, []).append((r.w, r.dst))
    for i, u in enumerate(units):
        want = sorted((miles(u, v), j) for j, v in enumerate(units) if j != i)[:3]
        assert [w for w, _ in sorted(got[i])] == pytest.approx([w for w, _ in want], abs=2e-6)
    assert {d for _, d in got[8]} >= {9, 10} and sorted(got[4])[0] == (0.0, 5)
    assert {d for w, d in got[2] if w == 0} == {3}
