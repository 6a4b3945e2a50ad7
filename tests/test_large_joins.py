"""Joins of tables that grow with the input: by shuffle, through no driver, and with few rows made on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import autocorr, geometry, permute, voronoi, weights


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((300, 2)) * 10)], "obs_id long, x double, y double")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_and_holders_are_not_broadcast(points):
    """sizes of stored and exploded tables are thought small, so they were sent to the driver."""
    assert points.count() * 24 < 10 << 20  # so the planner would broadcast them
    box = (-1.0, -1.0, 11.0, 11.0)
    cells = voronoi.thiessen(points, box, few=0)
    spots = points.select(F.col("obs_id").alias("key"), "x", "y")
    start = voronoi.cells(points, box, few=0)
    for df in (cells, voronoi.holders(spots, cells), voronoi._searched(start, points, 1.0), voronoi._met(start, points, 1.0)):
        assert "Broadcast" not in _plan(df)


def test_a_long_strip_of_polygons_has_small_cells(spark, monkeypatch):
    """polygons of unit size in a strip of 1 x 900 were dealt into cells of 30 x 30, where each point met 30 of them."""
    squares = spark.range(900).select(F.col("id").alias("obs_id"), geometry.rectangle(F.lit(0.0), F.col("id").cast("double"), F.lit(1.0), F.col("id") + 1.0).alias("geom"))
    spots = spark.range(900).select(F.col("id").alias("key"), F.lit(0.5).alias("x"), (F.col("id") + 0.5).alias("y"))
    found = voronoi.holders(spots, squares)
    assert {(r.key, r.obs_id) for r in found.collect()} == {(i, i) for i in range(900)}
    places = [float(s) for s in __import__("re").findall(r"FLOOR\(\(py#\d+ / ([\d.]+)\)\)", _plan(found), 2)]
    assert places and max(places) < 2


def test_nearest_neighbours_of_both_kinds(points):
    """F6 to F8: candidates come as arrays by cell, with no window over pairs; fuller cells meet in pairs, with the same result."""
    flat = points.select("obs_id", "x", "y")
    tops = weights._from_arrays(flat, flat, 6, 1.0, weights.PLANE, lambda gap: gap, 1.0)
    assert "Window" not in _plan(tops) and "Broadcast" not in _plan(tops)
    one, two = ({(r.src, r.dst): r.w for r in weights._nearest(flat, 6, weights.PLANE, lambda gap: gap, 2.0, held=h).collect()} for h in (weights.HELD, 0))
    assert len(one) == 6 * 300 and one == two
    ends = {r.obs_id: (r.x, r.y) for r in flat.collect()}
    for i in range(0, 300, 50):
        want = sorted((np.hypot(x - ends[i][0], y - ends[i][1]), j) for j, (x, y) in ends.items() if j != i)[:6]
        assert {j for _, j in want} == {d for s, d in one if s == i}


def test_bands_are_not_broadcast(points):
    """one side of the join stood in every task's memory as a whole."""
    assert "Broadcast" not in _plan(weights.distance_band(points, 1.2)) and "Broadcast" not in _plan(weights.arc_band(points, 50.0))


def test_means_of_permutations_are_not_shuffled(spark, monkeypatch):
    """rows got the means of all permutations, 4 kB each, and were then shuffled and sorted by key. Both forms of the join, one result."""
    rng = np.random.default_rng(9)
    obs = spark.createDataFrame([(i, float(v), int(i % 4), float(s)) for i, (v, s) in enumerate(rng.normal(size=(200, 2)))], "id long, v double, k long, stat double")
    tests = {"p": (F.lit(0.0), F.col("v"), F.col("stat"))}
    found, top = [], []
    for most in (permute.BROADCAST_BYTES, 0):
        monkeypatch.setattr(permute, "BROADCAST_BYTES", most)
        df = permute.conditional_p(obs, "id", "v", tests, 99)
        found.append({r.id: r.p for r in df.collect()})
        top.append(_plan(df).split("== Initial Plan ==")[-1].splitlines())
    assert len(found[0]) == 200 and found[0] == found[1]
    for lines, kind, on in zip(top, ("BroadcastHashJoin", "SortMergeJoin"), ("[k#", "_copy#"), strict=True):
        at = next(i for i, line in enumerate(lines) if "Join" in line)
        assert kind in lines[at] and on in lines[at] and not any("Exchange" in line or "Sort" in line for line in lines[:at])


def test_values_and_lags_are_not_broadcast(spark, points, tmp_path):
    """at 60 times sf0.1 the driver had no memory to broadcast the values that meet their neighbours."""
    points.withColumn("v", F.col("x") * F.col("y")).write.parquet(str(tmp_path / "points"))
    df = spark.read.parquet(str(tmp_path / "points"))
    w = df.select(F.col("obs_id").alias("src"), ((F.col("obs_id") + 1) % 300).alias("dst"))
    for found in (autocorr.lisa(df, w, "obs_id", "v"), autocorr.getis_ord(df, w, "obs_id", "v")):
        assert "BroadcastHashJoin" not in _plan(found)


def test_pairs_of_few_full_cells_are_dealt_to_many_tasks(spark, monkeypatch):
    """points in a few cells were few bytes, so one task compared all pairs."""
    rng = np.random.default_rng(1)
    at = rng.random((240, 2)) * 0.6
    at[7] = at[8]
    dense = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "obs_id long, x double, y double")
    want = {(i, j) for i in range(240) for j in range(240) if i != j and np.hypot(*(at[i] - at[j])) <= 0.25}
    monkeypatch.setattr(weights, "PAIRS", 1000)
    found = weights.distance_band(dense, 0.25)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == len(want) and {(r.src, r.dst) for r in rows} == want
    by_task = np.bincount([r.task for r in rows])
    assert (by_task > 0).sum() > 50 and by_task.max() < len(rows) / 10
    assert _plan(found).count("Exchange") == 2
    degrees = dense.withColumns({"x": F.col("x") * 10, "y": F.col("y") * 10})
    many = {(r.src, r.dst): r.w for r in weights.arc_band(degrees, 150.0).collect()}
    monkeypatch.setattr(weights, "PAIRS", 1 << 40)
    assert many and many == {(r.src, r.dst): r.w for r in weights.arc_band(degrees, 150.0).collect()}
    assert weights.distance_band(dense.limit(0), 0.25).count() == 0
