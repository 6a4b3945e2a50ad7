"""Kernel lags of a distance band without its pairs: the same as by joining them, with shuffles in proportion to the points."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import autocorr, bands, weights
from arealis.plans import catalog

SCHEMA = "id string, x double, y double, v double"


def _obs(spark, at, values=None):
    values = at[:, 1] if values is None else values
    return spark.createDataFrame([(f"p{i}", float(x), float(y), None if v is None else float(v)) for i, ((x, y), v) in enumerate(zip(at, values, strict=True))], SCHEMA)


def _lags(df):
    rows = df.collect()
    found = {r.id: r.lag for r in rows}
    assert len(found) == len(rows)
    return found


def _by_pairs(df, reach):
    return _lags(autocorr.lag_kernel(df, weights.distance_band(df.withColumnRenamed("id", "obs_id"), reach), "id", "v", "lag"))


def _places():
    rng = np.random.default_rng(5)
    one = rng.normal(size=(400, 2))
    return {
        "dense": one * 0.126,
        "sparse": one * 30,
        "ties": np.round(one * 0.3, 1),  # many pairs are just as far apart as the band is wide
        "coincident": np.repeat(one[:20] * 0.1, 20, axis=0),
        "far off": np.concatenate([one[:380] * 0.1, [[1e9, -1e9]] * 3, one[:17] * 1e-3 + 1e6]),
    }


@pytest.mark.parametrize("name", _places())
def test_lags_are_those_of_the_pairs(spark, monkeypatch, name):
    """Cells in one group, and dealt into many, with NULL among the values."""
    at = _places()[name]
    df = _obs(spark, at, [None if i % 11 == 3 else y for i, y in enumerate(at[:, 1])])
    want, own = _by_pairs(df, 0.1), {r.id: r.v for r in df.collect()}
    for asking, around, crowd, batch in ((bands.ASKING, bands.AROUND, bands.CROWD, bands.BATCH), (16, 100, 8, 100)):
        for k, v in (("ASKING", asking), ("AROUND", around), ("CROWD", crowd), ("BATCH", batch)):
            monkeypatch.setattr(bands, k, v)
        got = _lags(autocorr.lag_band(df, 0.1, "id", "v", "lag"))
        assert got.keys() == want.keys() == own.keys()
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)
    assert name == "sparse" or sum(v != 0 for v in want.values()) > 300


def test_places_and_values_that_are_missing_or_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0.0, 0.0, 1.0), ("b", 0.05, 0.0, 3.0), ("c", nan, 0.0, 5.0), ("d", None, 0.0, 7.0), ("e", inf, 0.0, 9.0), ("f", 0.0, 0.05, None), ("g", 1e300, 0.0, 2.0), ("h", 9.0, 9.0, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {i: 0.0 for i in "abcdefgh"} | {"a": 3.0, "b": 1.0, "f": 2.0}
    assert _lags(autocorr.lag_band(df, 0.1, "id", "v", "lag")) == want
    odd = df.where("id <> 'g'").withColumn("v", F.when(F.col("id") == "b", inf).otherwise(F.col("v")))
    assert _lags(autocorr.lag_band(odd, 0.1, "id", "v", "lag")) == {i: v for i, v in want.items() if i != "g"} | {"a": inf, "f": inf}
    assert autocorr.lag_band(df.limit(0), 0.1, "id", "v", "lag").count() == 0


def _shuffled(df):
    """Rows that the run of df has written to shuffles."""
    made, nodes = 0, [df._jdf.queryExecution().executedPlan().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        if node.nodeName() == "Exchange":
            made += node.metrics().apply("shuffleRecordsWritten").value()
    return made


def test_no_pair_is_shuffled(spark, tmp_path):
    """l02_lag_kernel shuffled every pair of its band, so four times the points made sixteen times the rows."""
    moved = []
    for n in (1000, 4000):
        at = np.random.default_rng(7).normal(size=(n, 2)) * 0.126
        vectors = spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate(at)], "vec_id long, embedding array<float>")
        vectors.write.parquet(str(tmp_path / f"{n}/embeddings.parquet"))
        df = catalog.queries()["l02_lag_kernel"](spark, str(tmp_path / f"{n}"))
        assert df._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
        df.collect()
        moved.append(_shuffled(df) / n)
    assert 2 < moved[0] and moved[1] < 16


def test_blocks_of_a_dense_band_do_not_grow_in_number(spark, monkeypatch):
    """the pairs of w06_distance_band_irregular were dealt into ever more blocks, so rows shuffled grew with the square of the points."""
    for k, v in (("PAIRS", 100), ("BLOCKED", 16)):
        monkeypatch.setattr(weights, k, v, raising=False)
    moved = []
    for n in (200, 800):
        at = np.random.default_rng(8).random((n, 2)) * 0.5
        df = weights.distance_band(_obs(spark, at).withColumnRenamed("id", "obs_id"), 0.25)
        gap = np.sqrt(((at[:, None] - at) ** 2).sum(2))
        assert len(df.collect()) == (gap <= 0.25).sum() - n
        moved.append(_shuffled(df) / n)
    assert moved[1] < 1.5 * moved[0]
