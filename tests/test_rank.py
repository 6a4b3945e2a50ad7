"""Ranks against a plain sort: ties, NULLs, one value in most rows, strings with one prefix."""

import random

import pytest
from pyspark.sql import functions as F

from arealis.operators import rank
from arealis.operators.rank import ranked

RNG = random.Random(8)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["double", "string", "constant"])
def test_ranks(spark, kind, descending):
    keys = RNG.sample(range(10_000), 3000)
    value = {"double": lambda: None if RNG.random() < 0.05 else 7.0 if RNG.random() < 0.9 else RNG.random() * 20, "string": lambda: None if RNG.random() < 0.05 else f"Customer#{RNG.randrange(2000):05d}", "constant": lambda: 3.0}[kind]
    rows = [(value(), k) for k in keys]
    df = spark.createDataFrame(rows, f"v {'string' if kind == 'string' else 'double'}, k long").repartition(3)
    got = {r.k: r.r for r in ranked(df, "v", "r", ties=["k"], descending=descending).collect()}
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]), reverse=descending)
    assert got == {k: i + 1 for i, (_, k) in enumerate(want)}
    assert dict(ranked(df, "v", "r").dtypes)["r"] == "bigint"
    assert ranked(df.limit(0), "v", "r", ties=["k"]).count() == 0


def test_dates(spark):
    """Ranks and hinges of dates, with ties and missing ones, alone and by group."""
    days = [None, "2001-01-05", "2001-01-01", "2001-01-05", "1969-12-31"]
    df = spark.createDataFrame([(i, i % 2, d) for i, d in enumerate(days)], "k long, g int, s string").select("k", "g", F.to_date("s").alias("day"))
    assert {r.k: r.r for r in rank.ranked(df, "day", "r", ties=["k"]).collect()} == {0: 1, 4: 2, 2: 3, 1: 4, 3: 5}
    assert {r.k: r.r for r in rank.ranked(df, "day", "r", by=["g"], ties=["k"]).collect()} == {0: 1, 4: 2, 2: 3, 1: 1, 3: 2}
    row = rank.hinges(df, "day", "k").first()
    assert (row.n, row.min, row.max, row.q2) == (4, -1.0, 11327.0, (11323 + 11327) / 2)
