"""Log-determinants from quadratures against eigenvalues, within the error that they state."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.operators import regression


@pytest.fixture(scope="module")
def lattice(spark):
    side = 30
    cells = spark.range(side * side).select(F.col("id").alias("obs_id"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    pairs = cells.withColumn("s", steps).select(F.col("obs_id").alias("src"), (F.col("obs_id") % side + F.col("s.a")).alias("x"), (F.floor(F.col("obs_id") / side) + F.col("s.b")).alias("y"))
    w = pairs.where(f"x between 0 and {side - 1} and y between 0 and {side - 1}").select("src", (F.col("y") * side + F.col("x")).cast("long").alias("dst"))
    return cells, w.where("src > 3 and dst > 3")  # the first observations are isolates


def test_quadratures_within_their_error(lattice):
    cells, w = lattice
    true = regression.log_det(w, cells)
    found = regression.log_det(w, cells, steps=18, vectors=8, exact=0)
    assert true.error(0.9) == 0.0
    for r in (-0.95, -0.5, 0.0, 0.3, 0.6, 0.8, 0.9, 0.95):
        assert abs(found(r) - true(r)) <= 4 * found.error(r) + 1e-3, r
        assert found.error(r) <= 0.02 * 900
    assert found(0.0) == 0.0


def test_exhausted_vectors(spark):
    """Vectors over two places span them after a step or two; their quadratures end there, and the mean stays within its error."""
    cells = spark.range(2).select(F.col("id").alias("obs_id"))
    w = spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long")
    found = regression.log_det(w, cells, exact=0, vectors=32)
    assert max(len(x) for x, _ in found.quadratures) <= 2
    assert abs(found(0.5) - math.log(1 - 0.25)) <= 4 * found.error(0.5) and found.error(0.5) > 0


def test_nodes_and_weights():
    x, t = regression.quadrature([0.0, 0.0], [0.5, 0.3])
    assert sorted(x) == pytest.approx([-0.5, 0.5]) and t.sum() == pytest.approx(1.0)
    assert np.all(np.abs(regression.quadrature([1.5], [0.0])[0]) <= 1)
