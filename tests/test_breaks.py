"""Natural breaks against all partitions in exact arithmetic, and block by block against all values at once."""

from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from arealis.operators import breaks, classify


def _all_partitions(values, counts, classes):
    def cost(i, j):
        n, s = sum(counts[i:j]), sum(Fraction(v) * c for v, c in zip(values[i:j], counts[i:j], strict=True))
        return sum(Fraction(v) ** 2 * c for v, c in zip(values[i:j], counts[i:j], strict=True)) - s * s / n

    m = len(values)
    return min((sum(cost(a, b) for a, b in zip((0, *cut), (*cut, m), strict=True)), cut) for cut in combinations(range(1, m), classes - 1))


@pytest.mark.parametrize("shift", [0.0, 1e12, -1e12, 0.1])
def test_exact_at_any_offset(shift):
    rng = np.random.default_rng(5)
    samples = [[0, 1, 2, 100, 101, 102, 300, 301], *(sorted(rng.choice(200, 11, replace=False).tolist()) for _ in range(6))]
    for base in samples:
        values = np.array(base, "f8") + shift
        counts = rng.integers(1, 5, len(values)).tolist()
        want, cut = _all_partitions(values.tolist(), counts, 3)
        got = breaks.best_breaks(values, counts, 3)
        at = [0, *np.searchsorted(values, got), len(values)]
        assert sum(float(_all_partitions(values[a:b].tolist(), counts[a:b], 1)[0]) for a, b in zip(at, at[1:], strict=False)) == pytest.approx(float(want), rel=1e-12)
    assert breaks.best_breaks(np.array([0, 1, 2, 100, 101, 102, 300, 301]) + 1e12, [1] * 8, 3) == [1e12 + 100, 1e12 + 300]


def test_few_values():
    assert breaks.best_breaks(np.array([]), [], 3) == []
    assert breaks.best_breaks(np.array([4.0]), [7], 3) == [] and breaks.best_breaks(np.array([4.0, 5.0]), [7, 1], 3) == [5.0]


RNG = np.random.default_rng(6)
COLUMNS = {
    "even": np.arange(3000.0),
    "gamma": RNG.gamma(1.2, 50, 3000),
    "groups": np.concatenate([RNG.normal(m, 1, 700) for m in (0, 50, 60, 400)]),
    "outliers": np.concatenate([RNG.normal(0, 1, 2000), [1e9, -1e9]]),
    "offset": 1e12 + RNG.normal(0, 1000, 2500).round(),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
@pytest.mark.parametrize("classes", [2, 5])
def test_blocks_give_what_all_values_give(spark, name, classes):
    values, counts = np.unique(COLUMNS[name], return_counts=True)
    table = spark.createDataFrame([(float(v), int(c)) for v, c in zip(values, counts, strict=True)], "v double, c long").repartition(3)
    cost = lambda cuts: sum((float(n.sum()) * float(np.average((v - np.average(v - v[0], weights=n) - v[0]) ** 2, weights=n))) for v, n in zip(np.split(values, cuts), np.split(counts, cuts), strict=True))
    got, want = (np.searchsorted(values, b) for b in (breaks.find_breaks(table, classes, few=100, blocks=48), breaks.best_breaks(values, counts, classes)))
    assert len(got) == classes - 1 and (got.tolist() == want.tolist() or cost(got) == pytest.approx(cost(want), rel=1e-9))


def test_column(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 10, 11, 30)] + [(None,)], "v double")
    assert {(r.v, r.cat) for r in classify.natural_breaks(df, "v", 3).where("v is not null").collect()} == {(1, 1), (2, 1), (10, 2), (11, 2), (30, 3)}
    assert classify.natural_breaks(df.where("false"), "v", 3).count() == 0
