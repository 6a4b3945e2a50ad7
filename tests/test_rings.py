"""Ring nesting against counting crossings for each pair, and repair of whole layers."""

import random

import pytest

from arealis.operators import geometry, rings


def _square(x, y, half, turn=False, at=0):
    corners = [(x - half, y - half), (x - half, y + half), (x + half, y + half), (x + half, y - half)]
    corners = corners[at:] + corners[:at]
    ring = [*corners, corners[0]]
    return ring[::-1] if turn else ring


def _nested(rng, x, y, half, deep):
    """A square with others in it, side by side, to some depth."""
    out = [(_square(x, y, half, rng.random() < 0.5, rng.randrange(4)), deep)]
    if half > 0.02:
        for dx, dy in rng.sample([(-1, -1), (-1, 1), (1, -1), (1, 1)], rng.randrange(5)):
            out += _nested(rng, x + dx * half / 2, y + dy * half / 2, half * rng.uniform(0.2, 0.45), deep + 1)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_depths(seed):
    rng = random.Random(seed)
    found = [r for k in range(4) for r in _nested(rng, 3 * k, rng.uniform(-1, 1), 1.0, 0)]
    rng.shuffle(found)
    assert rings.depths([r for r, _ in found]) == [d for _, d in found] == geometry.nesting([r for r, _ in found])


def test_slanted_rings():
    """Diamonds and triangles: a corner above a slope, rings side by side whose boxes overlap."""
    diamond = lambda x, y, h: [(x - h, y), (x, y + h), (x + h, y), (x, y - h), (x - h, y)]
    triangle = [(0, 0), (10, 0), (0, 10), (0, 0)]
    found = [triangle, diamond(2, 2, 1), diamond(2, 2, 0.5), diamond(9, 9, 3), diamond(9, 9, 1), [(10, 1), (1, 10), (10, 10), (10, 1)]]
    assert rings.depths(found) == geometry.nesting(found) == [0, 1, 2, 1, 2, 0]


def test_touching_rings():
    """A hole that touches its ring in a corner, an island that touches the hole, equal left sides."""
    outer, hole = _square(0, 0, 4), [(-4, -4), (0, 2), (2, 0), (-4, -4)]
    island = [(0, 2), (0.5, 1), (0, 1), (0, 2)]
    assert rings.depths([outer, hole, island]) == [0, 1, 2]
    assert rings.depths([_square(0, 0, 1), _square(0, 2, 1), _square(0, -2, 1)]) == [0, 0, 0]
    assert rings.depths([]) == [] and rings.depths([[], _square(0, 0, 1), [(0, 0), (0.1, 0), (0, 0)]]) == [0, 0, 1]


def test_many_rings_in_one():
    """Ten thousand holes in one ring, in time that doesn't grow with their square."""
    holes = [_square(x, y, 0.3) for x in range(100) for y in range(100)]
    assert rings.depths([_square(50, 50, 60), *holes]) == [0] + [1] * 10_000


def test_repair(spark):
    """Open rings, wrong turns, a NULL geometry, a point, and a column named like the result."""
    geom = lambda *parts: {"type": 5, "parts": [sum(len(p) for p in parts[:k]) for k in range(len(parts))], "points": [{"x": float(x), "y": float(y)} for p in parts for x, y in p]}
    rows = [(1, geom(_square(0, 0, 3, True), _square(0, 0, 2)[:-1], _square(0, 0, 1, True)), 7), (2, None, 7), (3, geom(_square(5, 5, 1)), 7)]
    df = spark.createDataFrame(rows, f"obs_id long, geom {geometry.GEOM}, depths int").repartition(2)
    got = {r.obs_id: r for r in rings.repair(df).withColumns(geometry.area_perimeter()).collect()}
    assert got[1].depths == [0, 1, 2] and got[1].area == 36 - 16 + 4 and got[1].geom.parts == [0, 5, 10]
    assert got[2].geom is None and got[2].depths is None and got[3].area == 4.0
    assert rings.repair(df.where("false")).count() == 0
