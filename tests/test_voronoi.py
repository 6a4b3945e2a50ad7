"""Voronoi cells and their neighbours against all bisectors, in crowds, on lattices and with sites far from the rest."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arealis.operators import geometry, voronoi

RNG = random.Random(3)
CROWD = [(50 + RNG.random() * 1e-3, 50 + RNG.random() * 1e-3) for _ in range(150)]
SETS = {
    "spread": [(RNG.random(), RNG.random()) for _ in range(120)],
    "crowd and outliers": CROWD + [(0.0, 0.0), (100.0, 3.0), (99.0, 97.0), (2.0, 88.0)],
    "line": [(float(i), 2.0) for i in range(40)],
    "lattice": [(float(i % 9), float(i // 9)) for i in range(81)],
    "circle": [(math.cos(i * math.pi / 12), math.sin(i * math.pi / 12)) for i in range(24)],
    "two": [(0.0, 0.0), (3.0, 1.0)],
    "one": [(5.0, 5.0)],
}


def _edges(sites, box, least=1e-9):
    """Pairs with the length of the bisector's part that no other site and no side of the box cuts off."""
    out, floor = {}, least * math.hypot(box[2] - box[0], box[3] - box[1])
    for i, (ax, ay) in enumerate(sites):
        for j, (bx, by) in enumerate(sites):
            if i == j:
                continue
            dx, dy = bx - ax, by - ay
            bounds = [(2 * ((cx - ax) * -dy + (cy - ay) * dx), (cx - ax) ** 2 + (cy - ay) ** 2 - (cx - ax) * dx - (cy - ay) * dy) for k, (cx, cy) in enumerate(sites) if k not in (i, j)]
            bounds += [(dx, box[3] - ay - dy / 2), (-dx, ay + dy / 2 - box[1]), (-dy, box[2] - ax - dx / 2), (dy, ax + dx / 2 - box[0])]
            lo, hi = -math.inf, math.inf
            for k, r in bounds:
                if k > 1e-15:
                    hi = min(hi, r / k)
                elif k < -1e-15:
                    lo = max(lo, r / k)
                elif r < 0:
                    hi = -math.inf
            if (hi - lo) * math.hypot(dx, dy) > floor:
                out[i, j] = (hi - lo) * math.hypot(dx, dy)
    return out


@pytest.mark.parametrize("name", sorted(SETS))
def test_cells_and_neighbours(spark, name):
    sites = SETS[name]
    points = spark.createDataFrame([(i, x, y, f"s{i}") for i, (x, y) in enumerate(sites)], "obs_id long, x double, y double, tag string").repartition(3)
    box = geometry.extent(points, 1.0)
    found = voronoi.thiessen(points, box, few=0).withColumns(geometry.area_perimeter()).collect()
    assert sorted((r.obs_id, r.tag) for r in found) == sorted((i, f"s{i}") for i in range(len(sites)))
    assert sum(r.area for r in found) == pytest.approx((box[2] - box[0]) * (box[3] - box[1]), rel=1e-9)
    assert all(geometry.ring_area([(p.x, p.y) for p in r.geom.points]) < 0 for r in found)
    rings = {r.obs_id: [(p.x, p.y) for p in r.geom.points] for r in found}
    for i, (x, y) in enumerate(sites):
        for px, py in rings[i]:  # no corner is nearer to another site
            assert min(math.dist((px, py), s) for s in sites) >= math.dist((px, py), (x, y)) - 1e-7
    want = _edges(sites, box)
    got = {(r.src, r.dst): r.w for r in voronoi.neighbours(points, box, few=0).collect()}
    once = {(r.src, r.dst): r.w for r in voronoi.neighbours(points, box).collect()}
    assert {k for k in once if once[k] > 1e-7} == {k for k in got if got[k] > 1e-7}
    sure = 1e-7 if name == "crowd and outliers" else 1e-9
    assert {k for k in want if want[k] > sure} <= set(got) and {k for k in got if got[k] > sure} <= set(want)
    near = 1e-3 if name == "crowd and outliers" else 1e-6  # bisectors of sites 1e-5 apart that run for 50
    assert all(got[k] == pytest.approx(w, abs=near) for k, w in want.items() if k in got)


def test_holders(spark):
    """Points inside, on an edge of two cells, on a corner of four, and outside."""
    points = spark.createDataFrame([(i, float(i % 3), float(i // 3)) for i in range(9)], "obs_id long, x double, y double")
    cells = voronoi.thiessen(points, (-0.5, -0.5, 2.5, 2.5))
    spots = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.5, 0.0), (3, 0.5, 0.5), (4, 9.0, 9.0)], "key long, x double, y double")
    got = {}
    for r in voronoi.holders(spots, cells).collect():
        got.setdefault(r.key, set()).add(r.obs_id)
    assert got == {1: {0}, 2: {0, 1}, 3: {0, 1, 3, 4}}
    assert voronoi.holders(spots, cells.where(F.lit(False))).count() == 0


def test_no_sites(spark):
    points = spark.createDataFrame([], "obs_id long, x double, y double")
    assert voronoi.thiessen(points, (0, 0, 1, 1)).count() == 0 and voronoi.neighbours(points, (0, 0, 1, 1)).count() == 0
