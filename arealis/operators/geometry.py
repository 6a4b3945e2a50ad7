"""Geometry on struct columns: geom STRUCT<type INT, parts ARRAY<INT>, points ARRAY<STRUCT<x, y>>>, rings closed, all JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT, POLYGON = 1, 5
GEOM = "struct<type:int,parts:array<int>,points:array<struct<x:double,y:double>>>"


def point(x, y) -> Column:
    """A point geometry from two numeric columns."""
    p = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return F.struct(F.lit(POINT).alias("type"), F.array(F.lit(0)).alias("parts"), F.array(p).alias("points"))


def rectangle(x0, y0, x1, y1) -> Column:
    """A closed clockwise ring."""
    c = [v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in (x0, y0, x1, y1)]
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(corner(c[0], c[1]), corner(c[0], c[3]), corner(c[2], c[3]), corner(c[2], c[1]), corner(c[0], c[1]))
    return F.struct(F.lit(POLYGON).alias("type"), F.array(F.lit(0)).alias("parts"), ring.alias("points"))


def mean_center(geom: str = "geom") -> dict[str, Column]:
    """Mean of all stored vertices; a closing vertex counts like the others."""
    n = F.size(f"{geom}.points")
    total = lambda axis: F.aggregate(f"{geom}.points", F.lit(0.0), lambda a, p: a + p[axis])
    return {"xmctr": F.try_divide(total("x"), n), "ymctr": F.try_divide(total("y"), n)}


def _ring(geom: str, part: str = "0") -> str:
    return f"slice({geom}.points, {geom}.parts[{part}] + 1, coalesce(get({geom}.parts, {part} + 1), size({geom}.points)) - {geom}.parts[{part}])"


def _steps(ring: str) -> str:
    return f"zip_with(slice({ring}, 1, greatest(size({ring}) - 1, 0)), slice({ring}, 2, greatest(size({ring}) - 1, 0)), (p, q) -> struct(p, q))"


def _sum(ring: str, term: str) -> str:
    return f"aggregate({_steps(ring)}, cast(0 as double), (a, e) -> a + ({term}))"


CROSS = "(e.p.x * e.q.y - e.q.x * e.p.y)"


def centroid(geom: str = "geom", full: bool = False) -> dict[str, Column]:
    """Area-weighted centroid of the first ring, or of all rings with their signs; a point or a flat ring gives its first vertex."""
    if full:
        rings = f"transform(sequence(0, size({geom}.parts) - 1), i -> {_ring(geom, 'i')})"
        of = lambda term: f"aggregate({rings}, cast(0 as double), (s, r) -> s + {_sum('r', term)})"
    else:
        of = lambda term: _sum(_ring(geom), term)
    area, first = of(CROSS), f"get({geom}.points, 0)"
    at = lambda axis: F.expr(f"case when size({geom}.points) < 4 or {area} = 0 then {first}.{axis} else {of(f'(e.p.{axis} + e.q.{axis}) * {CROSS}')} / (3 * {area}) end")
    return {"xcntrd": at("x"), "ycntrd": at("y")}


def signed_area(ring: str) -> str:
    """Positive for counter-clockwise rings."""
    return f"{_sum(ring, CROSS)} / 2"


def area_perimeter(geom: str = "geom") -> dict[str, Column]:
    """Net area over all rings (holes run the other way) and the length of all edges."""
    rings = f"transform(sequence(0, size({geom}.parts) - 1), i -> {_ring(geom, 'i')})"
    area = F.expr(f"abs(aggregate({rings}, cast(0 as double), (s, r) -> s + {_sum('r', CROSS)})) / 2")
    length = F.expr(f"aggregate({rings}, cast(0 as double), (s, r) -> s + {_sum('r', 'sqrt((e.q.x - e.p.x) * (e.q.x - e.p.x) + (e.q.y - e.p.y) * (e.q.y - e.p.y))')})")
    return {"area": area, "perimeter": length}


def bounding_box(geom: str = "geom") -> dict[str, Column]:
    return {f"{n}{a}": F.expr(f"array_{n}(transform({geom}.points, p -> p.{a}))") for n in ("min", "max") for a in ("x", "y")}


def grid(spark: SparkSession, rows: int, cols: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """rows * cols rectangles over a box, numbered from 1 at the top left, with area and perimeter."""
    w, h = (x1 - x0) / cols, (y1 - y0) / rows
    cell = spark.range(rows * cols).select((F.col("id") + 1).alias("obs_id"), (F.col("id") % cols).alias("c"), F.floor(F.col("id") / cols).alias("r"))
    left, top = x0 + F.col("c") * w, y1 - F.col("r") * h
    return cell.select("obs_id", rectangle(left, top - h, left + w, top).alias("geom"), F.lit(w * h).alias("area"), F.lit(2 * (w + h)).alias("perimeter"))


def export_points(df: DataFrame, key: str, which: str = "centroid", geom: str = "geom") -> DataFrame:
    """A new point layer of centroids or mean centers with its key."""
    found = centroid(geom) if which == "centroid" else mean_center(geom)
    x, y = found.values()
    flat = df.select(F.col(key), x.alias("x"), y.alias("y"))
    return flat.withColumn("geom", point("x", "y"))


def point_line_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to the segment ab; to a where both ends coincide."""
    c = [v if isinstance(v, Column) else F.lit(float(v)) for v in (px, py, ax, ay, bx, by)]
    dx, dy = c[4] - c[2], c[5] - c[3]
    t = F.coalesce(F.try_divide((c[0] - c[2]) * dx + (c[1] - c[3]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.sqrt((c[0] - c[2] - t * dx) ** 2 + (c[1] - c[3] - t * dy) ** 2)


def rectangles_meet(a: tuple, b: tuple) -> Column:
    """Boxes (x0, y0, x1, y1) of columns or numbers that share a point."""
    a, b = ([v if isinstance(v, Column) else F.lit(float(v)) for v in r] for r in (a, b))
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def ring_area(ring: list[tuple[float, float]]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False)) / 2


def inside(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def nesting(rings: list[list[tuple[float, float]]]) -> list[int]:
    """How many other rings hold each ring: odd ones are holes."""
    return [sum(inside(other, *ring[0]) for k, other in enumerate(rings) if k != i) for i, ring in enumerate(rings)]


def orient(rings: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Outer rings clockwise, holes counter-clockwise."""
    return [ring[::-1] if (ring_area(ring) > 0) == (depth % 2 == 0) else ring for ring, depth in zip(rings, nesting(rings), strict=True)]


def extent(points: DataFrame, margin: float) -> tuple[float, float, float, float]:
    """The bounding box of points, widened by a margin."""
    x0, y0, x1, y1 = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return x0 - margin, y0 - margin, x1 + margin, y1 + margin


def arc_midpoint(lon1: float, lat1: float, lon2: float, lat2: float) -> tuple[float, float]:
    """The middle of a great-circle arc, in degrees."""
    a, b, d = math.radians(lat1), math.radians(lat2), math.radians(lon2 - lon1)
    x, y = math.cos(b) * math.cos(d), math.cos(b) * math.sin(d)
    lat = math.atan2(math.sin(a) + math.sin(b), math.hypot(math.cos(a) + x, y))
    return math.degrees(math.radians(lon1) + math.atan2(y, math.cos(a) + x)), math.degrees(lat)
