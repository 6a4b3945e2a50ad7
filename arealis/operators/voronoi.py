"""Voronoi cells by locality, and the neighbours that they make.

A cell starts as the box and is cut by sites near its own, found in rings of grid cells. A site q can cut the cell of p only while some corner
of it is nearer to q than to p, so each round looks for such sites alone, takes the nearest of them, and cuts. A cell is certain once none is
left and twice its radius lies within the cells that were searched; the others go on with cells four times as wide. While no grid cell holds
many sites, all in reach come at once, as arrays by grid cell; else no site meets more than MOST others in one round. Nothing comes to the driver.
Only a few sites (FEW, counted) are sent to every task instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.operators.cut import cut, dealt
from arealis.operators.geometry import GEOM, POLYGON
from arealis.operators.weights import HELD, _beside, _finest, _spread

#: Sites that cut a cell in one round at most, and grid cells around a site that are searched.
MOST, REACH = 64, 2
#: Sites (24 bytes each) that go to every task, where each cell is cut at once.
FEW = 4096
#: What stands across an edge of the box.
OUTSIDE = -1
CELL = "ring array<struct<x:double,y:double>>, beside array<long>"


def cut_cell(corners: list[tuple[float, float]], beside: list[int], others: Iterable[tuple[float, float, int]]) -> tuple[list[tuple[float, float]], list[int]]:
    """A convex cell around the origin after cuts by others (x, y, number), nearest first. Edge i runs from corner i to the next, with beside[i] across it.

    A cut that only touches a corner changes nothing.
    """
    radius = max((x * x + y * y for x, y in corners), default=0.0)
    for qx, qy, number in others:
        far = qx * qx + qy * qy
        if far > 4 * radius or not corners:
            break
        over = [2 * (qx * x + qy * y) - far for x, y in corners]
        if max(over) <= 0:
            continue
        kept, across, n = [], [], len(corners)
        for i, (v, label, a) in enumerate(zip(corners, beside, over, strict=True)):
            b = over[(i + 1) % n]
            if a <= 0:
                kept.append(v)
                across.append(number if a == 0 and b > 0 else label)
            if (a < 0 < b) or (b < 0 < a):
                w, t = corners[(i + 1) % n], a / (a - b)
                kept.append((v[0] + t * (w[0] - v[0]), v[1] + t * (w[1] - v[1])))
                across.append(number if a < 0 else label)
        corners, beside = kept, across
        radius = max((x * x + y * y for x, y in corners), default=0.0)
    return corners, beside


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rings, besides, reaches = [], [], []
        near = batch.column("near")
        ends, (ids, xs, ys) = near.offsets.to_numpy(), (near.values.field(c).to_numpy(zero_copy_only=False) for c in ("obs_id", "x", "y"))
        for i, (own, x, y, ring, beside) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("obs_id", "x", "y", "ring", "beside")), strict=True)):
            qs, dx, dy = (a[ends[i] : ends[i + 1]] for a in (ids, xs, ys))
            dx, dy, known = dx - x, dy - y, {own, *beside}
            order = np.lexsort((qs, dx * dx + dy * dy))
            others = ((qx, qy, q) for qx, qy, q in zip(dx[order].tolist(), dy[order].tolist(), qs[order].tolist(), strict=True) if q not in known)
            corners, beside = cut_cell([(v["x"] - x, v["y"] - y) for v in ring], beside, others)
            rings.append([{"x": vx + x, "y": vy + y} for vx, vy in corners])
            besides.append(beside)
            reaches.append(2 * max((vx * vx + vy * vy for vx, vy in corners), default=0.0) ** 0.5)
        spot = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        yield pa.RecordBatch.from_arrays([batch.column("obs_id"), batch.column("x"), batch.column("y"), pa.array(rings, pa.list_(spot)), pa.array(besides, pa.list_(pa.int64())), pa.array(reaches, pa.float64()), batch.column("c")], names=["obs_id", "x", "y", "ring", "beside", "needs", "c"])


NEAR = "array<struct<obs_id:bigint,x:double,y:double>>"


def _met(open_cells: DataFrame, sites: DataFrame, size: float) -> DataFrame:
    """open_cells cut by all sites in reach: those of a grid cell come as one array, so neither pairs nor rings are shuffled."""
    rows = _beside(open_cells, sites, size, REACH, ("x", "y"))
    rows = rows.select("obs_id", "x", "y", "ring", "beside", F.coalesce("others", F.array().cast(NEAR)).alias("near"), F.lit(0).cast("long").alias("c"))
    return rows.mapInArrow(_cut_rows, f"obs_id long, x double, y double, {CELL}, needs double, c long")


def _searched(open_cells: DataFrame, sites: DataFrame, size: float) -> DataFrame:
    """open_cells with `near`, the nearest MOST of the sites in reach that may cut them, and c, how many may; then cut."""
    place = lambda a: F.floor(F.col(a) / size)
    span = F.sequence(F.lit(-REACH), F.lit(REACH))
    wide = open_cells.select(F.col("obs_id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), "ring", "beside", place("x").alias("ax"), place("y").alias("ay"))
    wide = wide.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).select("src", "sx", "sy", "ring", "beside", (F.col("ax") + F.col("dx")).alias("cx"), (F.col("ay") + F.col("dy")).alias("cy"))
    own = sites.select(F.col("obs_id").alias("dst"), "x", "y", place("x").alias("cx"), place("y").alias("cy"))
    nearer = F.expr("not array_contains(beside, dst) and exists(ring, v -> 2 * ((x - sx) * (v.x - sx) + (y - sy) * (v.y - sy)) > (x - sx) * (x - sx) + (y - sy) * (y - sy))")
    d = (F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2
    met = wide.join(dealt(own), ["cx", "cy"]).where(F.col("src") != F.col("dst")).where(nearer).select("src", "dst", "x", "y", d.alias("d"))
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))).where(F.col("r") <= MOST + 1)
    listed = ranked.groupBy(F.col("src").alias("obs_id")).agg(F.count(F.lit(1)).alias("c"), F.slice(F.array_sort(F.collect_list(F.struct("d", F.col("dst").alias("obs_id"), "x", "y"))), 1, MOST).alias("near"))
    rows = open_cells.select("obs_id", "x", "y", "ring", "beside").join(dealt(listed), "obs_id", "left").withColumns({"c": F.coalesce("c", F.lit(0)).cast("long"), "near": F.coalesce(F.transform("near", lambda q: F.struct(q["obs_id"].alias("obs_id"), q["x"].alias("x"), q["y"].alias("y"))), F.array().cast(NEAR))})
    return rows.mapInArrow(_cut_rows, f"obs_id long, x double, y double, {CELL}, needs double, c long")


def _cut_at_once(sites: DataFrame) -> DataFrame:
    """sites with ring and beside, cut by all others, nearest first; these come to the driver and go to every task."""
    table = sites.select("obs_id", "x", "y").toArrow()
    ids, xs, ys = (table.column(c).to_numpy() for c in ("obs_id", "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings, besides = [], []
            for own, x, y, ring, beside in zip(*(batch.column(c).to_pylist() for c in ("obs_id", "x", "y", "ring", "beside")), strict=True):
                order = np.lexsort((ids, (xs - x) ** 2 + (ys - y) ** 2))
                others = ((float(xs[j]) - x, float(ys[j]) - y, int(ids[j])) for j in order if ids[j] != own)
                corners, beside = cut_cell([(v["x"] - x, v["y"] - y) for v in ring], beside, others)
                rings.append([{"x": vx + x, "y": vy + y} for vx, vy in corners])
                besides.append(beside)
            spot = pa.struct([("x", pa.float64()), ("y", pa.float64())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rings, pa.list_(spot)), pa.array(besides, pa.list_(pa.int64()))], names=["obs_id", "x", "y", "ring", "beside"])

    return sites.select("obs_id", "x", "y", "ring", "beside").mapInArrow(run, f"obs_id long, x double, y double, {CELL}")


def cells(points: DataFrame, box: tuple[float, float, float, float], per_cell: float = 2.0, few: int = FEW, held: int = HELD) -> DataFrame:
    """(obs_id, x, y, ring, beside): the part of the box nearer to each site than to any other, corners clockwise and not closed; beside[i] is the
    site across the edge that starts at corner i, or OUTSIDE.

    Coincident sites are refused. A site whose cell misses the box has an empty ring; no sites, no rows.
    """
    sites = cut(points.select(F.col("obs_id").cast("long").alias("obs_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    if not sites.groupBy("x", "y").count().where("count > 1").isEmpty():
        raise ValueError("two sites coincide")
    x0, y0, x1, y1 = map(float, box)
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    start = {"ring": F.array(corner(x0, y0), corner(x0, y1), corner(x1, y1), corner(x1, y0)), "beside": F.array(*[F.lit(OUTSIDE).cast("long")] * 4)}
    n, widest, size = _spread(sites, ("x", "y"), per_cell)
    if n < 2:
        return sites.withColumns(start)
    if n <= few:
        return _cut_at_once(sites.repartition(sites.sparkSession.sparkContext.defaultParallelism).withColumns(start))
    size, full = _finest(sites, size)
    waiting, found = sites.withColumns(start), None
    while True:
        last, again, later = REACH * size > widest, waiting, None
        while True:
            cells_now = cut((_met if full <= held else _searched)(again, sites, size))
            settled = F.col("c") <= MOST
            sure = settled & ((F.col("needs") < REACH * size) | F.lit(last))
            done = cells_now.where(sure).select("obs_id", "x", "y", "ring", "beside")
            found = done if found is None else found.unionAll(done)
            rest = cells_now.where(settled & ~sure)
            later = rest if later is None else later.unionAll(rest)
            again = cells_now.where(~settled)
            if again.isEmpty():
                break
        if later.isEmpty():
            return found
        waiting = later.select("obs_id", "x", "y", "ring", "beside")
        size, full = size * 4, full * 16


def thiessen(points: DataFrame, box: tuple[float, float, float, float], few: int = FEW) -> DataFrame:
    """points with geom, their Voronoi cell clipped to the box (closed clockwise ring); other columns are carried along."""
    closed = F.when(F.size("ring") > 0, F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring"))
    geom = F.struct(F.lit(POLYGON).alias("type"), F.array(F.lit(0)).alias("parts"), closed.alias("points")).cast(GEOM)
    return points.join(dealt(cells(points, box, few=few).select(F.col("obs_id").alias("_id"), geom.alias("geom"))), F.col("obs_id") == F.col("_id")).drop("_id")


def neighbours(points: DataFrame, box: tuple[float, float, float, float], least: float = 1e-9, few: int = FEW) -> DataFrame:
    """W(src, dst, w): sites whose cells share an edge inside the box, w its length: the Delaunay neighbours that meet there.

    Of cocircular sites, whose cells meet in a point, only those with an edge longer than `least` parts of the box's diagonal are neighbours.
    """
    diagonal = float(np.hypot(box[2] - box[0], box[3] - box[1]))
    edges = cells(points, box, few=few).select("obs_id", F.explode(F.expr("transform(ring, (p, i) -> struct(p as p, ring[(i + 1) % size(ring)] as q, beside[i] as other))")).alias("e"))
    long = F.sqrt((F.col("e.p.x") - F.col("e.q.x")) ** 2 + (F.col("e.p.y") - F.col("e.q.y")) ** 2)
    shared = edges.where(F.col("e.other") != OUTSIDE).select(F.col("obs_id").alias("src"), F.col("e.other").alias("dst"), long.alias("w")).where(F.col("w") > least * diagonal)
    shared = shared.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    pairs = shared.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionAll(pairs.select("b", "a", "w"))


def holders(points: DataFrame, polygons: DataFrame, slack: float = 1e-9) -> DataFrame:
    """(key, obs_id): for each of points (key, x, y) the convex polygons (obs_id, geom, clockwise) that hold it, edges included: an equi-join on grid cells, then exact."""
    box = lambda f, a: F.expr(f"array_{f}(transform(geom.points, p -> p.{a}))")
    shapes = cut(polygons.where(F.size("geom.points") > 0).select("obs_id", F.col("geom.points").alias("ring"), *[box(f, a).alias(f + a) for f in ("min", "max") for a in "xy"]))
    sides = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    mean, n, across, up = shapes.agg(F.avg(sides), F.count(F.lit(1)), F.max("maxx") - F.min("minx"), F.max("maxy") - F.min("miny")).first()
    across, up = across or 0.0, up or 0.0
    size = max(mean or 0.0, (across * up / max(n, 1)) ** 0.5, max(across, up) / max(n, 1))  # so that no polygon covers many more cells than there are polygons
    if not size:
        return points.select("key", F.lit(None).cast("long").alias("obs_id")).where("false")
    place = lambda c: F.floor(c / size)
    spread = shapes.withColumn("cx", F.explode(F.sequence(place(F.col("minx") - slack), place(F.col("maxx") + slack)))).withColumn("cy", F.explode(F.sequence(place(F.col("miny") - slack), place(F.col("maxy") + slack))))
    spots = points.select("key", F.col("x").alias("px"), F.col("y").alias("py")).withColumns({"cx": place(F.col("px")), "cy": place(F.col("py"))})
    inside = F.expr(f"forall(sequence(0, size(ring) - 2), i -> (ring[i + 1].x - ring[i].x) * (py - ring[i].y) - (ring[i + 1].y - ring[i].y) * (px - ring[i].x) <= {slack})")
    return spots.join(dealt(spread), ["cx", "cy"]).where(inside).select("key", "obs_id")
