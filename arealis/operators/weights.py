"""Spatial weights as a relation W(src, dst[, w]): builders, checks and transformations.

Contiguity is an equi-join on shared vertices or edges. Distance predicates are dealt into grid cells first, so that the planner
sees an equi-join; nearest neighbours search the cells around their own, which grow only for points not yet certain.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.operators.cut import cut, dealt

EARTH_MILES = 3959.0


def vertices(polygons: DataFrame, key: str = "obs_id", geom: str = "geom") -> DataFrame:
    return polygons.select(F.col(key).alias("id"), F.explode(f"{geom}.points").alias("p")).select("id", "p.x", "p.y").distinct()


def edges(polygons: DataFrame, key: str = "obs_id", geom: str = "geom") -> DataFrame:
    """Undirected edges of all rings: consecutive points within each part, ends in order."""
    parts = polygons.select(F.col(key).alias("id"), F.col(geom).alias("g")).select("id", "g", F.posexplode("g.parts").alias("part", "start"))
    stop = F.expr("coalesce(get(g.parts, part + 1), size(g.points))")
    pairs = parts.withColumn("stop", stop).select("id", F.explode(F.expr("zip_with(slice(g.points, start + 1, greatest(stop - start - 1, 0)), slice(g.points, start + 2, greatest(stop - start - 1, 0)), (p, q) -> struct(p, q))")).alias("e"))
    flip = F.expr("e.p.x > e.q.x or (e.p.x = e.q.x and e.p.y > e.q.y)")
    a, b = F.when(flip, F.col("e.q")).otherwise(F.col("e.p")), F.when(flip, F.col("e.p")).otherwise(F.col("e.q"))
    return pairs.select("id", a.alias("a"), b.alias("b")).select("id", "a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).distinct()


def _sharing(parts: DataFrame, on: list[str]) -> DataFrame:
    other = parts.withColumnRenamed("id", "dst")
    return parts.withColumnRenamed("id", "src").join(other, on).where("src <> dst").select("src", "dst").distinct()


def queen(polygons: DataFrame, key: str = "obs_id", geom: str = "geom") -> DataFrame:
    return _sharing(vertices(polygons, key, geom), ["x", "y"])


def rook(polygons: DataFrame, key: str = "obs_id", geom: str = "geom") -> DataFrame:
    return _sharing(edges(polygons, key, geom), ["x", "y", "x2", "y2"])


def transpose(w: DataFrame) -> DataFrame:
    rest = [c for c in w.columns if c not in ("src", "dst")]
    return w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def symmetrise(w: DataFrame) -> DataFrame:
    return w.union(transpose(w)).distinct()


def higher_order(w: DataFrame, order: int, cumulative: bool = False) -> DataFrame:
    """Pairs at a graph distance of exactly `order`, or of at most that; order 1 is W itself."""
    level = w.select("src", "dst").distinct()
    level = cut(level) if order > 1 else level
    seen, step = level, level
    for _ in range(order - 1):
        ahead = step.join(level.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).where("src <> dst").distinct()
        step = cut(ahead.join(seen, ["src", "dst"], "left_anti"))
        seen = seen.unionAll(step)
    return seen if cumulative else step


def euclid(x1, y1, x2, y2) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def arc_miles(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle distance of degrees; the cosine is clamped so that coincident points are 0 apart."""
    a, b = F.radians(lat1), F.radians(lat2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1) - F.radians(lon2))
    return EARTH_MILES * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


PLANE = ("x", "y")
SPHERE = ("ux", "uy", "uz")


def _on_sphere(cells: DataFrame, names: list[str], size: float) -> DataFrame:
    """Cells that the unit sphere may pass: the others hold nothing."""
    middle = F.sqrt(sum((((F.col(c) + 0.5) * size) ** 2 for c in names), F.lit(0.0)))
    return cells.where(F.abs(middle - 1) <= size)


def _cells(points: DataFrame, size: float, reach: int, axes: tuple[str, ...] = PLANE) -> tuple[DataFrame, DataFrame]:
    """Points once for each cell within reach of their own, their coordinates renamed s*, and points in their own cell c*."""
    own = points.withColumns({f"c{a}": F.floor(F.col(a) / size) for a in axes})
    span = F.sequence(F.lit(-reach), F.lit(reach))
    wide = own
    for a in axes:
        wide = wide.withColumn(f"d{a}", F.explode(span))
    wide = wide.select(F.col("obs_id").alias("src"), *[F.col(a).alias(f"s{a}") for a in axes], *[(F.col(f"c{a}") + F.col(f"d{a}")).alias(f"c{a}") for a in axes])
    if axes == SPHERE:
        wide = _on_sphere(wide, [f"c{a}" for a in axes], size)
    return wide, own.select(F.col("obs_id").alias("dst"), *axes, *[f"c{a}" for a in axes])


#: Pairs that one task compares, about, and the tasks that are asked for at most.
PAIRS, TASKS = 1 << 24, 1 << 13
#: Tasks (or four for each core) beyond which tasks get more pairs, as more blocks mean more copies of all points.
BLOCKED = 1 << 9


def _paired(wide: DataFrame, own: DataFrame, cells: list[str]) -> DataFrame:
    """Rows (src, ...) of wide beside the rows (dst, ...) of own in the same cell.

    Few full cells are few bytes but many pairs, so one task would get all of them. The pairs of a cell are then dealt into blocks, by hashes
    of both ids: each pair meets in one block, and both sides are copied alike, about as the root of the blocks. Beyond BLOCKED tasks the
    blocks grow instead, so that what is shuffled grows as the points do.
    """
    beside = 3 ** len(cells)
    counted = own.groupBy(*cells).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("full"), F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).first()
    full, n = counted["full"] or 0, counted["n"] or 0
    cores = own.sparkSession.sparkContext.defaultParallelism
    each = max(PAIRS, int(beside * (counted["pairs"] or 0) / max(BLOCKED, 4 * cores)))
    blocks = -(-beside * full * full // each)
    if blocks <= 1:
        return wide.join(dealt(own), cells)
    right = max(1, round((blocks / beside) ** 0.5))
    left = -(-blocks // right)
    tasks = min(TASKS, max(-(-beside * n * full // each), cores))
    on = [*cells, "_left", "_right"]
    to_all = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<bigint>"))
    wide = wide.withColumn("_left", F.pmod(F.xxhash64("src"), F.lit(left))).withColumn("_right", to_all(right))
    own = own.withColumn("_right", F.pmod(F.xxhash64("dst"), F.lit(right))).withColumn("_left", to_all(left))
    return wide.repartition(tasks, *on).join(dealt(own.repartition(tasks, *on)), on)


def distance_band(points: DataFrame, threshold: float, degree: float = 1.0) -> DataFrame:
    """Pairs no more than `threshold` apart, weight distance**degree; coincident points count as threshold / 1e6 apart."""
    wide, own = _cells(points, threshold, 1)
    d = euclid(F.col("sx"), F.col("sy"), F.col("x"), F.col("y"))
    near = _paired(wide, own, ["cx", "cy"]).where("src <> dst").withColumn("d", d).where(F.col("d") <= threshold)
    apart = F.when(F.col("d") == 0, F.lit(threshold * 1e-6)).otherwise(F.col("d"))
    return near.select("src", "dst", (F.pow(apart, F.lit(degree)) if degree != 1 else apart).alias("w"))


def _sphere(points: DataFrame) -> DataFrame:
    """Degrees x (longitude) and y (latitude) with their unit vector ux, uy, uz. Longitudes wrap around, and a pole has one place only."""
    wrapped = F.when((F.col("x") >= -180) & (F.col("x") < 180), F.col("x")).otherwise(F.pmod(F.col("x") + 180, F.lit(360.0)) - 180)
    pole = F.abs("y") == 90
    lon, lat = F.radians(F.when(pole, 0.0).otherwise(wrapped)), F.radians("y")
    flat = F.when(pole, 0.0).otherwise(F.cos(lat))
    return points.select("obs_id", "x", "y", (flat * F.cos(lon)).alias("ux"), (flat * F.sin(lon)).alias("uy"), F.sin(lat).alias("uz"))


def chord_miles(chord: Column) -> Column:
    """The great-circle distance of two places whose unit vectors are `chord` apart."""
    return 2 * EARTH_MILES * F.asin(F.least(F.lit(1.0), chord / 2))


def arc_band(points: DataFrame, miles: float) -> DataFrame:
    """Pairs of degree points no more than `miles` apart on the great circle, weight miles: an equi-join on cells of unit vectors, then exact."""
    chord = 2 * math.sin(min(miles / EARTH_MILES, math.pi) / 2)
    size = max(chord * (1 + 1e-9), 1e-7)
    own = _sphere(points).withColumns({f"c{a}": F.floor(F.col(f"u{a}") / size) for a in "xyz"})
    span = F.sequence(F.lit(-1), F.lit(1))
    wide = own.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).withColumn("dz", F.explode(span))
    wide = wide.select(F.col("obs_id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), *[(F.col(f"c{a}") + F.col(f"d{a}")).alias(f"c{a}") for a in "xyz"])
    near = _paired(wide, own.select(F.col("obs_id").alias("dst"), "x", "y", "cx", "cy", "cz"), ["cx", "cy", "cz"]).where("src <> dst")
    return near.select("src", "dst", arc_miles(F.col("sx"), F.col("sy"), F.col("x"), F.col("y")).alias("w")).where(F.col("w") <= miles)


def inverse_distance(band: DataFrame, degree: float = 1.0, row_norm: bool = False) -> DataFrame:
    """(d / smallest d)**-degree, rows scaled to unit length if asked."""
    out = band.crossJoin(F.broadcast(band.agg(F.min("w").alias("least")))).select("src", "dst", F.pow(F.col("w") / F.col("least"), F.lit(-degree)).alias("w"))
    if row_norm:
        out = out.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("src"))))
    return out


#: Points that a cell of the first round may hold, and the halvings of its side that are looked at to get there.
CROWD, HALVINGS = 64, 24
#: Points of a cell that meet those of the cells beside it as one array; those of fuller cells meet in pairs.
HELD = 2048


def _beside(asking: DataFrame, targets: DataFrame, size: float, reach: int, axes: tuple[str, ...]) -> DataFrame:
    """asking with `others`, the targets in the cells within reach of its own as an array of (obs_id, *axes), or NULL. Cells are shuffled, not pairs of points."""
    own, span = [f"_c{a}" for a in axes], F.sequence(F.lit(-reach), F.lit(reach))
    place = {f"_c{a}": F.floor(F.col(a) / size) for a in axes}
    held = targets.select(*[c.alias(n) for n, c in place.items()], F.struct("obs_id", *axes).alias("_t")).groupBy(*own).agg(F.collect_list("_t").alias("_held"))
    placed = asking.withColumns(place)
    wide = placed.select(*own, *[F.col(c).alias(f"_o{c}") for c in own]).distinct()
    for c in own:
        wide = wide.withColumn("_d", F.explode(span)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    if axes == SPHERE:
        wide = _on_sphere(wide, own, size)
    met = wide.join(dealt(held), own).groupBy(*[F.col(f"_o{c}").alias(c) for c in own]).agg(F.flatten(F.collect_list("_held")).alias("others"))
    return placed.join(dealt(met), own, "left").drop(*own)


def _fullest(points: DataFrame, size: float, halvings: list[int], axes: tuple[str, ...]) -> list[int]:
    """The points of the fullest cell, for each of size / 2**h."""
    own = points.select(F.explode(F.array(*map(F.lit, halvings))).alias("h"), *axes)
    side = F.lit(size) / F.pow(F.lit(2.0), "h")
    full = own.groupBy("h", *[F.floor(F.col(a) / side).alias(f"c{a}") for a in axes]).agg(F.count(F.lit(1)).alias("c"))
    return [r["c"] for r in full.groupBy("h").agg(F.max("c").alias("c")).orderBy("h").collect()]  # a row for each halving


def _finest(points: DataFrame, size: float, axes: tuple[str, ...] = PLANE, crowd: int = CROWD) -> tuple[float, int]:
    """The widest of size / 2**h whose fullest cell holds at most `crowd` points, or little more than any smaller cells would, and what that one holds."""
    full = _fullest(points, size, [0], axes)[0]
    if full <= crowd:
        return size, full
    crowds = _fullest(points, size, list(range(HALVINGS + 1)), axes)
    h = next(h for h, c in enumerate(crowds) if c <= max(crowd, 2 * min(crowds)))
    return size / 2**h, crowds[h]


def _spread(points: DataFrame, axes: tuple[str, ...], per_cell: float) -> tuple[int, float, float]:
    """Number of points, their widest extent, and the side of cells of `per_cell` points each, were these spread evenly over the two widest axes."""
    found = points.agg(F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in axes]).first()
    n, sides = found["n"], sorted((found[a] or 0.0 for a in axes), reverse=True)
    return n, sides[0], max((sides[0] * sides[1] * per_cell / max(n, 1)) ** 0.5, sides[0] * per_cell / max(n, 1), 1e-12)


def _from_arrays(open_points: DataFrame, targets: DataFrame, k: int, size: float, axes: tuple[str, ...], distance: Callable, within: float) -> DataFrame:
    """open_points with `top`, the k nearest (w, dst, gap) of the targets in the cells beside their own whose gap is less than `within`."""
    gap = lambda o: F.sqrt(sum(((F.col(a) - o[a]) * (F.col(a) - o[a]) for a in axes), F.lit(0.0)))
    met = F.transform(F.coalesce("others", F.array()), lambda o: F.struct(o["obs_id"].alias("dst"), gap(o).alias("gap")))
    near = F.filter(met, lambda o: (o["dst"] != F.col("obs_id")) & (o["gap"] < within))
    scored = F.transform(near, lambda o: F.struct(distance(o["gap"]).alias("w"), o["dst"].alias("dst"), o["gap"].alias("gap")))
    return _beside(open_points, targets, size, 1, axes).select("obs_id", *axes, F.slice(F.sort_array(scored), 1, k).alias("top"))


def _from_pairs(open_points: DataFrame, targets: DataFrame, k: int, size: float, axes: tuple[str, ...], distance: Callable, within: float) -> DataFrame:
    """As _from_arrays, for cells of any number of points: candidates are rows."""
    wide, _ = _cells(open_points, size, 1, axes)
    _, own = _cells(targets, size, 0, axes)
    gap = F.sqrt(sum(((F.col(f"s{a}") - F.col(a)) * (F.col(f"s{a}") - F.col(a)) for a in axes), F.lit(0.0)))
    near = wide.join(dealt(own), [f"c{a}" for a in axes]).where("src <> dst").withColumn("gap", gap).where(F.col("gap") < within).withColumn("w", distance(F.col("gap")))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("w", "dst"))).where(F.col("r") <= k)
    tops = ranked.groupBy(F.col("src").alias("obs_id")).agg(F.sort_array(F.collect_list(F.struct("w", "dst", "gap"))).alias("top"))
    return open_points.join(dealt(tops), "obs_id", "left")


def _nearest(points: DataFrame, k: int, axes: tuple[str, ...], distance: Callable, per_cell: float, slack: float = 0.0, held: int = HELD) -> DataFrame:
    """(src, dst, w): the k nearest of each point by `distance`, which grows with the gap along the axes (gaps within slack may tie); ties by id.

    Cells are sized for `per_cell` points each, k at least, and halved until the fullest one is small, so clusters don't become pairs of all with all.
    A round certifies a point once k others lie nearer than the cells beside its own reach; the rest go on with cells four times as wide. While no
    cell holds more than `held` points, they meet as arrays, else in pairs. Of points at one place only the k + 1 least ids can be among anybody's
    nearest, so only these are candidates.
    """
    points = cut(points)
    n, widest, size = _spread(points, axes, max(per_cell, k))
    if not 0 < k < n:
        raise ValueError("k must lie between 0 and the number of points")
    least = F.row_number().over(Window.partitionBy(*axes).orderBy("obs_id"))
    targets = cut(points.withColumn("_r", least).where(F.col("_r") <= k + 1).drop("_r"))
    size, full = _finest(targets, size, axes, max(CROWD, 4 * k))
    open_points, found = points, None
    while True:
        last = size > widest
        within = math.inf if last else size
        tops = (_from_arrays if full <= held else _from_pairs)(open_points, targets, k, size, axes, distance, within)
        sure = F.coalesce((F.size("top") == k) & (F.element_at("top", -1)["gap"] + slack < within), F.lit(False))
        tops = cut(tops.withColumn("_sure", sure))
        done = tops.where("_sure").select(F.col("obs_id").alias("src"), F.explode("top").alias("e")).select("src", "e.dst", "e.w")
        found = done if found is None else found.unionAll(done)
        open_points = tops.where("not _sure").select("obs_id", *axes)
        if last or open_points.isEmpty():
            return found
        size, full = size * 4, full * 4 ** len(axes)


def knn(points: DataFrame, k: int, per_cell: float = 2.0) -> DataFrame:
    """The k nearest of each point, ties by id, weight distance."""
    flat = points.select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _nearest(flat, k, PLANE, lambda gap: gap, per_cell)


def arc_knn(points: DataFrame, k: int, per_cell: float = 2.0) -> DataFrame:
    """The k nearest of each degree point on the great circle, weight miles to a millionth (so ties go by id): a search over cells of unit vectors, certified by chords.

    Longitudes wrap at the dateline, a pole is one place whatever its longitude, and coincident points are 0 apart.
    """
    flat = _sphere(points.select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).select("obs_id", *SPHERE)
    return _nearest(flat, k, SPHERE, lambda gap: F.round(chord_miles(gap), 6), per_cell, 1e-9)


def min_threshold(points: DataFrame) -> DataFrame:
    """The largest distance of a point to its nearest: the least band without isolates."""
    return knn(points, 1).agg(F.max("w").alias("min_threshold"))


def max_distance(points: DataFrame) -> DataFrame:
    """The diagonal of the bounding box."""
    return points.agg(euclid(F.max("x"), F.max("y"), F.min("x"), F.min("y")).alias("max_distance"))


def asymmetric_pairs(w: DataFrame) -> DataFrame:
    """Pairs without their opposite; W is symmetric if there are none."""
    return w.select("src", "dst").join(transpose(w.select("src", "dst")), ["src", "dst"], "left_anti")


def is_symmetric(w: DataFrame) -> bool:
    return asymmetric_pairs(w).limit(1).count() == 0


def isolates(obs: DataFrame, w: DataFrame, key: str = "obs_id") -> DataFrame:
    return obs.join(w.select(F.col("src").alias(key)).distinct(), key, "left_anti")


def neighbour_counts(obs: DataFrame, w: DataFrame, key: str = "obs_id") -> DataFrame:
    counts = w.groupBy(F.col("src").alias(key)).agg(F.count(F.lit(1)).alias("k"))
    return obs.select(key).join(counts, key, "left").withColumn("k", F.coalesce("k", F.lit(0)))


def row_standardise(w: DataFrame) -> DataFrame:
    """1 / k for each neighbour; weights of W are not used."""
    return w.select("src", "dst", (1 / F.count(F.lit(1)).over(Window.partitionBy("src"))).alias("w"))
