"""Sums over the points within a distance of each point, without the pairs.

Points meet those around them by grid cell, each at most nine times. In a cell, the points around lie in strips, sorted along them: all that is
surely near enough is one run of a strip, whose sum is the difference of two running sums, and only the ends of runs are compared one by one.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators.cut import cut, dealt
from arealis.operators.weights import HALVINGS, PLANE, TASKS, _fullest, _spread

#: Points of a cell, were they spread evenly, and those of the fullest cell, while cells can be smaller; they are no smaller than the distance.
PER_CELL, CROWD = 512, 4096
#: Points that ask in one group, and points around them; those of fuller cells are dealt into several groups.
ASKING, AROUND = 1 << 16, 1 << 20
#: Pairs that are compared at once.
BATCH = 1 << 18
#: In squares of distances, what is left to the exact comparison; much more than rounding.
MARGIN = 1e-9


def near_sums(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, v: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place (px, py): sum of v over the points (x, y) no more than `reach` away and number of these, points with v NaN left out."""
    sums, counts = np.zeros(len(px)), np.zeros(len(px), np.int64)
    order = np.argsort(y, kind="stable")
    order = order[~np.isnan(v[order])]
    if not len(order) or not len(px):
        return sums, counts
    slack = 4 * np.finfo(float).eps * (np.abs(x).max() + np.abs(px).max() + reach)
    for strip in np.array_split(order, max(1, round(len(order) ** 0.5 / 4))):
        low, high = y[strip[0]], y[strip[-1]]
        near = np.maximum(np.maximum(low - py, py - high), 0.0)
        who = np.flatnonzero(near <= reach * (1 + MARGIN))
        strip = strip[np.argsort(x[strip], kind="stable")]
        sx, sy, sv = x[strip], y[strip], v[strip]
        at, near, far = px[who], near[who], np.maximum(py[who] - low, high - py[who])
        inner = np.sqrt(np.maximum(reach * reach * (1 - MARGIN) - far * far, 0.0)) - slack
        outer = np.sqrt(np.maximum(reach * reach * (1 + MARGIN) - near * near, 0.0)) + slack
        first, last = np.searchsorted(sx, at - outer, "left"), np.searchsorted(sx, at + outer, "right")
        begin = np.where(inner > 0, np.searchsorted(sx, at - inner, "left"), first)
        end = np.where(inner > 0, np.searchsorted(sx, at + inner, "right"), first)
        run = np.concatenate([[0], np.cumsum(sv, dtype=np.longdouble)])
        sums[who] += (run[end] - run[begin]).astype(float)
        counts[who] += end - begin
        _compared(np.concatenate([who, who]), np.concatenate([first, end]), np.concatenate([begin, last]), px, py, sx, sy, sv, reach, sums, counts)
    return sums, counts


def _compared(who, start, stop, px, py, x, y, v, reach, sums, counts) -> None:
    """Add to sums and counts of `who` the points start to stop that are near enough."""
    some = stop > start
    who, start, many = who[some], start[some], (stop - start)[some]
    upto = np.cumsum(many)
    if not len(who):
        return
    cuts = np.searchsorted(upto, np.arange(BATCH, upto[-1], BATCH), "right")
    for a, b in zip([0, *cuts], [*cuts, len(who)], strict=True):
        if a < b:
            one = np.repeat(np.arange(a, b), many[a:b])
            to = np.arange(len(one)) + np.repeat(start[a:b] - (upto[a:b] - many[a:b] - (upto[a - 1] if a else 0)), many[a:b])
            dx, dy = px[who[one]] - x[to], py[who[one]] - y[to]
            hit = np.sqrt(dx * dx + dy * dy) <= reach
            one, to = one[hit] - a, to[hit]
            np.add.at(sums, who[a:b], np.bincount(one, v[to], b - a))
            np.add.at(counts, who[a:b], np.bincount(one, minlength=b - a))


def _group(asking: pa.Table, around: pa.Table, reach: float) -> pa.Table:
    px, py, x, y, v = (t[c].to_numpy() for t, c in ((asking, "x"), (asking, "y"), (around, "x"), (around, "y"), (around, "v")))
    sums, counts = near_sums(px, py, x, y, v.astype(float), reach)
    return pa.table({"obs_id": asking["obs_id"], "s": sums, "k": counts})


def band_sums(points: DataFrame, reach: float) -> DataFrame:
    """(obs_id, s, k): of points (obs_id, x, y, v) sum and number of the v that are not NULL no more than `reach` away, the point's own too.

    x, y and v are finite doubles, v may be NULL. Shuffles each point at most ten times and no pairs; cells of more than ASKING points, or with
    more than about AROUND around them, are dealt into groups by hashes of ids, so that the memory of a task is bounded.
    """
    n, _, side = _spread(points, PLANE, PER_CELL)
    widest = min(HALVINGS, max(0, math.ceil(math.log2(side / reach))))
    crowds = _fullest(points, reach * 2**widest, list(range(widest + 1)), PLANE) or [0]
    h = next((h for h, c in enumerate(crowds) if c <= CROWD), len(crowds) - 1)
    size, full = reach * 2 ** (widest - h), crowds[h]
    left, right = max(1, -(-full // ASKING)), max(1, -(-9 * full // AROUND))
    tasks = min(TASKS, max(points.sparkSession.sparkContext.defaultParallelism, min(256, n // 64), 10 * n * max(left, right) // ASKING))
    on, wide = ["cx", "cy", "_left", "_right"], reach * (1 + MARGIN)
    part = lambda many: F.pmod(F.xxhash64("obs_id"), F.lit(many))
    to_all = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<bigint>"))
    cells = lambda a: F.explode(F.sequence(F.floor((F.col(a) - wide) / size), F.floor((F.col(a) + wide) / size)))
    asking = points.select("obs_id", "x", "y", *[F.floor(F.col(a) / size).alias(f"c{a}") for a in PLANE], part(left).alias("_left")).withColumn("_right", to_all(right))
    around = points.withColumn("cx", cells("x")).withColumn("cy", cells("y")).withColumn("_right", part(right)).withColumn("_left", to_all(left)).select("x", "y", "v", *on)
    met = asking.repartition(tasks, *on).groupBy(*on).cogroup(around.repartition(tasks, *on).groupBy(*on))
    found = met.applyInArrow(partial(_group, reach=reach), f"obs_id {points.schema['obs_id'].dataType.simpleString()}, s double, k bigint")
    return found.groupBy("obs_id").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
