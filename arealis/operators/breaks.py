"""Natural breaks: the partition of a column into classes with the least squared deviations, exact at every size.

Few distinct values come to the driver as they are. Of many, only counts, means and squared deviations of blocks between some values do. From these
follow an upper bound (breaks between blocks) and, for every block, a lower bound on partitions with their c-th break in it: deviations of
whole blocks only. Blocks whose bound is over the upper one hold no break of the best partition and are merged; the others are split, until each
is one value. The windows shrink with the blocks, so that what comes to the driver grows about as the root of the number of values.

Values are taken from one in the middle before they are multiplied, and the last step works on whole numbers, so large values lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators.cut import cut

#: Distinct values that come to the driver as they are; blocks of the first round; values of a block that is split into all of them.
FEW, BLOCKS, SINGLES = 4096, 1024, 64


def _best(before: np.ndarray, start: np.ndarray, cost, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least of before[i] + cost(start[i], j) over i <= j - least, and that i. The best i never moves back, so a middle bounds its halves."""
    m = len(before)
    now, at = np.full(m, np.inf), np.zeros(m, int)
    open_ = [(least, m - 1, 0, m - 1 - least)]
    while open_:
        lo, hi, first, last = open_.pop()
        if lo > hi:
            continue
        j = (lo + hi) // 2
        i = np.arange(first, max(first, min(last, j - least)) + 1)
        total = before[i] + cost(start[i], j)
        k = int(total.argmin())
        now[j], at[j] = total[k], i[k]
        open_ += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
    return now, at


def _whole(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Floats as whole numbers over one power of two."""
    ratios = [float(v).as_integer_ratio() for v in x]
    scale = max((d for _, d in ratios), default=1)
    return np.array([n * (scale // d) for n, d in ratios], dtype=object), scale


def best_breaks(values: np.ndarray, counts: np.ndarray, classes: int, means: np.ndarray | None = None, within: np.ndarray | None = None, allowed: np.ndarray | None = None) -> list[float]:
    """The least values of classes 2.. of the best partition. A row is a value and its count, or a block's least value, count, mean and squared deviations; classes
    may start at rows where `allowed` holds only."""
    values, counts = np.asarray(values, "f8"), np.asarray(counts, "i8")
    if not len(values):
        return []
    middle = float(values[len(values) // 2])
    centred = np.asarray(values - middle if means is None else means, "f8")
    heads = np.flatnonzero(np.ones(len(values), bool) if allowed is None else np.asarray(allowed, bool))
    heads = np.unique(np.concatenate([[0], heads]))
    v, scale = _whole(centred)
    extra, extra_scale = _whole(np.zeros(len(values)) if within is None else np.asarray(within, "f8"))
    ends = np.concatenate([heads, [len(values)]])
    total = lambda parts: np.concatenate([[0], np.cumsum(parts)])[ends]
    c = np.array([int(x) for x in counts], dtype=object)
    n, s, q, e = total(c), total(c * v), total(c * v * v), total(extra)

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        k, a = n[j] - n[i], s[j] - s[i]
        spread = (q[j] - q[i]) * k - a * a
        return np.array([(x / (y * scale * scale) if y else 0.0) + z / extra_scale for x, y, z in zip(spread, k, e[j] - e[i], strict=True)])

    m, same = len(heads), np.arange(len(heads) + 1)
    classes = min(classes, m)
    best, back = np.full(m + 1, np.inf), []
    best[0] = 0.0
    for _ in range(classes):
        best, at = _best(best, same, cost, 1)
        back.append(at)
    cuts, j = [], m
    for at in reversed(back[1:]):
        j = at[j]
        cuts.append(float(values[heads[j]]))
    return cuts[::-1]


def _bounds(stats: pd.DataFrame, classes: int) -> np.ndarray:
    """Which blocks may hold a break of the best partition: rows n, mean, dev, single, open, in order."""
    n, s, q = (np.concatenate([[0.0], np.cumsum(np.asarray(c, np.longdouble))]) for c in (stats["n"], stats["n"] * stats["mean"], stats["n"] * stats["mean"] ** 2 + stats["dev"]))

    def cost(lo, hi) -> np.ndarray:
        """Squared deviations of blocks lo up to hi - 1, 0 if there are none."""
        lo = np.minimum(lo, hi)
        k = n[hi] - n[lo]
        return np.maximum(np.asarray(q[hi] - q[lo] - (s[hi] - s[lo]) ** 2 / np.where(k > 0, k, 1), "f8"), 0.0)

    m, held, single = len(stats), stats["open"].to_numpy(), stats["single"].to_numpy()
    places = np.arange(m + 1)
    # A partition that exists: breaks at the lower edges of open blocks.
    row, upper = cost(0, places), np.inf
    for c in range(classes):
        upper = min(upper, float(row[m]))
        if c < classes - 1:
            row, _ = _best(np.where(np.append(held, False), row, np.inf), places, cost, 1)
    # A break in a block: the class before it has the blocks below at least, that after it those above (and the block, if it is one value).
    start = np.where(single, places[:m], places[1:])
    before, after = [cost(0, places[:m])], [cost(start, m)]
    for _ in range(classes - 2):
        before.append(_best(np.where(held, before[-1], np.inf), start, cost, 0)[0])
        after.append(_best(np.where(held, after[-1], np.inf)[::-1], places, lambda i, j: cost(start[m - 1 - j], m - 1 - i), 0)[0][::-1])
    slack = upper * (1 + 1e-9) + 1e-12 * float(cost(0, m))
    return held & np.any([before[c] + after[classes - 2 - c] <= slack for c in range(classes - 1)], axis=0) if classes > 1 else np.zeros(m, bool)


def block_stats(values: DataFrame, edges: np.ndarray, middle: float) -> pd.DataFrame:
    """Per block from one edge up to the next: n, distinct values d, the mean from the middle, squared deviations, least value; in order. As many rows as edges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.maximum(np.searchsorted(edges, pdf["v"].to_numpy(), "right") - 1, 0)
            off = pdf["v"].to_numpy() - edges[at]
            c = pdf["c"].to_numpy("f8")
            yield pd.DataFrame({"b": at, "n": c, "s": c * off, "q": c * off * off, "v": pdf["v"]}).groupby("b", as_index=False).agg(n=("n", "sum"), d=("v", "count"), s=("s", "sum"), q=("q", "sum"), least=("v", "min"))

    parts = values.mapInPandas(run, "b long, n double, d long, s double, q double, least double")
    found = parts.groupBy("b").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("least").alias("least")).toArrow().to_pandas().sort_values("b", ignore_index=True)
    found["mean"] = edges[found["b"]] - middle + found["s"] / found["n"]
    found["dev"] = np.maximum(found["q"] - found["s"] ** 2 / found["n"], 0.0) * (found["d"] > 1)
    found["single"] = found["d"] == 1
    return found


def find_breaks(values: DataFrame, classes: int, few: int = FEW, blocks: int = BLOCKS) -> list[float]:
    """The least values of classes 2.. for a table of distinct values v with their counts c."""
    values = cut(values)
    m = values.count()
    if m <= few:
        rows = values.toArrow().sort_by("v")
        return best_breaks(rows["v"].to_numpy(), rows["c"].to_numpy(), classes)
    shares = [k / blocks for k in range(blocks)]
    least, cuts = values.agg(F.min("v"), F.percentile_approx("v", shares, 100 * blocks)).first()
    edges = np.unique([least, *cuts])
    middle, open_at = float(edges[len(edges) // 2]), None
    while True:
        stats = block_stats(values, edges, middle)
        stats["open"] = True if open_at is None else np.isin(edges[stats["b"]], open_at)
        if not (stats["open"] & ~stats["single"]).any():
            return best_breaks(stats["least"].to_numpy(), stats["n"].to_numpy(), classes, stats["mean"].to_numpy(), stats["dev"].to_numpy(), stats["open"].to_numpy())
        keep = _bounds(stats, classes)
        lows = edges[stats["b"]]
        wide = stats[keep & ~stats["single"]]
        after = np.concatenate([[False], keep[:-1]])
        fixed = lows[keep | after]
        ends = np.append(lows[1:], np.inf)
        asked = pd.DataFrame({"lo": lows[wide.index], "hi": ends[wide.index], "d": wide["d"]})
        inner = _inside(values, asked, max(2, blocks // max(1, len(asked))))
        edges = np.unique(np.concatenate([edges[:1], fixed, inner]))
        open_at = np.concatenate([lows[keep], inner])


def _inside(values: DataFrame, asked: pd.DataFrame, parts: int) -> np.ndarray:
    """Values inside blocks (lo, hi, d distinct) that cut them into `parts`, or all of a block of at most SINGLES values."""
    lo, hi, d = (asked[c].to_numpy() for c in ("lo", "hi", "d"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = pdf["v"].to_numpy()
            at = np.searchsorted(lo, v, "right") - 1
            held = (at >= 0) & (v < hi[np.maximum(at, 0)])
            yield pd.DataFrame({"b": at[held], "v": v[held], "few": d[at[held]] <= SINGLES})

    inside = values.mapInPandas(run, "b long, v double, few boolean")
    cuts = inside.where("not few").groupBy("b").agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 100 * parts).alias("p")).select(F.explode("p").alias("v"))
    return np.unique(inside.where("few").select("v").unionAll(cuts).toArrow()["v"].to_numpy())  # bounded by the blocks asked for
