"""The numbers behind exploratory views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.functions.calc import standardize
from arealis.functions.stats import f_tail, simple_regression, t_two_sided
from arealis.operators.rank import attach, hinges, ranked


def histogram(df: DataFrame, x: str, bins: int = 7, by: list[str] | None = None, common: bool = True, selected: str | None = None) -> DataFrame:
    """Counts in equal bins, the last one closed; constant data is widened by 0.5 either way. Empty bins are absent. Columns bin (from 1), low, high, n[, n_selected]."""
    by = by or []
    aggs = [F.min(x).alias("_a"), F.max(x).alias("_b")]
    edges = df.groupBy(*by).agg(*aggs) if by and not common else df.agg(*aggs)
    flat = F.col("_a") == F.col("_b")
    edges = edges.select(*([] if common else by), F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).cast("double").alias("_a"), F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).cast("double").alias("_b"))
    found = attach(df.where(F.col(x).isNotNull()), edges, None if common else by).withColumn("_w", (F.col("_b") - F.col("_a")) / bins)
    found = found.withColumn("bin", F.least(F.floor((F.col(x) - F.col("_a")) / F.col("_w")), F.lit(bins - 1)).cast("int") + 1)
    out = [F.count(F.lit(1)).alias("n")] + ([F.sum(F.col(selected).cast("int")).alias("n_selected")] if selected else [])
    return found.groupBy(*by, "bin", (F.col("_a") + (F.col("bin") - 1) * F.col("_w")).alias("low"), (F.col("_a") + F.col("bin") * F.col("_w")).alias("high")).agg(*out)


def integer_histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Whole-number bins of ceil((max - min + 1) / bins) values each: bin, low, high, n."""
    edges = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b")).withColumn("_w", F.ceil((F.col("_b") - F.col("_a") + 1) / bins))
    found = attach(df.where(F.col(x).isNotNull()), edges).withColumn("bin", F.floor((F.col(x) - F.col("_a")) / F.col("_w")).cast("int") + 1)
    return found.groupBy("bin", (F.col("_a") + (F.col("bin") - 1) * F.col("_w")).alias("low"), (F.col("_a") + F.col("bin") * F.col("_w") - 1).alias("high")).agg(F.count(F.lit(1)).alias("n"))


def box_plot(df: DataFrame, x: str, key: str, hinge: float = 1.5, by: list[str] | None = None) -> DataFrame:
    """Hinges, fences, mean, and the number of outliers on both sides."""
    h = hinges(df, x, key, by).withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({"low_fence": F.col("q1") - hinge * F.col("iqr"), "high_fence": F.col("q3") + hinge * F.col("iqr")})
    found = attach(df.select(*(by or []), x), h, by)
    keys = h.columns
    return found.groupBy(*keys).agg(F.sum(F.when(F.col(x) < F.col("low_fence"), 1).otherwise(0)).alias("n_low"), F.sum(F.when(F.col(x) > F.col("high_fence"), 1).otherwise(0)).alias("n_high"))


def chow_test(df: DataFrame, x: str, y: str, selected: str = "selected") -> DataFrame:
    """F of separate lines for selected and other rows against one line; NULL with fewer than two rows on either side."""
    one = simple_regression(df, x, y).select(F.col("sse").alias("sse_c"), F.col("n").alias("n_all"))
    two = simple_regression(df, x, y, [selected]).agg(F.sum("sse").alias("sse_u"), F.min("n").alias("least"), F.count(F.lit(1)).alias("sides"))
    found = one.crossJoin(F.broadcast(two))
    ok = (F.col("sides") == 2) & (F.col("least") >= 2)
    return found.select(F.when(ok, F.try_divide((F.col("sse_c") - F.col("sse_u")) * (F.col("n_all") - 4), 2 * F.col("sse_u"))).alias("f"), F.lit(2).alias("df1"), (F.col("n_all") - 4).alias("df2"))


def chow_p(f: float, n: int) -> float:
    return f_tail(f, 2, n - 4)


def slope_p(t: float, n: int) -> float:
    return t_two_sided(t, n - 2)


def bubbles(df: DataFrame, size: str, largest: float = 20.0) -> DataFrame:
    """radius: circle areas follow the standardised third variable, moved to be positive."""
    z = standardize(df, size, "_z")
    ends = z.agg(F.min("_z").alias("_a"), F.max("_z").alias("_b"))
    found = z.crossJoin(F.broadcast(ends))
    return found.withColumn("radius", largest * F.sqrt(F.coalesce(F.try_divide(F.col("_z") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(1.0)) * 0.99 + 0.01)).drop("_z", "_a", "_b")


def parallel_coordinates(df: DataFrame, key: str, variables: list[str], standard: bool = False) -> DataFrame:
    """Long form (key, variable, value) rescaled to 0..100, or to 0..100 around the mean by the largest deviation."""
    long = df.selectExpr(key, f"stack({len(variables)}, " + ", ".join(f"'{v}', cast({v} as double)" for v in variables) + ") as (variable, raw)")
    if standard:
        z = standardize(long, "raw", "_z", ["variable"])
        ends = z.agg(F.max(F.abs("_z")).alias("_m"))
        return z.crossJoin(F.broadcast(ends)).select(key, "variable", F.coalesce(50 + 50 * F.try_divide("_z", "_m"), F.lit(50.0)).alias("value"))
    ends = long.groupBy("variable").agg(F.min("raw").alias("_a"), F.max("raw").alias("_b"))
    return long.join(F.broadcast(ends), "variable").select(key, "variable", F.coalesce(100 * F.try_divide(F.col("raw") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(50.0)).alias("value"))


def scatter_3d(df: DataFrame, key: str, variables: list[str]) -> DataFrame:
    """Each variable rescaled to [-1, 1]."""
    ends = df.agg(*[f(v).alias(f"_{n}_{v}") for v in variables for n, f in (("a", F.min), ("b", F.max))])
    scaled = [F.coalesce(2 * F.try_divide(F.col(v) - F.col(f"_a_{v}"), F.col(f"_b_{v}") - F.col(f"_a_{v}")) - 1, F.lit(0.0)).alias(v) for v in variables]
    return df.crossJoin(F.broadcast(ends)).select(key, *scaled)


def select_box(scaled: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    test = F.lit(True)
    for name, (low, high) in box.items():
        test = test & F.col(name).between(low, high)
    return scaled.withColumn("selected", test)


def _third(x: str, distinct: int, stats: dict) -> Column:
    """0, 1 or 2: halves for two values, midpoints for three, thirds of the range otherwise."""
    low, high = stats["low"], stats["high"]
    if distinct <= 1:
        return F.lit(0)
    if distinct == 2:
        return F.when(F.col(x) < (low + high) / 2, 0).otherwise(1)
    if distinct == 3:
        a, b = (low + stats["mid"]) / 2, (stats["mid"] + high) / 2
    else:
        a, b = low + (high - low) / 3, low + 2 * (high - low) / 3
    return F.when(F.col(x) < a, 0).when(F.col(x) < b, 1).otherwise(2)


def conditional_cells(df: DataFrame, across: str, up: str) -> DataFrame:
    """cell 1..9 of two conditioning variables: column + 3 * row + 1, rows counted from the top."""
    parts = []
    for x in (across, up):
        values = [r[0] for r in df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v")).distinct().orderBy("v").limit(4).collect()]
        ends = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
        parts.append(_third(x, len(values), {"low": ends[0], "high": ends[1], "mid": values[1] if len(values) == 3 else None}))
    return df.withColumn("cell", (parts[0] + 3 * (2 - parts[1]) + 1).cast("int"))


def cartogram_radius(df: DataFrame, x: str, scale: float = 1.0) -> DataFrame:
    """Circle areas are 10 to 110 parts by the place of x in its range."""
    ends = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    area = 10 + 100 * F.coalesce(F.try_divide(F.col(x) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("radius", scale * F.sqrt(area / math.pi)).drop("_a", "_b")


def cartogram(circles: list[tuple[float, float, float]], links: list[tuple[int, int]], rounds: int = 500, friction: float = 0.3):
    """Places of circles (x, y, r) after `rounds` of forces: overlaps push apart, linked circles pull together. Driver side: each round needs the one before."""
    import numpy as np

    c = np.array(circles, "f8")
    at, r = c[:, :2].copy(), c[:, 2]
    reach = r[:, None] + r[None, :]
    near = np.zeros((len(c), len(c)), bool)
    for i, j in links:
        near[i, j] = near[j, i] = True
    speed = np.zeros_like(at)
    for _ in range(rounds):
        gap = at[:, None] - at[None, :]
        d = np.sqrt((gap**2).sum(2)) + np.eye(len(c))
        push = np.clip(reach - d, 0, None) * (1 - np.eye(len(c)))
        pull = np.where(near, np.clip(d - reach, 0, None), 0) * 0.1
        force = ((push - pull) / d)[:, :, None] * gap
        speed = friction * speed + 0.25 * force.sum(1)
        at += speed
    return at


def movie(df: DataFrame, x: str, key: str, cumulative_to: int | None = None) -> DataFrame:
    """frame: the place of each observation in ascending order; up to a frame when cumulative."""
    found = ranked(df, x, "frame", ties=[key])
    return found if cumulative_to is None else found.where(F.col("frame") <= cumulative_to)


def axis_ticks(low: float, high: float, most: int = 10) -> list[float]:
    """Round steps of 1, 2 or 5 times a power of ten that cover the range."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    raw = (high - low) / most
    power = 10.0 ** math.floor(math.log10(raw))
    step = next(s * power for s in (1, 2, 5, 10) if s * power >= raw - 1e-12 * power)
    first, last = math.floor(low / step + 1e-9), math.ceil(high / step - 1e-9)
    return [round(k * step, 12) for k in range(first, last + 1)]
