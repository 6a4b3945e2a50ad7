"""Order statistics without a one-task sort.

A global rank needs no unpartitioned window: values are dealt into ranges between approximate quantiles (of numbers) or between
members of a sample (of strings), the counts of the ranges are added up, and rows are ranked within their range. A range that holds
one value only, such as a value that most rows have, is dealt again by ranges of the tie column. With `by` the window
is already partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least number of ranges of a column, and the most.
RANGES, MOST_RANGES = 64, 1024
SAMPLE = 8


def _number(df: DataFrame, column: str) -> Column:
    """A column as a double; dates as days since 1970."""
    return (F.unix_date(column) if dict(df.dtypes)[column] == "date" else F.col(column)).cast("double")


def _cuts(df: DataFrame, column: str, ranges: int) -> DataFrame:
    """One row: the places where the ranges of a column meet, in order; at most `ranges` of them."""
    known = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    if dict(df.dtypes)[column] == "string":
        drawn = known.orderBy(F.xxhash64("v"), "v").limit(SAMPLE * ranges).agg(F.sort_array(F.collect_list("v")).alias("c"))
        return drawn.select(F.filter("c", lambda _, i: i % SAMPLE == SAMPLE - 1).alias("_cuts"))
    return known.agg(F.coalesce(F.percentile_approx(_number(known, "v"), [k / ranges for k in range(1, ranges)], 10 * ranges), F.expr("cast(array() as array<double>)")).alias("_cuts"))


def _ranged(df: DataFrame, column: str, out: str, ranges: int) -> DataFrame:
    """Add the number of a row's range, -1 for NULL."""
    value = F.col(column) if dict(df.dtypes)[column] == "string" else _number(df, column)
    over = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < value))
    return df.crossJoin(F.broadcast(_cuts(df, column, ranges))).withColumn(out, F.when(F.col(column).isNull(), F.lit(-1)).otherwise(over)).drop("_cuts")


def ranked(df: DataFrame, value: str, out: str, by: list[str] | None = None, ties: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Add the 1-based rank (a long) of `value` (then of `ties`); NULLs come first, last if descending."""
    columns = list(dict.fromkeys([value, *(ties or [])]))
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in columns]
    if by:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    ranges = min(MOST_RANGES, max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    second = columns[1] if len(columns) > 1 else value
    binned = _ranged(_ranged(df, value, "_bin", ranges), second, "_tie", RANGES) if second != value else _ranged(df, value, "_bin", ranges).withColumn("_tie", F.lit(0))
    sizes = binned.groupBy("_bin", "_tie").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # bounded by the ranges of both columns
    same = Window.partitionBy("_bin")
    sizes = sizes.withColumn("_part", F.when(F.coalesce(F.min("_lo").over(same) == F.max("_hi").over(same), F.lit(True)), F.col("_tie")).otherwise(0))
    step = [F.col(c).desc() if descending else F.col(c).asc() for c in ("_bin", "_part")]
    offsets = sizes.groupBy("_bin", "_part").agg(F.sum("_n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    places = sizes.select("_bin", "_tie", "_part").join(offsets, ["_bin", "_part"])
    within = F.row_number().over(Window.partitionBy("_bin", "_part").orderBy(*order))
    return binned.join(F.broadcast(places), ["_bin", "_tie"]).withColumn(out, within.cast("long") + F.col("_before")).drop("_bin", "_tie", "_part", "_before")


def hashed_rank(df: DataFrame, bucket: Column, order: list[Column], out: str, by: list[str] | None = None) -> DataFrame:
    """Add the 1-based rank (a long) by bucket, then by `order`, within each group of `by`.

    Buckets come from a hash, so they split a large group evenly; there are few enough of them that their offsets are added up by one task for each group.
    """
    by = by or []
    binned = df.withColumn("_bin", bucket)
    sizes = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(*order)).cast("long")
    offsets = sizes.withColumn("_before", before).drop("_n")
    return binned.withColumn("_within", within).join(offsets, [*by, "_bin"]).withColumn(out, F.col("_within") + F.col("_before")).drop("_bin", "_within", "_before")


def _positions(df: DataFrame, x: str, by: list[str], key: str) -> DataFrame:
    """Non-null values with rank r and count n; dates as days since 1970."""
    clean = df.where(F.col(x).isNotNull())
    clean = clean.withColumn(x, _number(df, x)) if dict(df.dtypes)[x] == "date" else clean
    r = ranked(clean, x, "_r", by=by, ties=[key])
    n = clean.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else clean.agg(F.count(F.lit(1)).alias("_n"))
    return r.join(F.broadcast(n) if not by else n, by) if by else r.crossJoin(F.broadcast(n))


def hinges(df: DataFrame, x: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Tukey hinges q1, q2, q3 with n, min, max, mean: each the mean of the values at the floor and ceiling of its position."""
    by = by or []
    p = _positions(df, x, by, key)
    n, even = F.col("_n"), F.col("_n") % 2 == 0
    at = {"q2": (n + 1) / 2, "q1": F.when(even, (n + 2) / 4).otherwise((n + 3) / 4), "q3": F.when(even, (3 * n + 2) / 4).otherwise((3 * n + 1) / 4)}
    pick = [((F.max(F.when(F.col("_r") == F.floor(e), F.col(x))) + F.max(F.when(F.col("_r") == F.ceil(e), F.col(x)))) / 2).alias(k) for k, e in at.items()]
    aggs = [F.count(F.lit(1)).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), *pick]
    return p.groupBy(*by).agg(*aggs) if by else p.agg(*aggs)


def legacy_quartiles(df: DataFrame, x: str, key: str, by: list[str] | None = None) -> DataFrame:
    """The other quartiles: positions (n + 1) / 4 and 3 (n + 1) / 4 in whole numbers; the extremes below 5 values."""
    by = by or []
    p = _positions(df, x, by, key)
    low = F.when(F.col("_n") < 5, F.lit(1)).otherwise(F.floor((F.col("_n") + 1) / 4))
    high = F.when(F.col("_n") < 5, F.col("_n")).otherwise(F.floor(3 * (F.col("_n") + 1) / 4))
    aggs = [F.max(F.when(F.col("_r") == low, F.col(x))).alias("q1"), F.max(F.when(F.col("_r") == high, F.col(x))).alias("q3")]
    return p.groupBy(*by).agg(*aggs) if by else p.agg(*aggs)


def hazen(df: DataFrame, x: str, key: str, percents: list[float], by: list[str] | None = None) -> DataFrame:
    """Percentiles with p_i = 100 (i - 0.5) / n and linear interpolation, clamped at both ends: columns p0, p1, ... in order."""
    by = by or []
    p = _positions(df, x, by, key)
    out = []
    for k, percent in enumerate(percents):
        spot = F.least(F.greatest(F.lit(percent) * F.col("_n") / 100 + 0.5, F.lit(1.0)), F.col("_n").cast("double"))
        low, high = F.floor(spot), F.ceil(spot)
        a, b = F.max(F.when(F.col("_r") == low, F.col(x))), F.max(F.when(F.col("_r") == high, F.col(x)))
        out.append((a + (b - a) * F.max(spot - low)).alias(f"p{k}"))
    return p.groupBy(*by).agg(*out) if by else p.agg(*out)


def attach(df: DataFrame, stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Put one row of statistics (or one for each group) beside every row."""
    return df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))


def in_order(*pairs: tuple[Column, int], default: int) -> Column:
    """The class of the first test that holds."""
    out = F
    for test, value in pairs:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(default))
