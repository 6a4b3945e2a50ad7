"""Table, schema and row-order operators, merges with their constraints, and the time axis in long form (obs, time, value)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.operators.rank import ranked

MOST_PERIODS = 200


def name_is_valid(name: str) -> bool:
    """One to ten characters: a letter, then letters, digits or underscores."""
    return re.fullmatch("[A-Za-z][A-Za-z0-9_]{0,9}", name) is not None


def has_column(df: DataFrame, name: str) -> bool:
    return name.lower() in (c.lower() for c in df.columns)


def add_variable(df: DataFrame, name: str, kind: str, default=None) -> DataFrame:
    if has_column(df, name):
        raise ValueError(f"{name} exists")
    return df.withColumn(name, F.lit(default).cast(kind))


def delete_variable(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    if old.lower() != new.lower() and has_column(df, new):
        raise ValueError(f"{new} exists")
    return df.withColumnRenamed(old, new)


def number_range(length: int, decimals: int) -> tuple[float, float]:
    """The least and greatest number of a field: a sign and a point take a place each."""
    whole = length - (decimals + 1 if decimals else 0)
    step = 10.0**-decimals
    return -(10.0 ** (whole - 1) - step), 10.0**whole - step


def clamp(x: str, length: int, decimals: int) -> Column:
    low, high = number_range(length, decimals)
    return F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x).cast("double"), F.lit(low)), F.lit(high)))


def truncate(x: str, length: int) -> Column:
    return F.substring(x, 1, length)


def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    return df.select(*order, *[c for c in df.columns if c not in order])


def add_unique_id(df: DataFrame, key: str, out: str) -> DataFrame:
    return ranked(df, key, out, ties=[key])


def is_unique(df: DataFrame, key: str) -> bool:
    """No key twice and none missing; one partial sum per key, no distinct sort."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) | F.col(key).isNull()).limit(1).count() == 0


def sort_rows(df: DataFrame, x: str, key: str, descending: bool = False) -> DataFrame:
    """Ties in record order; NULLs first when ascending, last when descending."""
    return df.orderBy(F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_first(), key)


def reverse_rows(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col(key).desc())


def selected_first(df: DataFrame, key: str, selected: str = "selected") -> DataFrame:
    return df.orderBy(F.col(selected).desc(), key)


def distinct_names(taken: list[str], names: list[str]) -> dict[str, str]:
    """New names for those that clash: `NAME (k)`."""
    used, out = {t.lower() for t in taken}, {}
    for name in names:
        new, k = name, 1
        while new.lower() in used:
            new, k = f"{name} ({k})", k + 1
        used.add(new.lower())
        out[name] = new
    return out


def merge_by_order(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Row i beside row i, both in order of their keys; counts must be equal."""
    a, b = ranked(left, left_key, "_row", ties=[left_key]), ranked(right, right_key, "_row", ties=[right_key])
    if left.count() != right.count():
        raise ValueError("the tables have different numbers of rows")
    for old, new in distinct_names(left.columns, right.columns).items():
        b = b.withColumnRenamed(old, new)
    return a.join(b, "_row").drop("_row")


def merge_by_key(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One-to-one merge: unique keys of one type and the same set on both sides, after trimming strings."""
    kinds = dict(left.dtypes)[left_key], dict(right.dtypes)[right_key]
    if kinds[0] != kinds[1]:
        raise ValueError("the keys have different types")
    clean = (lambda c: F.trim(c)) if kinds[0] == "string" else (lambda c: c)
    a, b = left.withColumn("_key", clean(F.col(left_key))), right.withColumn("_key", clean(F.col(right_key)))
    counts = a.select("_key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(b.select("_key", F.lit(0), F.lit(1))).groupBy("_key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    bad = counts.where("l <> 1 or r <> 1").first()
    if bad:
        raise ValueError(f"key {bad['_key']} stands {bad['l']} times in the left table and {bad['r']} times in the right one")
    for old, new in distinct_names(left.columns, [c for c in right.columns if c != right_key]).items():
        b = b.withColumnRenamed(old, new)
    return a.join(b.drop(right_key), "_key").drop("_key")


def group_to_time(df: DataFrame, key: str, columns: dict[str, int], value: str = "v", time: str = "time_id") -> DataFrame:
    """Columns of one type become one variable over time, in long form."""
    if len({dict(df.dtypes)[c] for c in columns}) > 1:
        raise ValueError("the columns have different types")
    pairs = ", ".join(f"{t}, `{c}`" for c, t in columns.items())
    return df.selectExpr(key, f"stack({len(columns)}, {pairs}) as ({time}, {value})")


def time_to_columns(long: DataFrame, key: str, periods: list[int], value: str = "v", time: str = "time_id", prefix: str = "v_") -> DataFrame:
    """The wide form; the periods are given, so no extra pass collects them."""
    wide = long.groupBy(key).pivot(time, periods).agg(F.first(value))
    return wide.select(key, *[F.col(f"`{p}`").alias(f"{prefix}{p}") for p in periods])


def check_space_time(df: DataFrame, key: str, time: str) -> DataFrame:
    """Validation as one row: n_rows, n_space, n_time, duplicates, ok (unique pairs and at most 200 periods)."""
    pairs = df.groupBy(key, time).agg(F.count(F.lit(1)).alias("c"))
    found = pairs.agg(F.sum("c").alias("n_rows"), F.countDistinct(key).alias("n_space"), F.countDistinct(time).alias("n_time"), F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("duplicates"))
    return found.withColumn("ok", (F.col("duplicates") == 0) & (F.col("n_time") <= MOST_PERIODS))


def space_time_join(space: DataFrame, time: DataFrame, key: str) -> DataFrame:
    """The 1-n match of a space table and its time table; every time row must match and space ids must be unique."""
    if not is_unique(space, key):
        raise ValueError("space ids repeat")
    if time.join(space, key, "left_anti").limit(1).count():
        raise ValueError("a row of the time table has no space id")
    return space.join(time, key)


def time_slice(long: DataFrame, period: int, time: str = "time_id") -> DataFrame:
    return long.where(F.col(time) == period)


def align(long: DataFrame, key: str, variables: dict[str, int], time: str = "time_id", synced: dict[str, bool] | None = None) -> DataFrame:
    """Variables beside each other at their offsets to the reference time; only periods where all exist, unsynced ones fixed at their offset's period."""
    synced = synced or {}
    periods = long.select(time).distinct().withColumn("_i", F.row_number().over(Window.orderBy(time)) - 1)  # at most 200 rows
    numbered = long.join(F.broadcast(periods), time)
    out = None
    for name, offset in variables.items():
        part = numbered.where(F.col(name).isNotNull() | F.lit(True))
        if synced.get(name, True):
            part = part.select(key, (F.col("_i") - offset).alias("_i"), F.col(name))
            out = part if out is None else out.join(part, [key, "_i"])
        else:
            fixed = part.where(F.col("_i") == offset).select(key, F.col(name))
            out = fixed if out is None else out.join(fixed, key)
    return out.withColumnRenamed("_i", "time_idx")


def ranges(long: DataFrame, value: str = "v", time: str = "time_id") -> DataFrame:
    """Per period: min_v, max_v, and those over all time."""
    each = long.groupBy(time).agg(F.min(value).alias("min_v"), F.max(value).alias("max_v"))
    return each.crossJoin(F.broadcast(each.agg(F.min("min_v").alias("min_all"), F.max("max_v").alias("max_all"))))


def edit_cell(df: DataFrame, key: str, row, name: str, value) -> DataFrame:
    return df.withColumn(name, F.when(F.col(key) == row, F.lit(value).cast(dict(df.dtypes)[name])).otherwise(F.col(name)))


def save_columns(df: DataFrame, result: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """Write result columns into new columns of the table, or over existing ones."""
    if len({n.lower() for n in names.values()}) < len(names):
        raise ValueError("a name stands twice")
    part = result.select(F.col(key), *[F.col(a).alias(f"_new_{b}") for a, b in names.items()])
    found = df.join(part, key, "left")
    for b in names.values():
        found = found.withColumn(b, F.col(f"_new_{b}")).drop(f"_new_{b}")
    return found
