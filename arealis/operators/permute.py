"""Conditional permutation at scale.

Each permutation p of a group is one pseudo-random ordering of its values, the same for all observations: a keyed bijection gives
the place of its j-th value, so nothing is sorted and only the first (greatest degree + 1) values are ever looked up. An observation with
k neighbours takes the first k values of every ordering. Where its own value is among them, that one is left out and the next one comes in,
so that each observation draws k distinct others uniformly, as the definition asks; only draws of different observations hang together.

Observations of one degree share the means of all permutations, so the work is one comparison for each observation and permutation, in
the JVM, and tables of permutations x degrees; no value leaves the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from arealis.operators.cut import cut, dealt
from arealis.operators.rank import hashed_rank

#: Bytes of a table that goes to every task, and copies of it that share the rows of one degree beyond that.
BROADCAST_BYTES, COPIES = 64 << 20, 64
#: Bytes that a drawn value takes in such a table, with its key.
DRAWN_BYTES = 128
ROUNDS = 8


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place(j: np.ndarray, n: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """The j-th place in a pseudo-random ordering of 0..n-1 named by `stream`, for 0 <= j < n: a Feistel network that is walked until it falls below n."""
    j, n, stream = (np.asarray(a).astype("u8") for a in (j, n, stream))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype("f8")) / 2)).astype("u8")
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = j.copy(), np.arange(len(j))
    with np.errstate(over="ignore"):
        while len(open_):
            h, m, s = half[open_], mask[open_], stream[open_]
            left, right = out[open_] >> h, out[open_] & m
            for r in range(ROUNDS):
                left, right = right, left ^ (_mixed(right + s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r) * np.uint64(0xD1342543DE82EF95)) & m)
            out[open_] = (left << h) | right
            open_ = open_[out[open_] >= n[open_]]
    return out.astype("i8")


@F.pandas_udf(LongType())
def _place(j: pd.Series, n: pd.Series, stream: pd.Series) -> pd.Series:
    return pd.Series(place(j.to_numpy(), n.to_numpy(), stream.to_numpy()))


def conditional_p(found: DataFrame, key: str, value: str, tests: dict[str, tuple[Column, Column, Column]], permutations: int = 499, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Add for each test (a, b, statistic) the pseudo p of `a + b * mean of k others >= statistic`.

    `found` has one row for each key (and group of `by`) with its number of neighbours k. Draws come from the values of the group that are
    not NULL and depend on the seed and the keys alone, not on partitions or retries. p is NULL for isolates, for a statistic of NULL, and where fewer
    than k other values exist. Test columns may use any column of `found`.
    """
    by = by or []
    found = cut(found)
    pool = cut(hashed_rank(found.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("_v")), F.pmod(F.xxhash64(key), F.lit(4096)), [F.col(key)], "_at", by))
    live = found.where("k > 0")
    sizes = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else pool.agg(F.count(F.lit(1)).alias("_n"))
    most = live.groupBy(*by).agg(F.max("k").alias("_most")) if by else live.agg(F.max("k").alias("_most"))
    spec = sizes.join(most, by) if by else sizes.crossJoin(most)
    spec = spec.where("_n > 0 and _most > 0")
    perms = found.sparkSession.range(1, permutations + 1).select(F.col("id").alias("perm"))
    draws = perms.crossJoin(spec).select(*by, "perm", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_most", F.col("_n") - 1).cast("long"))).alias("_j"))
    draws = draws.withColumn("_at", _place("_j", "_n", F.xxhash64(F.lit(seed), "perm", *by)) + 1)
    order = Window.partitionBy(*by, "perm").orderBy("_j")
    sums = {"_s": F.sum("_v").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_p": F.sum("_v").over(order.rowsBetween(Window.unboundedPreceding, -1))}
    drawn = cut(draws.join(pool.withColumnRenamed(key, "_who"), [*by, "_at"]).withColumns(sums).select(*by, "perm", "_j", "_who", "_v", "_s", "_p"))

    # At place k of an ordering, _p is the sum of the first k values and _s that of one more.
    degrees = live.select(*by, "k").distinct()
    at_k = drawn.select(*by, "perm", F.col("_j").alias("k"), "_p", "_s").join(degrees, [*by, "k"])
    means = cut(at_k.groupBy(*by, "k").agg(F.collect_list(F.col("_p") / F.col("k")).alias("_means")))
    # At most one row for each permutation and place, whatever the number of observations.
    few = F.broadcast if drawn.count() * DRAWN_BYTES <= BROADCAST_BYTES else dealt
    own = live.select(*by, key, "k").join(few(drawn.select(*by, "perm", F.col("_who").alias(key), "_j", F.col("_v").alias("_own"))), [*by, key]).where("_j < k")
    both = own.join(at_k, [*by, "perm", "k"]).select(*by, key, F.struct((F.col("_p") / F.col("k")).alias("was"), ((F.col("_s") - F.col("_own")) / F.col("k")).alias("now")).alias("e"))
    changed = both.groupBy(*by, key).agg(F.collect_list("e").alias("_changed"))  # at most one for each permutation

    # The means come last: a row that carries them has 8 bytes for each permutation, so it is neither shuffled nor sorted.
    wide = found.join(few(changed), [*by, key], "left").withColumn("_changed", F.coalesce("_changed", F.expr("cast(array() as array<struct<was: double, now: double>>)")))
    if means.count() * permutations * 8 <= BROADCAST_BYTES:
        wide = wide.join(F.broadcast(means), [*by, "k"], "left")
    else:
        copies = means.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
        wide = wide.withColumn("_copy", F.pmod(F.xxhash64(key), F.lit(COPIES)).cast("int")).join(dealt(copies), [*by, "k", "_copy"], "left").drop("_copy")
    out = {}
    for name, (a, b, stat) in tests.items():
        reached = lambda get: lambda e: F.coalesce(a + b * get(e) >= stat, F.lit(False))  # noqa: B023, E731
        c = F.size(F.filter("_means", reached(lambda e: e))) + F.size(F.filter("_changed", reached(lambda e: e["now"]))) - F.size(F.filter("_changed", reached(lambda e: e["was"])))
        out[name] = F.when(F.col("_means").isNotNull() & stat.isNotNull(), (F.least(c, permutations - c) + 1) / (permutations + 1))
    return wide.withColumns(out).select(*found.columns, *out)


#: Places that a task computes at once, and draws of one permutation that are compared with each other; more come from a bijection.
AT_ONCE, COMPARED = 1 << 18, 24


def _own_streams(keys: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """A stream for each observation (by the hash of its key) and permutation: keys x perms."""
    with np.errstate(over="ignore"):
        return _mixed(_mixed(keys.astype("i8").view("u8"))[:, None] + perms.astype("u8")[None, :] * np.uint64(0x9E3779B97F4A7C15))


def _distinct(k: int, m: int, stream: np.ndarray) -> np.ndarray:
    """k distinct places below m for each stream, every set of k as likely as any other: k x streams.

    A few are drawn by Floyd's method: the i-th is uniform below m - k + i + 1, or m - k + i itself if that one is taken.
    """
    if k > COMPARED:
        return place(np.tile(np.arange(k), len(stream)), np.full(k * len(stream), m), np.repeat(stream, k)).reshape(len(stream), k).T
    steps = np.arange(1, k + 1, dtype="u8")[:, None]
    with np.errstate(over="ignore"):
        mixed = _mixed(stream[None, :] + steps * np.uint64(0xD1342543DE82EF95))
    at = ((mixed >> np.uint64(12)).astype("f8") * ((m - k + steps.astype("f8")) * 2.0**-52)).astype("i8")
    for i in range(1, k):
        taken = at[0] == at[i]
        for j in range(1, i):
            taken |= at[j] == at[i]
        if taken.any():
            at[i, taken] = m - k + i
    return at


def _means(values: np.ndarray, k: int, own: int | np.ndarray, stream: np.ndarray) -> np.ndarray:
    """The mean of k distinct others in each permutation; `own` is the observation's place among the values (one, or one for each stream), or -1 for all."""
    there = bool(np.all(np.asarray(own) >= 0))
    at = _distinct(k, len(values) - there, stream)
    if there:
        at += at >= own
    return values[at].mean(0)


@F.pandas_udf(ArrayType(LongType()))
def _places(k: pd.Series, m: pd.Series, stream: pd.Series) -> pd.Series:
    ks, ms, streams, out = k.to_numpy(), m.to_numpy(), stream.to_numpy("i8").view("u8"), np.empty(len(k), object)
    for a, b in set(zip(ks.tolist(), ms.tolist(), strict=True)):
        rows = np.flatnonzero((ks == a) & (ms == b))
        for r, at in zip(rows, _distinct(a, b, streams[rows]).T, strict=True):
            out[r] = at
    return pd.Series(out)


def independent_p(found: DataFrame, key: str, value: str, tests: dict[str, tuple[Column, Column, Column]], permutations: int = 499, seed: int = 42, by: list[str] | None = None, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As `conditional_p`, but every observation draws anew in every permutation, so that p values of neighbours don't hang together.

    The places of the draws come from hashes of seed, observation and permutation, those of many neighbours from a bijection keyed by them. While the values of all groups take at most
    `most_bytes`, they go to every task and nothing is shuffled; beyond that the places are joined with the table of values. Both give the same draws.
    """
    by = by or []
    spec = {f"_t{i}{c}": x.cast("double") for i, t in enumerate(tests.values()) for c, x in zip("abs", t, strict=True)}
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    found = cut(found.withColumn("_g", group))
    pool = cut(hashed_rank(found.where(F.col(value).isNotNull()).select("_g", key, F.col(value).cast("double").alias("_v")), F.pmod(F.xxhash64(key), F.lit(4096)), [F.col(key)], "_at", ["_g"]).withColumn("_at", F.col("_at") - 1))
    sizes = pool.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    placed = found.withColumns(spec).withColumn("_h", F.xxhash64(F.lit(seed), key, *by)).join(dealt(pool.select("_g", key, F.col("_at").alias("_own"))), ["_g", key], "left").join(sizes, "_g", "left")
    drawing = (F.col("k") > 0) & (F.col("_n") - F.when(F.col("_own").isNotNull(), 1).otherwise(0) >= F.col("k"))
    live = placed.where(drawing).select("_g", key, "_h", F.col("k").cast("long").alias("k"), F.coalesce("_own", F.lit(-1)).alias("_own"), "_n", *spec)
    names, inputs, kind = list(tests), list(spec), found.schema[key].dataType.simpleString()
    if pool.count() * 8 <= most_bytes:
        values = {}
        for batch in pool.select("_g", "_at", "_v").toArrow().to_pandas().groupby("_g"):  # checked to be at most most_bytes
            values[batch[0]] = batch[1].sort_values("_at")["_v"].to_numpy()
        perms = np.arange(1, permutations + 1)

        def run(batches):
            for pdf in batches:
                counts, (h, owns) = np.zeros((len(pdf), len(names)), "i8"), (pdf[c].to_numpy("i8") for c in ("_h", "_own"))
                lines = {c: pdf[c].to_numpy("f8") for c in inputs}
                for (g, k, there), rows in pdf.groupby(["_g", "k", owns >= 0]).indices.items():
                    step = max(1, AT_ONCE // (int(k) * permutations))
                    part = max(1, min(permutations, AT_ONCE // int(k)))
                    for of in (rows[i : i + step] for i in range(0, len(rows), step)):
                        for some in (perms[i : i + part] for i in range(0, permutations, part)):
                            own = np.repeat(owns[of], len(some)) if there else -1
                            means = _means(values[g], int(k), own, _own_streams(h[of], some).ravel()).reshape(len(of), len(some))
                            for t in range(len(names)):
                                a, b, s = (lines[f"_t{t}{c}"][of][:, None] for c in "abs")
                                counts[of, t] += (a + b * means >= s).sum(1)
                yield pd.DataFrame({"_g": pdf["_g"], key: pdf[key], **{f"_c{t}": counts[:, t] for t in range(len(names))}})

        # the rows are few for what they cost, so they are dealt to more tasks than their size asks for
        hits = live.repartition(4 * found.sparkSession.sparkContext.defaultParallelism, key).mapInPandas(run, f"_g string, `{key}` {kind}, " + ", ".join(f"_c{t} long" for t in range(len(names))))
    else:
        own_stream = F.pandas_udf(lambda h, p: pd.Series(_mixed(_mixed(h.to_numpy("i8").view("u8")) + p.to_numpy("u8") * np.uint64(0x9E3779B97F4A7C15)).view("i8")), LongType())
        draws = live.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_s", own_stream("_h", F.col("perm").cast("long")))
        draws = draws.withColumn("_at", F.explode(_places("k", F.col("_n") - F.when(F.col("_own") >= 0, 1).otherwise(0), "_s")))
        draws = draws.withColumn("_at", F.col("_at") + F.when((F.col("_own") >= 0) & (F.col("_at") >= F.col("_own")), 1).otherwise(0))
        means = draws.select("_g", key, "perm", "_at", *spec).join(dealt(pool.select("_g", "_at", "_v")), ["_g", "_at"]).groupBy("_g", key, "perm", *spec).agg(F.avg("_v").alias("_m"))
        reached = lambda t: F.coalesce(F.col(f"_t{t}a") + F.col(f"_t{t}b") * F.col("_m") >= F.col(f"_t{t}s"), F.lit(False))
        hits = means.groupBy("_g", key).agg(*[F.sum(F.when(reached(t), 1).otherwise(0)).alias(f"_c{t}") for t in range(len(names))])
    out = {n: F.when(tests[n][2].isNotNull(), (F.least(F.col(f"_c{t}"), permutations - F.col(f"_c{t}")) + 1) / (permutations + 1)) for t, n in enumerate(names)}
    return found.join(dealt(hits), ["_g", key], "left").withColumns(out).select(*[c for c in found.columns if c != "_g"], *out)
