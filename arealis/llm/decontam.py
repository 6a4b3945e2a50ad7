"""Benchmark decontamination through a positional inverted index, in DataFrame operations only.

1. Count, over all documents, how often each word of the benchmark occurs (partial sums before the shuffle).
2. For each window of an item take its two rarest words. Scan the documents once and store the postings (text, position,
   words around it) of those that stand beside a neighbour which the item has too; a window of two words or more holds one.
   Each text also stores its length, as the posting of an end mark, and every place of the rarest words, whatever is beside.
3. Shift the lists of the rarest word to window starts, intersect them with the shifted lists of the second, and compare
   the words around what is left: exact phrases.
4. Pair the places of a window's two rarest words that stand near each other in a text, in any order: proximity matches.
5. Merge the intervals of each text and count. Proximity matches are listed beside the exact ones and don't contaminate.

Texts stand for their rows by 128 bits of hash, so copies are searched once. The benchmark's tables are broadcast only
when their counted rows stay under BROADCAST_ROWS; larger ones are joined by shuffles.

Defined results: null and empty texts have no words and no hits; an item without words has no window; repeated items count
once by id; an item without an id marks words but is not listed. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.common import store, text_key, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the benchmark's tables (each under 200 bytes) that may be broadcast.
BROADCAST_ROWS = 200_000
END = "\u0000"


def words_of(text: Column) -> Column:
    """Lower only A-Z, then cut into words."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), GAP), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    words = words_of(text_or_empty(text_col))
    return benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("w")).withColumn("k", F.xxhash64(F.coalesce("item", F.lit(END)), "w")).dropDuplicates(["k"]).where(F.size("w") > 0)


def _windows(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """One row for each window that can occur: k, s, n (words), q1, w1, q2, w2, phrase."""
    placed = items.select("k", "w", F.posexplode("w").alias("q", "word")).join(counts, "word", "left")
    frame = Window.partitionBy("k").orderBy("q").rowsBetween(0, width - 1)
    n = F.least(F.size("w"), F.lit(width))
    seen = placed.withColumn("found", F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word", "q")).over(frame))).withColumn("n", n).where(F.col("q") + n <= F.size("w"))
    seen = seen.where(F.element_at("found", 1)["df"] > 0)
    first, second = F.element_at("found", 1), F.element_at("found", F.least(F.lit(2), F.size("found")))
    return seen.select("k", F.col("q").alias("s"), "n", first["q"].alias("q1"), first["word"].alias("w1"), second["q"].alias("q2"), second["word"].alias("w2"), F.expr("slice(w, q + 1, n)").alias("phrase"))


def build_index(docs: DataFrame, items: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The windows of the items, and the stored postings of their rarest words."""
    text = text_or_empty(text_col)
    a, b = text_key(text)
    read = docs.select(F.col(id_col).alias("id"), a.alias("a"), b.alias("b"), words_of(text).alias("w"))
    vocabulary = items.select(F.explode("w").alias("word")).distinct()
    size = items.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    counts = read.select(F.explode("w").alias("word")).join(_small(vocabulary, size), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    windows = store(_windows(items, counts, width), "decontam-windows")
    around = items.select("k", F.posexplode("w").alias("q", "word"), "w").withColumns({"before": F.expr("if(q > 0, w[q - 1], null)"), "after": F.expr("if(q + 1 < size(w), w[q + 1], null)"), "alone": F.size("w") == 1}).drop("w")
    used = windows.select("k", F.col("q1").alias("q")).union(windows.select("k", F.col("q2").alias("q"))).distinct()
    anchors = around.join(used, ["k", "q"], "left_semi").withColumn("free", F.lit(False))
    schema = "k long, q int, word string, before string, after string, alone boolean, free boolean"
    ends = docs.sparkSession.createDataFrame([(None, None, END, None, None, True, False)], schema)
    none = lambda kind: F.lit(None).cast(kind)
    rare = windows.where("q1 <> q2").select(F.explode(F.array("w1", "w2")).alias("word")).distinct()
    free = rare.select(none("long").alias("k"), none("int").alias("q"), "word", none("string").alias("before"), none("string").alias("after"), F.lit(False).alias("alone"), F.lit(True).alias("free"))
    spots = anchors.select(ends.columns).union(ends).union(free)
    placed = read.select("id", "a", "b", "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("p", "word"))
    near = F.expr("t.free or t.alone or (p > 0 and w[p - 1] = t.before) or (p + 1 < size(w) and w[p + 1] = t.after)")
    found = placed.join(_small(spots, 2 * size).alias("t"), "word").where(near)
    around_words = F.expr(f"if(free or word = '\\0', null, slice(w, greatest(p + 1 - {width - 1}, 1), {2 * width - 1} - greatest({width - 1} - p, 0)))")
    index = found.select(F.when(F.col("word") == END, F.col("id")).alias("id"), "a", "b", "k", "q", "p", around_words.alias("near"), F.when(F.col("free"), F.col("word")).alias("word"))
    return windows, store(index, "decontam-postings")


def matches(windows: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """Exact phrases: distinct (a, b, k, start, n)."""
    postings = index.where(F.col("k").isNotNull()).drop("id", "word")
    few = windows.count()
    spots = lambda q: _small(windows.withColumnRenamed(q, "q"), few)
    first = postings.join(spots("q1"), ["k", "q"]).select("a", "b", "k", "s", "n", "phrase", "near", "p", (F.col("p") - F.col("q") + F.col("s")).alias("start"))
    second = postings.drop("near").join(spots("q2"), ["k", "q"]).select("a", "b", "k", "s", (F.col("p") - F.col("q") + F.col("s")).alias("start")).distinct()
    same = F.expr(f"start >= 0 and slice(near, start - greatest(p - {width - 1}, 0) + 1, n) = phrase")
    return first.where(same).select("a", "b", "k", "s", "n", "start").distinct().join(second, ["a", "b", "k", "s", "start"], "left_semi").select("a", "b", "k", "start", "n").distinct()


def _near_words(windows: DataFrame, index: DataFrame, within: int) -> DataFrame:
    """Places of two rarest words of some window at most `within` words apart: a, b, lo and hi (words in order), x, p, y, at (p < at)."""
    words = index.where(F.col("word").isNotNull()).select("a", "b", "word", "p").distinct()
    ahead = Window.partitionBy("a", "b").orderBy("p").rangeBetween(1, within)
    seen = words.withColumn("next", F.collect_list(F.struct(F.col("word").alias("y"), F.col("p").alias("at"))).over(ahead))
    pairs = seen.select("a", "b", F.col("word").alias("x"), "p", F.explode("next").alias("e")).select("a", "b", "x", "p", "e.y", "e.at")
    wanted = windows.where("q1 <> q2").select(F.least("w1", "w2").alias("lo"), F.greatest("w1", "w2").alias("hi")).distinct()
    return pairs.withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")}).join(_small(wanted, windows.count()), ["lo", "hi"], "left_semi")


def proximity(windows: DataFrame, index: DataFrame, within: int) -> DataFrame:
    """Windows whose two rarest words stand at most `within` words apart in a text, in any order: a, b, k, s, p1, p2 (p1 < p2 if they are one word)."""
    pairs = windows.where("q1 <> q2").select("k", "s", "w1", F.least("w1", "w2").alias("lo"), F.greatest("w1", "w2").alias("hi"))
    met = _near_words(windows, index, within).join(_small(pairs, windows.count()), ["lo", "hi"])
    straight = F.col("x") == F.col("w1")
    return met.select("a", "b", "k", "s", F.when(straight, F.col("p")).otherwise(F.col("at")).alias("p1"), F.when(straight, F.col("at")).otherwise(F.col("p")).alias("p2")).distinct()


def near_items(windows: DataFrame, index: DataFrame, within: int) -> DataFrame:
    """Distinct (a, b, k): items with a window in `proximity`, without its places."""
    pairs = windows.where("q1 <> q2").select("k", F.least("w1", "w2").alias("lo"), F.greatest("w1", "w2").alias("hi")).distinct()
    return _near_words(windows, index, within).select("a", "b", "lo", "hi").distinct().join(_small(pairs, windows.count()), ["lo", "hi"]).select("a", "b", "k").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", within: int | None = None) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items (sorted), near_items (sorted), n_near, contaminated (some hit, and share * n_hit >= n_words).

    Near items have a window whose two rarest words stand at most `within` (`width` if not given) words apart in the text.
    """
    items = store(_items(benchmark, item_col, item_text), "decontam-items")
    windows, index = build_index(docs, items, width, id_col, text_col)
    hits = store(matches(windows, index, width), "decontam-hits")
    by_start = Window.partitionBy("a", "b").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("a", "b", "start", (F.col("start") + F.col("n")).alias("stop")).distinct().withColumn("reach", F.max("stop").over(by_start))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("reach", F.lit(0))))
    marked = spans.groupBy("a", "b").agg(F.sum(fresh).alias("n_hit"))
    listed = hits.join(items.select("k", "item"), "k").where(F.col("item").isNotNull()).groupBy("a", "b").agg(F.sort_array(F.collect_set("item")).alias("items"))
    beside = near_items(windows, index, within or width).join(items.select("k", "item"), "k").where(F.col("item").isNotNull()).groupBy("a", "b").agg(F.sort_array(F.collect_set("item")).alias("near_items"))
    lengths = index.where(F.col("k").isNull() & F.col("word").isNull()).select("id", "a", "b", F.col("p").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = lengths.join(marked, ["a", "b"], "left").join(listed, ["a", "b"], "left").join(beside, ["a", "b"], "left").select(F.col("id").alias(id_col), "a", "b", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    return out.withColumn("n_near", F.size("near_items").cast("long")).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
