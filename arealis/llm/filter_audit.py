"""Filter interaction audit: what each of five text filters removes, alone and after the others, in every order.

1. Word pipeline: the words of each distinct text are exploded and counted by (text, word), then by text, for totals and
   distincts. A text stands for its rows by 128 bits; copies meet before the shuffle, which deals whole texts, so neither
   count shuffles words.
2. Row side: rows are counted by (text, part, labels) with the flags of characters and the least id, before their shuffle.
   No join is on a text with all its copies, only with one row for each part and label.
3. The word counts are outer-joined to the row side (a text of separators has none), each text's least id tells the rows that
   fail as copies, and 32 conditional counts a part, one for each set of failed filters, answer for all 120 orders.

Filters (a row fails): A under 50 words; B distinct words under 65 % of the words; C capitals over 5 % of the characters;
D one of #$%&*|; E its text stands with a smaller id.

Defined results: a null text is empty, and an empty one fails A (and E, but for the least id); a null part counts as ""; a null id
is smaller than none and none is smaller, so its row doesn't fail E; rows that repeat an id and text all count, and those of the
least id all pass E; of several labels of an id, one that is 1 counts; a table without rows gives none; other columns take no part,
whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import shielded, text_key, text_or_empty

FILTERS = "ABCDE"
#: What parts words, and the signs of filter D.
GAP, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
KINDS = 1 << len(FILTERS)


def word_totals(texts: DataFrame) -> DataFrame:
    """(a, b, words, distinct) of texts (a, b, text) that lie dealt by (a, b); texts without words give no row."""
    words = texts.select("a", "b", F.explode(F.split("text", GAP)).alias("word")).where("word <> ''")
    return words.groupBy("a", "b", "word").agg(F.count(F.lit(1)).alias("c")).groupBy("a", "b").agg(F.sum("c").alias("words"), F.count(F.lit(1)).alias("distinct"))


def _set_of(fails: dict[str, Column]) -> Column:
    """The failed filters as bits, A the lowest."""
    return sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS) if f in fails), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part: good and toxic rows and all rows for each set of failed filters, as arrays g, t and n of 32 counts."""
    own, (key, body, group) = shielded(docs, id_col, text_col, part)
    text = text_or_empty(body)
    a, b = text_key(text)
    texts = own.select(a.alias("a"), b.alias("b"), text.alias("text")).groupBy("a", "b").agg(F.first("text").alias("text"))
    known = labels.groupBy(F.col(id_col).alias("known")).agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    signed = {"C": 100 * capitals > 5 * F.char_length(text), "D": text.rlike(SIGNS)}
    rows = own.select(F.col(key).alias("id"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("part"), a.alias("a"), b.alias("b"), _set_of(signed).alias("signed"))
    rows = rows.groupBy("id", "part", "a", "b", "signed").agg(F.count(F.lit(1)).alias("c"))
    no = F.lit(False)
    rows = rows.join(known, rows.id == known.known, "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    # of each text, by part and labels: rows, the least id with its rows, and rows without an id
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c")))
    kinds = rows.groupBy("a", "b", "part", "signed", "good", "toxic").agg(F.sum("c").alias("c"), least.alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("bare"))
    firsts = kinds.groupBy("a", "b").agg(F.min("least.id").alias("first"))
    joined = kinds.join(firsts, ["a", "b"]).join(word_totals(texts), ["a", "b"], "left").withColumns({"words": F.coalesce("words", F.lit(0)), "distinct": F.coalesce("distinct", F.lit(0))})
    worded = {"A": F.col("words") < 50, "B": 100 * F.col("distinct") < 65 * F.col("words")}
    kept = F.col("bare") + F.when(F.col("least.id") == F.col("first"), F.col("least.c")).otherwise(0)
    failed = joined.withColumn("failed", _set_of(worded) + F.col("signed")).select("part", "good", "toxic", "failed", "c", kept.alias("kept"))
    last = KINDS >> 1
    counts = [F.sum(F.when(F.col("failed") == m % last, F.col("c") - F.col("kept") if m >= last else F.col("kept")).otherwise(0)).alias(f"m{m}") for m in range(KINDS)]
    wide = failed.groupBy("part", "good", "toxic").agg(*counts)
    total = lambda test: F.array(*[F.sum(F.when(test, F.col(f"m{m}")).otherwise(0)) for m in range(KINDS)])
    return wide.groupBy("part").agg(total(F.lit(True)).alias("n"), total(F.col("good")).alias("g"), total(F.col("toxic")).alias("t"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, the step's filter and those before it as bits) for all 120 orders of five filters."""
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(p), s, bits[p[s - 1]], sum(bits[f] for f in p[: s - 1])) for p in permutations(FILTERS) for s in range(1, len(FILTERS) + 1)]


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    found = failures(docs, labels, part, id_col, text_col)
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, bit int, before int")
    every = found.crossJoin(F.broadcast(steps))  # 600 rows, whatever the input

    def summed(column: str, test: str, worth: str = "x") -> Column:
        return F.expr(f"aggregate(transform({column}, (x, m) -> if({test}, {worth}, 0L)), 0L, (p, q) -> p + q)")

    here = "(m & bit) <> 0 and (m & before) = 0"
    first = f"x * {len(orders()) // len(FILTERS)} div bit_count(m)"  # orders in which a filter is the first of a failed set
    return every.select(
        "part",
        "filter_order",
        "step",
        summed("n", "(m & (before | bit)) = 0").alias("kept"),
        summed("n", here).alias("removed"),
        summed("n", "(m & bit) <> 0 and (m & before) <> 0").alias("redundant"),
        summed("n", "m = bit").alias("unique_fails"),
        summed("g", here).alias("good_lost"),
        summed("t", here).alias("toxic_lost"),
        summed("n", "(m & bit) <> 0", first).alias("shapley"),
    )
