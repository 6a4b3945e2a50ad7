"""A training-text pipeline: each stage takes (spark, docs, sf_dir) and gives the documents that it keeps.

quality: rows that the classifier scores under its threshold go. near_duplicates: of each group that links join, one row stays, that
of the smallest id (then of the smaller hash of the text; rows without an id come last); rows without words stay. substrings:
words under windows that occur more than once go, texts without such windows stay as they are. decontaminate: texts under the
contamination rule go. tokens: the token ids of what is left, with their count.

Defined results, for each stage: a null text counts as empty; repeated rows are one group of near duplicates and repeated elsewhere;
a table without rows stays one; columns besides the id and the text are carried through all but the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.llm import byte_bpe, decontam, nbsvm, ngram_jaccard, window_index
from arealis.llm.common import shielded, store, table, text_key, text_or_empty

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, (key, text) = shielded(docs, "doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(key), "quality")
    return nbsvm.classify(own, labels, id_col=key, text_col=text).where("predicted = 1").select(own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, (key, text) = shielded(docs, "doc_id", "text")
    found = ngram_jaccard.groups(own, id_col=key, text_col=text)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")
    kept = found.where("n > 0").groupBy("comp").agg(F.min(first).alias("m")).select("m.id", "m.a", "m.b")
    a, b = text_key(text_or_empty(text))
    marked = own.withColumns({"key_a": a, "key_b": b})
    wordy = marked.join(kept, marked[key].eqNullSafe(kept.id) & (marked.key_a == kept.a) & (marked.key_b == kept.b), "left_semi").dropDuplicates([key, "key_a", "key_b"])
    bare = marked.where(~text_or_empty(text).rlike(r"[^\x20\x09-\x0D]"))
    return wordy.unionByName(bare).select(own.columns).toDF(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, (key, text) = shielded(docs, "doc_id", "text")
    changed = window_index.dedup(own, id_col=key, text_col=text).where("kept is not null").select("a", "b", F.col("kept").cast("string").alias("left_over")).distinct()
    a, b = text_key(text_or_empty(text))
    out = own.join(changed, [a == changed.a, b == changed.b], "left").withColumn(text, F.coalesce("left_over", text))
    return out.select(own.columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, (key, text) = shielded(docs, "doc_id", "text")
    found = decontam.contamination(own, table(spark, sf_dir, "benchmark"), id_col=key, text_col=text)
    bad = found.where("contaminated").select("a", "b").distinct()
    a, b = text_key(text_or_empty(text))
    return own.join(bad, [a == bad.a, b == bad.b], "left_anti").toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=False)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontaminate", decontaminate), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
