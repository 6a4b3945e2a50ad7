"""Suffix-array dedup: remove every byte that a repeated string of `width` bytes covers.

Texts are sharded by content: the windows under one anchor (see anchors.py) meet in one shard, so equal strings always do. A
shard's distinct segments form one string with marks between them; its suffix array is built by induced sorting, common prefixes are
computed in text order, and a window is repeated if a neighbour in the array shares `width` bytes with it.

Strings are judged on the input, not on what is left; matches never cross texts. Bytes left are joined as they are, so a cut may
fall inside a character.

Defined results: null and empty texts have no bytes; texts shorter than `width` are kept whole; a text with copies is removed whole
if it has `width` bytes; repeated rows give repeated results. Columns besides the id and the text don't take part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm import anchors
from arealis.llm.common import Scratch, store, text_key, text_or_empty
from arealis.llm.suffix_array import permuted_prefixes, suffix_array

#: Bytes of one shard's string, but for a group that is longer.
SHARD_BYTES = 1 << 19


def repeated_windows(segments: list[bytes], copies: list[int], width: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur elsewhere in the shard."""
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"\0".join(segments) + b"\0\0", "u1").astype("u2") + 2  # 2 marks an end, 0 the end of all
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    marks = starts + sizes
    text[marks] = 1
    text[-1] = 0
    order = suffix_array(text, 258, width)
    prefix = permuted_prefixes(text, order, int(sizes.max()) + 1)
    following = np.zeros(len(text), "i4")
    following[order[:-1]] = prefix[order[1:]]
    hit = np.maximum(prefix, following) >= width
    return [np.ones(n - width + 1, bool) if c > 1 else hit[s : s + n - width + 1] for s, n, c in zip(starts, sizes, copies, strict=True)]


def dedup(docs: DataFrame, width: int = 400, gram: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, a, b (the text's key), n_bytes, n_removed, n_spans, kept (null where nothing is removed)."""
    unit = anchors.Unit(False, width, gram)
    with Scratch() as scratch:
        runs = store(anchors.scan(docs, unit, text_col), "suffix-runs")
        kept = anchors.candidates(docs, runs, anchors.shared_keys(runs), "suffix-texts", text_col)
        spans = anchors.repeated(kept, unit, lambda s, c: repeated_windows(s, c, width), SHARD_BYTES, "suffix")
        changed = scratch.keep(store(anchors.removal(kept, spans, unit), "suffix-removed", compression="zstd"))
    text = text_or_empty(text_col)
    a, b = text_key(text)
    rows = docs.select(F.col(id_col), a.alias("a"), b.alias("b"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole_sha256"))
    copies = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    out = rows.join(changed, ["a", "b"], "left").join(copies, ["a", "b"], "left")
    all_gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= width)
    return out.select(id_col, "a", "b", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(all_gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "whole_sha256")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"))
