"""Token ids as ORC files, and their reading by stripes.

Texts are dealt out by ranges of the id and sorted before they are encoded, so that each file holds a range of ids in
ascending order and needs no second shuffle. A file's columns are the id and the list of token ids; ORC packs
both with integer run-length codes, keeps minima and maxima of each row group in its row index and a Bloom filter on the
id, so that a reader can skip stripes by range or by membership. Stripes are read in parallel.

Words of a text are cut at ASCII white space, which the tokenizer drops and no token crosses. The words of a batch are
numbered in Arrow; each distinct one is looked up once, and goes to the tokenizer once while the memo holds it.

Defined results: null and empty texts hold the end id alone. Rows with equal ids stay, in any order among them;
a null id sorts first.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache
from struct import Struct, pack
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealis.llm.common import map_rows, store, store_path, text_or_empty

#: Entries of a generation of the memo of words; the generation before is kept.
MEMO = 300_000
#: Byte-level vocabularies write bytes that are no visible Latin-1 characters as letters from U+0100 on, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
#: Letters below U+0250 in lower case, digits one by one, and runs of ASCII that are neither: what the splitter makes of plain words.
PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff\u0100-\u024f]+)|([0-9])|([!-&(-/:-@[-`{-~]+)")
#: Symbols that form one piece of their own when they follow a letter at a word's end.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Text bytes whose words are numbered together.
BATCH_BYTES = 8 << 20
_PACKS = [Struct(f"<{n}I").pack for n in range(9)]
STRIPE_BYTES = 16 << 20


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.tokenize = self.tokenizer.model.tokenize
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.folds = self._folds()

    def _folds(self) -> bool:
        """Does the tokenizer lower A-Z, drop ASCII white space and split plain words as PLAIN does?"""
        same = all(self.ids("A Word, is.") == self.ids(x) for x in ("a word , is .", "a\tWORD,\nIs.", "a\x0bword,\x0cis."))
        return same and all(self._plain(w) == pack(f"<{len(i := self.ids(w))}I", *i) for w in ("tokens", "\u00e9t\u00e9\u00df", "ab12c$$$..x_y", "(3.14)--a@b"))

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, piece: str) -> bytes:
        ids = [t.id for t in self.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return _PACKS[len(ids)](*ids) if len(ids) < 9 else pack(f"<{len(ids)}I", *ids)

    def _plain(self, word: str) -> bytes | None:
        """The ids of a word of plain characters, piece by piece; None for others, which are left to the library."""
        if not word.isascii() and (max(word) >= "\u0250" or word.lower() != word or not is_normalized("NFC", word)):
            return None
        if word.isalpha() and word.islower():
            return self._letters(word)
        stem = word.rstrip(TAIL)
        if stem and stem.isalpha() and stem.islower():  # a word and its stops
            if (known := self.memo.get(stem)) is None:
                known = self.memo[stem] = self.old.get(stem) or self._letters(stem)
            return known + self._symbols(word[len(stem) :])
        out, at = [], 0
        for m in PLAIN.finditer(word):
            if m.start() != at or m.lastindex == 1 and not m[0].isalpha():
                return None
            at = m.end()
            out.append(self._letters(m[0]) if m.lastindex == 1 else self._symbols(m[0]))
        return b"".join(out) if at == len(word) and "<|" not in word else None

    def _symbols(self, piece: str) -> bytes:
        if (known := self.parts.get(piece)) is None:
            if len(self.parts) >= MEMO:
                self.parts.clear()
            known = self.parts[piece] = self._letters(piece)
        return known

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each distinct word, from the memo or from the library."""
        if len(self.memo) >= MEMO:
            self.old, self.memo = self.memo, {}
        memo, old, rest = self.memo, self.old, []
        for word in words:
            if word not in memo:
                known = old.get(word)
                if known is None and self.folds:
                    known = self._plain(word)
                if known is None:
                    rest.append(word)
                else:
                    memo[word] = known
        for word, found in zip(rest, self.batch(rest, add_special_tokens=False) if rest else [], strict=True):
            memo[word] = np.asarray(found.ids, "<u4").tobytes()
        return [memo[w] for w in words]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets of the texts in it; end_id stands after each text.

        A-Z are lowered at once but in texts with combining marks, which are composed first, and in those that may hold special
        tokens. The distinct words of all texts together are looked up once each.
        """
        if self.folds:
            apart = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, r"\p{M}"))
            words = pc.ascii_split_whitespace(pc.if_else(apart, texts, pc.ascii_lower(texts)))
        else:
            words = pa.array([[t] for t in texts.to_pylist()], pa.list_(pa.string()))
        bounds, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
        known = self._learn(coded.dictionary.to_pylist())
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), "i8", len(known)) // 4
        of = coded.indices.to_numpy()
        each = sizes[of]
        stops = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[of] - stops[:-1], each) + np.arange(stops[-1])]
        offsets = stops[bounds]
        if end_id is not None:
            ids, offsets = np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
        return ids, offsets


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row and write ORC files (id, ids) under `out`, in ascending order of the id over files and within them."""

    def rows(part: pa.RecordBatch) -> dict:
        flat, offsets = encoder(tokenizer).encode(part.column("text"), end_id)
        return {"id": part.column("id"), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(flat.astype("i4")))}

    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id")
    encoded = map_rows(dealt, "text", f"id {kind}, ids array<int>", rows, BATCH_BYTES)
    encoded.write.options(**{"orc.bloom.filter.columns": "id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(STRIPE_BYTES), "orc.compress": "ZSTD"}).orc(out)


def read_tokens(spark, path: str, id_type: str = "bigint") -> DataFrame:
    """The stored rows (id, ids); filters on the id reach row indexes and Bloom filters."""
    return spark.read.schema(f"id {id_type}, ids array<int>").orc(path)


def token_offsets(stored: DataFrame) -> DataFrame:
    """Per stored row: id, start (ids of all rows before it), n_tokens, ids_crc32.

    Sums run within files, which hold ranges of ids; over files only one row for each is added up.
    """

    def rows(part: pa.RecordBatch) -> dict:
        lists = part.column("ids")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        return {"id": part.column("id"), "file": part.column("file"), "n_tokens": np.diff(offsets), "ids_crc32": [zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]}

    kind = stored.schema["id"].dataType.simpleString()
    named = stored.select("id", "ids", F.col("_metadata.file_name").alias("file"))
    sums = store(map_lists(named, f"id {kind}, file string, n_tokens long, ids_crc32 long", rows), "orc-sums")
    files = sums.groupBy("file").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file").select("id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def map_lists(df: DataFrame, schema: str, rows) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            out = rows(batch)
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def stored_offsets(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the tokens of docs into the shared folder and derive the offsets from the files."""
    spark = docs.sparkSession
    out = store_path(spark, "orc-tokens")
    write_tokens(docs, out, tokenizer, end_id, id_col, text_col)
    return token_offsets(read_tokens(spark, out, docs.schema[id_col].dataType.simpleString())).withColumnRenamed("id", id_col)
