"""Substring dedup with a log-structured fingerprint index.

Each batch of texts becomes one sorted, immutable run: the hashes of its sampled windows (each window's anchor, see anchors.py),
each once with its least and greatest place, bucketed and sorted by hash. Places are added up before the shuffle, so a window that
fills a third of the corpus is one row a task. A new run is merge-joined with the runs before it, bucket by bucket and without a
shuffle; hashes seen in two places are noted. Windows under noted hashes are verified word by word. Compaction merges the runs
into one; later batches meet that one. A run also keeps the places themselves and the keys of its texts with their copies, as they
were scanned.

An index lives in a folder of the shared store. Every change ends with a new manifest, which lists the live runs and
is renamed into place, so a crash leaves the state before; `FingerprintIndex.open` takes the last one up, in any session.

A word is removed if a window of `width` words that covers it starts anywhere else too, in the same text or another, judged on
the input. Words left are joined by one space.

Defined results: null and empty texts have no words; texts of fewer than `width` words are kept whole; texts with copies are
removed whole if they have `width` words; repeated rows give repeated results; texts with no repeated window have a null `kept`.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.llm import anchors
from arealis.llm.common import PLAIN, Scratch, discard, file_system, save, store, store_path, text_key, text_or_empty

WORD_GAP = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 4 << 20
PLACES = "key long, a long, b long, place int, first int, n int"
GRAMS, TEXTS = "key long, x long, y long", "a long, b long, copies long"


class FingerprintIndex:
    """Sorted runs of window hashes in a folder, and the hashes found in two places."""

    def __init__(self, spark: SparkSession, unit: anchors.Unit, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.unit, self.path = spark, unit, path or store_path(spark, "fingerprints")
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)  # a gram is 24 bytes
        #: Live folders: merged or fresh gram runs, batches of places and texts, and noted hashes.
        self.state: dict[str, list[str]] = {"grams": [], "batches": [], "noted": []}
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that the last manifest in `path` describes."""
        last = spark.read.text(f"{path}/manifest-*.json", wholetext=True).withColumn("name", F.col("_metadata.file_name")).orderBy(F.desc("name")).first()
        told = json.loads(last["value"])
        index = cls(spark, anchors.Unit(*told["unit"]), path, told["buckets"])
        index.state, index.version = told["state"], told["version"]
        return index

    def _commit(self) -> None:
        self.version += 1
        told = {"unit": [self.unit.words, self.unit.width, self.unit.gram], "buckets": self.buckets, "state": self.state, "version": self.version}
        fs, jvm = file_system(self.spark, self.path), self.spark._jvm
        rough, final = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}manifest-{self.version:08d}.json") for x in (".", ""))
        out = fs.create(rough, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if not fs.rename(rough, final):
            raise OSError(f"another writer has already made {final}")

    def _write_grams(self, rows: DataFrame) -> str:
        name = f"grams_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "key").sortWithinPartitions("key").write.options(**PLAIN).bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _grams(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # made by another session
            self.spark.sql(f"CREATE TABLE {name} (key BIGINT, x BIGINT, y BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def ingest(self, docs: DataFrame, text_col: str = "text") -> None:
        """Append a batch as a run; note hashes that it repeats or that earlier runs hold."""
        batch = uuid.uuid4().hex
        save(anchors.scan(docs, self.unit, text_col), f"{self.path}/places_{batch}")
        a, b = text_key(text_or_empty(text_col))
        save(docs.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("copies")), f"{self.path}/texts_{batch}")
        place = F.xxhash64("a", "b", "place")
        grams = self._write_grams(self.spark.read.schema(PLACES).parquet(f"{self.path}/places_{batch}").groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y")))
        fresh = self._grams(grams)
        noted = fresh.where("x < y").select("key")
        for old in self.state["grams"]:
            before = self._grams(old).select("key", F.col("x").alias("p"), F.col("y").alias("q"))
            noted = noted.unionAll(before.join(fresh, "key").where("least(x, p) < greatest(y, q)").select("key"))
        save(noted.distinct(), f"{self.path}/noted_{batch}")
        self.state = {"grams": [*self.state["grams"], grams], "batches": [*self.state["batches"], batch], "noted": [*self.state["noted"], f"noted_{batch}"]}
        self._commit()

    def keys(self) -> DataFrame:
        """The hashes that stand in two places."""
        return self._read("key long", self.state["noted"]).distinct()

    def places(self) -> DataFrame:
        """The runs of all texts: key, a, b, place, first, n."""
        return self._read(PLACES, [f"places_{b}" for b in self.state["batches"]])

    def texts(self) -> DataFrame:
        """The keys of all texts with their copies: a, b, copies."""
        return self._read(TEXTS, [f"texts_{b}" for b in self.state["batches"]]).groupBy("a", "b").agg(F.sum("copies").alias("copies"))

    def forget(self) -> None:
        """Delete the grams and places of an index that takes no more batches; the keys of its texts stay."""
        for name in self.state["grams"]:
            self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, *(f"{self.path}/{n}" for n in (*self.state["grams"], *self.state["noted"], *(f"places_{b}" for b in self.state["batches"]))))
        self.state = {"grams": [], "batches": self.state["batches"], "noted": []}
        self._commit()

    def _read(self, schema: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def compact(self) -> None:
        """Merge the gram runs into one, and the noted hashes; the old ones go once the new manifest stands."""
        old = self.state
        merged = self._grams(old["grams"][0])
        for name in old["grams"][1:]:
            merged = merged.unionAll(self._grams(name))
        noted = f"noted_{uuid.uuid4().hex}"
        save(self.keys(), f"{self.path}/{noted}")
        self.state = {**old, "grams": [self._write_grams(merged.groupBy("key").agg(F.min("x").alias("x"), F.max("y").alias("y")))], "noted": [noted]}
        self._commit()
        for name in old["grams"]:
            self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, *(f"{self.path}/{n}" for n in (*old["grams"], *old["noted"])))


def repeated_windows(segments: list[bytes], copies: list[int], width: int) -> list[np.ndarray]:
    """For each segment, which of its windows occur elsewhere, compared word by word."""
    windows, seen = [], defaultdict(int)
    for segment, n in zip(segments, copies, strict=True):
        parts = segment.split(b" ")
        own = [b" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1)]
        for w in own:
            seen[w] += n
        windows.append(own)
    return [np.array([seen[w] > 1 for w in own], bool) for own in windows]


def dedup(docs: DataFrame, width: int = 35, gram: int = 6, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, a, b (the text's key), n_words, n_removed, kept (null where nothing is removed), whole_sha256."""
    index = FingerprintIndex(docs.sparkSession, anchors.Unit(True, width, gram))
    for k in range(batches):
        index.ingest(docs.where(F.pmod(F.xxhash64(F.lit(11), text_or_empty(text_col)), F.lit(batches)) == k), text_col)
    index.compact()
    out = _decided(docs, docs, index, id_col, text_col)
    index.forget()
    return out


def append(index: FingerprintIndex, docs: DataFrame, history: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Take a new batch into an index that holds `history`, and give dedup's rows for the batch, judged against all of both."""
    index.ingest(docs, text_col)
    return _decided(docs, history.select(F.col(text_col)).unionAll(docs.select(F.col(text_col))), index, id_col, text_col)


def _decided(docs: DataFrame, corpus: DataFrame, index: FingerprintIndex, id_col: str, text_col: str) -> DataFrame:
    unit = index.unit
    with Scratch() as scratch:
        kept = anchors.candidates(corpus, index.places(), index.keys(), "fingerprint-texts", text_col)
        spans = anchors.repeated(kept, unit, lambda s, c: repeated_windows(s, c, unit.width), BLOCK_BYTES, "fingerprint")
        changed = scratch.keep(store(anchors.removal(kept, spans, unit), "fingerprint-removed", compression="zstd"))
    text = text_or_empty(text_col)
    a, b = text_key(text)
    rows = docs.select(F.col(id_col), a.alias("a"), b.alias("b"), F.size(words_of(text)).cast("long").alias("n_words"), F.sha2(F.array_join(words_of(text), " "), 256).alias("whole_sha256"))
    copies = index.texts().where("copies > 1")
    out = rows.join(changed, ["a", "b"], "left").join(copies, ["a", "b"], "left")
    all_gone = F.col("copies").isNotNull() & (F.col("n_words") >= unit.width)
    return out.select(id_col, "a", "b", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(all_gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "whole_sha256")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed", F.coalesce(F.sha2("kept", 256), "whole_sha256").alias("kept_sha256"))
