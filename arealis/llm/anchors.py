"""Windows of fixed width that occur more than once: what byte-wise and word-wise substring dedup share.

A window's anchor is the place of the least hash among the short grams inside it. Equal windows have equal anchors at equal
offsets, so a window can only occur twice if its anchor's gram does. Consecutive windows with one anchor make a run. Per text:

1. scan: each text gives its runs (gram hash, place, first window, number of windows);
2. shared grams: those that stand in two places; texts with such runs are kept with their runs (`candidates`);
3. segments: the units under a run, named by 128 bits. All windows of a segment with two places are repeated; that takes counts only;
4. a segment of one place may share windows with other segments of its gram. Only of grams with such segments do bytes move, once
   for each distinct segment; those of one gram meet in one task, sorted by gram, and are matched exactly there;
   grams with more than HOT of them are cut into pieces of fewer windows, whose common units make finer keys, and so on down to
   single windows, which are counted by 128 bits each;
5. the answers go back to the texts that hold the segments.

Copies of a text are one text here; whether a text has copies is known from counts.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.common import map_rows, release, store, text_key, text_or_empty

#: Segments of one gram that one task may hold.
HOT = 2000
#: Grams with more than that may be broadcast up to this number (8 bytes each).
FREQUENT = 100_000
#: Windows of a piece, from coarse to fine.
CHUNKS = (32, 4)
#: Units that are hashed at once; texts of more are cut with overlaps.
BLOCK = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that split words; the others make them up.
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True
_TABLE = np.random.default_rng(20240101).integers(0, 1 << 64, (64, 256), dtype="u8")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * MULTIPLIER


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive symbols, put together from spans of powers of two."""
    if len(symbols) < k:
        return np.empty(0, "u8")
    span, power, width = symbols, MULTIPLIER, 1
    out, held = None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                out = span if out is None else out[: len(out) - width] * power + span[held:]
                held += width
            if held == k:
                return mix(out[: len(symbols) - k + 1])
            span = span[: len(span) - width] * power + span[width:]
            power, width = power * power, width * 2


def runs_of(symbols: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, place, first window, windows) of each run of windows of `width` symbols."""
    found = []
    for at in range(0, max(len(symbols) - width + 1, 0), BLOCK):
        h = gram_hashes(symbols[at : at + BLOCK + width - 1], k)
        low, reach, want = (h & ~np.uint64(0x1FFFFF)) | np.arange(len(h), dtype="u8"), 1, width - k + 1
        while reach * 2 <= want:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < want:
            low = np.minimum(low[: len(low) - (want - reach)], low[want - reach :])
        place = (low & np.uint64(0x1FFFFF)).astype("i8")
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((h[place[first]].view("i8"), place[first] + at, first + at, np.diff(np.append(first, len(place)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, "i8"),) * 4


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words, and a hash of each."""
    b = np.frombuffer(data, "u1")
    if not len(b):
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "u8")
    inside = ~GAPS[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).view("i1"))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, "u8")
    at = np.flatnonzero(inside)
    offset = at - np.repeat(starts, ends - starts)
    with np.errstate(over="ignore"):
        code = _TABLE[offset & 63, b[at]] * (np.uint64(2) * (offset >> 6).astype("u8") + np.uint64(1))
        lengths = ends - starts
        return starts, ends, mix(np.add.reduceat(code, np.concatenate([[0], np.cumsum(lengths)[:-1]])) + lengths.astype("u8"))


class Unit:
    """What a window counts: bytes or words. `symbols` and `cut` read a text; `size` counts its units."""

    def __init__(self, words: bool, width: int, gram: int) -> None:
        self.words, self.width, self.gram = words, width, gram

    def symbols(self, data: bytes) -> np.ndarray:
        return word_spans(data)[2] if self.words else np.frombuffer(data, "u1").astype("u8") + np.uint64(1)

    def segments(self, data: bytes, runs: list[dict]) -> list[bytes]:
        """The units under each run; words are joined by one space."""
        parts = data.split() if self.words else None
        ends = [(r["first"], r["first"] + r["n"] + self.width - 1) for r in runs]
        return [b" ".join(parts[i:j]) if self.words else data[i:j] for i, j in ends]

    def windows(self, segment: bytes) -> list[bytes]:
        w = self.width
        if not self.words:
            return [segment[i : i + w] for i in range(len(segment) - w + 1)]
        parts = segment.split()
        return [b" ".join(parts[i : i + w]) for i in range(len(parts) - w + 1)]


    def pieces(self, segment: bytes, key: int, off: int, chunk: int) -> Iterator[tuple[int, int, bytes]]:
        """(key, index of the first window, units) of the windows whose offsets from the anchor fall into one chunk; the units they all hold make the key."""
        import xxhash

        units = segment.split(b" ") if self.words else segment
        glue = b" ".join if self.words else bytes
        last = len(units) - self.width
        for c in range(off // chunk, (off + last) // chunk + 1):
            at = c * chunk - off
            i, j = max(0, at), min(last, at + chunk - 1)
            core = glue(units[at + chunk - 1 : at + self.width])
            yield xxhash.xxh3_64_intdigest(core + struct.pack("<qq", key, c)) - (1 << 63), i, glue(units[i : j + self.width])


def intervals(flags: np.ndarray) -> list[int]:
    """First and last index of each stretch of set flags, flat."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).view("i1"))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], 1).ravel().tolist()


def covered(spans: list[list[int]], width: int, size: int) -> np.ndarray:
    """Which units the windows that start within the spans (first, last) cover."""
    marks = np.zeros(size + 1, "i4")
    if spans:
        x = np.asarray(spans, "i8")
        np.add.at(marks, x[:, 0], 1)
        np.add.at(marks, np.minimum(x[:, 1] + width, size), -1)
    return np.cumsum(marks[:-1]) > 0


def scan(docs: DataFrame, unit: Unit, text_col: str = "text") -> DataFrame:
    """One row for each run of each text: key, a, b (128 bits that stand for the text), place, first, n."""

    def rows(part: pa.RecordBatch) -> dict:
        a, b = (part.column(n).to_numpy() for n in ("a", "b"))
        found = [runs_of(unit.symbols(t), unit.width, unit.gram) for t in part.column("text").cast(pa.binary()).to_pylist()]
        counts = [len(f[0]) for f in found]
        columns = [np.concatenate(x) if x else np.empty(0, "i8") for x in zip(*found, strict=True)] or [np.empty(0, "i8")] * 4
        return {"a": np.repeat(a, counts), "b": np.repeat(b, counts), **{n: pa.array(c) for n, c in zip(("key", "place", "first", "n"), columns, strict=True)}}

    return map_rows(keyed(docs, text_col), "text", "key long, a long, b long, place int, first int, n int", rows)


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    a, b = text_key(text_or_empty(text_col))
    return docs.select(a.alias("a"), b.alias("b"), text_or_empty(text_col).alias("text"))


def shared_keys(runs: DataFrame) -> DataFrame:
    """Grams that stand in two places of the corpus; copies of a text are one place."""
    place = F.xxhash64("a", "b", "place")
    return runs.groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x < y").select("key")


def candidates(docs: DataFrame, runs: DataFrame, keys: DataFrame, label: str, text_col: str = "text") -> DataFrame:
    """Stored: a, b, text, runs for the texts that hold a shared gram."""
    kept = runs.join(keys, "key").groupBy("a", "b").agg(F.collect_set(F.struct("key", "place", "first", "n")).alias("runs"))
    distinct = keyed(docs, text_col).groupBy("a", "b").agg(F.first("text").alias("text"))
    return store(kept.join(distinct, ["a", "b"]), label)


def _named(segments: list[bytes]) -> dict[str, np.ndarray]:
    """s1, s2: 128 bits for each segment."""
    import xxhash

    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in segments]), "<i8").reshape(-1, 2)
    return {"s1": both[:, 0], "s2": both[:, 1]}


def places(kept: DataFrame, unit: Unit) -> DataFrame:
    """One row for each run of a kept text: a, b, key, off (of the first window from the anchor), first, n, s1, s2 (128 bits of its segment)."""

    def rows(part: pa.RecordBatch) -> dict:
        lists = part.column("runs")
        sizes, runs = np.diff(lists.offsets.to_numpy()), lists.flatten()
        key, place, first, n = (runs.field(i) for i in range(4))
        cut = [x for data, held in zip(_bytes(part), lists.to_pylist(), strict=True) for x in unit.segments(data, held)]
        return {"a": np.repeat(part.column("a").to_numpy(), sizes), "b": np.repeat(part.column("b").to_numpy(), sizes), "key": key, "off": first.to_numpy() - place.to_numpy(), "first": first, "n": n, **_named(cut)}

    return map_rows(kept.select("a", "b", "text", "runs"), "text", "a long, b long, key long, off int, first int, n int, s1 long, s2 long", rows)


def _bytes(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _cut(kept: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The units of the wanted segments (key, s1, s2, off, copies, at: a place of each): wanted's columns but at, and segment."""

    def rows(part: pa.RecordBatch) -> dict:
        lists = part.column("runs")
        cut = [x for data, held in zip(_bytes(part), lists.to_pylist(), strict=True) for x in unit.segments(data, held)]
        found = lists.flatten()
        return {n: found.field(i) for i, n in enumerate(("key", "s1", "s2", "off", "copies"))} | {"segment": pa.array(cut, pa.binary())}

    held = wanted.groupBy("at.a", "at.b").agg(F.collect_list(F.struct("key", "s1", "s2", "off", "copies", F.col("at.first").alias("first"), F.col("at.n").alias("n"))).alias("runs"))
    return map_rows(kept.select("a", "b", "text").join(held, ["a", "b"]).select("text", "runs"), "text", "key long, s1 long, s2 long, off int, copies int, segment binary", rows)


def _segment_key():
    return F.xxhash64("segment").alias("s1"), F.xxhash64(F.lit(7), "segment").alias("s2")


def repeated(kept: DataFrame, unit: Unit, match: Callable[[list[bytes], list[int]], list[np.ndarray]], block_bytes: int, label: str) -> DataFrame:
    """Per text (a, b): `spans`, the first starts of runs with the stretches of their windows that occur more than once."""
    held = store(places(kept, unit), f"{label}-places")
    at = F.struct("a", "b", "first", "n")
    distinct = store(held.groupBy("key", "s1", "s2").agg(F.min("off").alias("off"), F.min(at).alias("at"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("copies")), f"{label}-segments")
    mixed = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("copies").alias("least")).where("size > 1 and least = 1")
    wanted = distinct.join(mixed.select("key", "size"), "key")
    cut = store(_cut(kept, wanted, unit), f"{label}-cut")
    answers = _answers(cut, unit, match, block_bytes, label, [c for c in CHUNKS if c < unit.width])
    alone = distinct.where("copies = 1").join(answers, ["key", "s1", "s2"]).select("at.a", "at.b", "at.first", "found")
    whole = held.join(distinct.where("copies > 1").select("key", "s1", "s2"), ["key", "s1", "s2"], "left_semi").select("a", "b", "first", F.array(F.lit(0), F.col("n") - 1).alias("found"))
    return whole.unionByName(alone).groupBy("a", "b").agg(F.collect_list(F.struct("first", "found")).alias("spans"))


def _answers(cut: DataFrame, unit: Unit, match: Callable, block_bytes: int, label: str, chunks: list[int]) -> DataFrame:
    """(key, s1, s2, found): groups of at most HOT rows are matched whole; larger ones are cut into pieces under finer keys, and in the end into windows."""
    frequent = store(cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), f"{label}-frequent")
    few = frequent.count()
    if not few:
        return _matched(cut, match, block_bytes)
    frequent = F.broadcast(frequent) if few <= FREQUENT else frequent
    calm = _matched(cut.join(frequent, "key", "left_anti"), match, block_bytes)
    hot = cut.join(frequent, "key", "left_semi")
    if not chunks:
        return calm.unionByName(_by_window(hot, unit))

    def rows(part: pa.RecordBatch) -> dict:
        out: dict = {n: [] for n in ("pk", "p1", "p2", "shift", "key", "off", "segment", "copies")}
        for key, s1, s2, off, segment, copies in zip(*(part.column(n).to_pylist() for n in ("key", "s1", "s2", "off", "segment", "copies")), strict=True):
            for fine, i, piece in unit.pieces(segment, key, off, chunks[0]):
                for n, v in (("pk", key), ("p1", s1), ("p2", s2), ("shift", i), ("key", fine), ("off", off + i), ("segment", piece), ("copies", copies)):
                    out[n].append(v)
        return out

    cut_up = map_rows(hot.select("key", "s1", "s2", "off", "segment", "copies"), "segment", "pk long, p1 long, p2 long, shift int, key long, off int, segment binary, copies int", rows)
    cut_up = store(cut_up.select("pk", "p1", "p2", "shift", "key", "off", "segment", "copies", *_segment_key()), f"{label}-pieces")
    parts = cut_up.groupBy("key", "s1", "s2", "off").agg(F.first("segment").alias("segment"), F.sum("copies").cast("int").alias("copies"))
    inner = _answers(parts, unit, match, block_bytes, label, chunks[1:])
    up = cut_up.select("pk", "p1", "p2", "shift", "key", "s1", "s2").distinct().join(inner, ["key", "s1", "s2"])
    found = up.groupBy("pk", "p1", "p2").agg(F.flatten(F.collect_list(F.expr("transform(found, x -> x + shift)"))).alias("found"))
    return calm.unionByName(found.select(F.col("pk").alias("key"), F.col("p1").alias("s1"), F.col("p2").alias("s2"), "found"))


def removal(kept: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """Per text (a, b) with repeated windows: n_removed, n_spans, kept (what is left, words joined by one space)."""

    def rows(part: pa.RecordBatch) -> dict:
        out: dict = {n: [] for n in ("n_removed", "n_spans", "kept")}
        for data, found in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), strict=True):
            parts = data.split() if unit.words else data
            at = [[f["first"] + x, f["first"] + y] for f in found for x, y in zip(f["found"][::2], f["found"][1::2], strict=True)]
            gone = covered(at, unit.width, len(parts))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
            out["kept"].append(b" ".join([parts[i] for i in np.flatnonzero(~gone)]) if unit.words else np.frombuffer(data, "u1")[~gone].tobytes())
        return {"a": part.column("a"), "b": part.column("b"), **out}

    return map_rows(kept.select("a", "b", "text").join(spans, ["a", "b"]), "text", "a long, b long, n_removed long, n_spans long, kept binary", rows)


def _matched(calm: DataFrame, match: Callable, block_bytes: int) -> DataFrame:
    """Run `match` over blocks of whole groups; a group is bounded by HOT segments."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    ddl = "key long, s1 long, s2 long, found array<int>"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        copies: dict[tuple, int] = {}
        for *name, n in rows:
            copies[tuple(name)] = copies.get(tuple(name), 0) + n
        held = list(copies)
        flags = match([h[3] for h in held], list(copies.values()))
        rows = [(h[0], h[1], h[2], f) for h, f in zip(held, map(intervals, flags), strict=True) if f]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "s1", "s2", "segment", "copies")), strict=True):
                if size >= block_bytes and row[0] != last:
                    yield answer(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), row[0]
        if held:
            yield answer(held)
        held = []
        release()

    parts = int(calm.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return calm.select("key", "s1", "s2", "segment", "copies").repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, ddl)


def _by_window(hot: DataFrame, unit: Unit) -> DataFrame:
    """The exact way for frequent grams: count each window by its own hash."""

    def rows(part: pa.RecordBatch) -> dict:
        import xxhash

        out: dict = {n: [] for n in ("key", "s1", "s2", "i", "w1", "w2", "copies")}
        for key, s1, s2, segment, copies in zip(*(part.column(n).to_pylist() for n in ("key", "s1", "s2", "segment", "copies")), strict=True):
            hashes = [xxhash.xxh3_128_intdigest(w) for w in unit.windows(segment)]
            for n, v in (("key", key), ("s1", s1), ("s2", s2), ("copies", copies)):
                out[n] += [v] * len(hashes)
            out["i"] += range(len(hashes))
            out["w1"] += [(h >> 64) - (1 << 63) for h in hashes]
            out["w2"] += [(h & (1 << 64) - 1) - (1 << 63) for h in hashes]
        return out

    single = map_rows(hot.select("key", "s1", "s2", "segment", "copies"), "segment", "key long, s1 long, s2 long, i int, w1 long, w2 long, copies int", rows)
    often = single.groupBy("w1", "w2").agg(F.sum("copies").alias("total")).where("total > 1").select("w1", "w2")
    found = single.join(often, ["w1", "w2"]).select("key", "s1", "s2", "i")
    return found.groupBy("key", "s1", "s2").agg(F.flatten(F.collect_set(F.array("i", "i"))).alias("found"))
