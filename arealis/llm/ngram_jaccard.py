"""N-gram Jaccard self-join by token-combination prefixes, with the connected components of its links.

Tokens are the hashes of word n-grams; a text is the set of them. Two sets with Jaccard of t or more leave at most
n - ceil(t n) tokens of either unmatched, so sets that index one more token than that, in one order for all, share an entry.

* Tokens with few holders (at most RARE sets) come first in that order, and each is an entry of its own. Their
  counts are taken over all texts for the first part of the hash range. A set with more than n - ceil(t n) tokens that no other
  set holds links with nothing and goes no further; for the sets that stay, the rest of the range is counted too.
* Sets that lack rare tokens extend their prefix over frequent tokens. These are dealt into slices of the hash range,
  a slice of p tokens gives p - 1 matches at least, and its pairs of tokens are the entries: a pair has far fewer holders.
  Slices get finer with set size; sets near the border of two sizes are entered under both.
* Each holder of an entry is compared with one other first; links join components, and after that only holders of
  different components are compared, and only while both sizes fit what the tokens with other holders allow. Pairs are first
  compared by these tokens; what may link is compared exactly, over whole sets made from the texts. Entries that still have
  many holders are compared in blocks, which give no row for each pair.

Tokens travel in blocks: a worker sends the tokens of many texts that fall into one bucket as one row, 48 bits for each.
A token with very many holders in one block is counted there and its rows are dealt out by set, so that no task gets all
holders of one token. Texts with equal sets are one node.

Defined results: words are runs between ASCII white space, A-Z in lower case; with fewer than n words the whole sequence is one token;
null and empty texts have none and link with nothing; rows of one id with different texts keep their own components; rows without an
id take part, and the smallest id of their component is theirs (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arealis.llm.anchors import gram_hashes, keyed, mix, word_spans
from arealis.llm.common import Scratch, map_rows, release, slices, store, text_key, text_or_empty
from arealis.llm.graph import components

#: Most holders of a token that is an entry of its own.
RARE = 32
#: Texts (16 bytes each) that may be looked up by a broadcast of their keys.
FEW = 500_000
#: The first part of the hash range, in 1/256.
FIRST = 72
#: Tokens of a block, and input bytes of a bucket of tokens.
BLOCK, BUCKET_BYTES = 1_000_000, 64 << 20
#: Holders of a chunk of an entry that has more than RARE, and tokens that a block compares at once.
CHUNK, COLUMNS = 512, 4096
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens_of(data: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of word n-grams."""
    symbols = word_spans(data.translate(LOWER))[2]
    if not len(symbols):
        return symbols
    return np.unique(gram_hashes(symbols, words) if len(symbols) >= words else gram_hashes(symbols, len(symbols)))


def set_key(tokens: np.ndarray, salt: int = 0, bits: int = 64) -> tuple[int, int]:
    """128 bits that equal sets share: the first `bits` of 64 that depend on the salt, and 64 that don't."""
    with np.errstate(over="ignore"):
        first = mix(tokens ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))).sum(dtype="u8") >> np.uint64(64 - bits)
        return int(first.view("i8")), int(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype="u8").view("i8"))


def needed(n, share: int):
    """Entries that a set of n tokens must have: n - ceil(share n / 100) + 1."""
    return n - -(-share * n // 100) + 1


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return part.column("text").cast(pa.binary()).to_pylist()


BLOCKS = "deal int, bucket int, kind int, sets binary, at binary, token binary, pos binary"


class Block:
    """Tokens of distinct sets, to be sent by buckets.

    Rows are (deal, bucket, kind, ...): kind 0 holds tokens in their bucket with their sets, kind 1 tokens that are frequent
    in this block, dealt out by set, kind 2 names those to their own bucket. `deal` makes Spark put a bucket where it belongs.
    """

    def __init__(self, deals: list[int], buckets: int) -> None:
        self.deals, self.buckets = deals, buckets
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.tokens: list[np.ndarray] = []
        self.starts: list[int] = []
        self.size = 0

    def add(self, s1: int, tokens: np.ndarray, start: int) -> None:
        """The tokens of a set, whose places in it count from start."""
        if s1 not in self.known:
            self.known[s1] = len(self.tokens)
            self.tokens.append(tokens)
            self.starts.append(start)
            self.size += len(tokens)

    def rows(self) -> list[tuple]:
        if not self.size:
            return []
        sizes = np.array([len(t) for t in self.tokens])
        token = np.concatenate(self.tokens) >> np.uint64(16)
        s1 = np.array(list(self.known), "i8")
        owner = np.repeat(np.arange(len(s1), dtype="u4"), sizes)
        pos = (np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes - np.array(self.starts), sizes)).astype("u4")
        order = np.argsort(token)
        token, owner, pos = token[order], owner[order], pos[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        often = np.diff(np.append(starts, len(token))) > RARE
        names = token[starts[often]]
        local = np.repeat(often, np.diff(np.append(starts, len(token))))
        out = self._pack(0, token[~local], s1, owner[~local], pos[~local], token[~local])
        out += self._pack(1, token[local], s1, owner[local], pos[local], mix(s1.view("u8"))[owner[local]])
        return out + self._pack(2, names, s1[:0], owner[:0], pos[:0], names)

    def _pack(self, kind: int, token: np.ndarray, s1: np.ndarray, owner: np.ndarray, pos: np.ndarray, by: np.ndarray) -> list[tuple]:
        home = (by % np.uint64(len(self.deals) * self.buckets)).astype("i8")
        order = np.argsort(home, kind="stable")
        home = home[order]
        cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]])) if len(home) else [0]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part, place = order[a:b], int(home[a])
            used, at = np.unique(owner[part], return_inverse=True) if kind < 2 else (owner[:0], owner[:0])
            out.append((self.deals[place // self.buckets], place % self.buckets, kind, s1[used].tobytes(), at.astype("<u4").tobytes(), short(token[part]), pos[part].tobytes() if kind < 2 else b""))
        return out


def short(token: np.ndarray) -> bytes:
    """48-bit numbers as 6 bytes each."""
    return np.ascontiguousarray(token.astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(data, "u1").reshape(-1, 6)
    return out.view("<u8").ravel()


def _dealing(docs: DataFrame) -> tuple[list[int], int]:
    """For each shuffle partition a number that hash partitioning puts there, and the buckets a partition holds."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found: dict[int, int] = {}
    reach = 0
    while len(found) < parts:
        rows = spark.range(reach, reach + 20 * parts).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("p")).agg(F.min("id").alias("id")).collect()
        found |= {r.p: r.id for r in rows if r.p not in found}
        reach += 20 * parts
    read = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return [found[p] for p in range(parts)], max(1, min(256, read // (parts * BUCKET_BYTES)))


def _blocks(df: DataFrame, column: str, sets, dealing: tuple[list[int], int], heads: T.StructType | None = None) -> DataFrame:
    """Token blocks of all rows. `sets` gives (set key, tokens, first place, head) of each row of a batch; heads, if wanted,
    are rows of their own (kind 3), dealt out by the set's key."""
    deals, buckets = dealing
    fields = [*T.StructType.fromDDL(BLOCKS).fields, *(heads or [])]
    schema = to_arrow_schema(T.StructType(fields))
    own = len(fields) - len(heads or [])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(deals, buckets)
        for batch in batches:
            for part in slices(batch, column):
                found = sets(part)
                if heads:
                    yield table([(deals[f[0] % len(deals)], -1, 3, *(None,) * (own - 3), *f[3]) for f in found])
                for s1, tokens, start, _ in found:
                    if len(tokens):
                        block.add(s1, tokens, start)
                    if block.size >= BLOCK:
                        yield table(block.rows())
                        block.clear()
        if block.size:
            yield table(block.rows())
        block = batch = part = found = None
        release()

    return df.mapInArrow(run, T.StructType(fields))


def shared_tokens(blocks: DataFrame, dealing: tuple[list[int], int], heads: T.StructType | None = None) -> DataFrame:
    """(s1, code, pos) of the tokens that two sets or more hold; code is twice the token, plus 1 for frequent ones.

    Rows of heads, where blocks hold them, come along with a null code.
    """
    names = [f.name for f in heads or []]
    out = T.StructType([*T.StructType.fromDDL("s1 long, code long, pos int").fields, *(f for f in heads or [] if f.name != "s1")])
    schema = to_arrow_schema(out)

    def widened(s1, code, pos) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s1.astype("i8")), pa.array(code.astype("i8")), pa.array(pos.astype("i4")), *(pa.nulls(len(s1), f.type) for f in list(schema)[3:])], schema=schema)

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, f.type) if f.name in ("code", "pos") else batch.column(f.name) for f in schema], schema=schema)

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        known = [(np.frombuffer(s, "i8")[np.frombuffer(at, "<u4")], long(t), np.frombuffer(p, "u4")) for kind, s, at, t, p in rows if kind == 0]
        s1, token, pos = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.empty(0, k) for k in ("i8", "u8", "u4"))
        names = np.unique(np.concatenate([long(t) for kind, _, _, t, _ in rows if kind == 2] or [np.empty(0, "u8")]))
        order = np.lexsort((pos, s1, token))
        s1, token, pos = s1[order], token[order], pos[order]
        first = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.empty(0, bool)
        fresh = first.copy()
        fresh[1:] |= s1[1:] != s1[:-1]
        place = fresh.copy()  # a set may hold two tokens that agree in 48 bits: both places stay
        place[1:] |= pos[1:] != pos[:-1]
        starts = np.flatnonzero(first)
        count = np.add.reduceat(fresh.astype("i4"), starts) if len(starts) else np.empty(0, "i4")
        often = (count > RARE) | np.isin(token[starts], names)
        sizes = np.diff(np.append(starts, len(token)))
        keep = place & np.repeat((count > 1) | often, sizes)
        code = token * np.uint64(2) + np.repeat(often, sizes)
        dealt = [(np.frombuffer(s, "i8")[np.frombuffer(at, "<u4")], long(t) * np.uint64(2) + np.uint64(1), np.frombuffer(p, "u4")) for kind, s, at, t, p in rows if kind == 1]
        return widened(*(np.concatenate(x) for x in zip((s1[keep], code[keep], pos[keep]), *dealt, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if names:
                mine = pa.compute.equal(batch.column("kind"), 3)
                yield told(batch.filter(mine))
                batch = batch.filter(pa.compute.invert(mine))
            columns = [batch.column(n).to_pylist() for n in ("bucket", "kind", "sets", "at", "token", "pos")]
            for bucket, *row in zip(*columns, strict=True):
                if held and bucket != now:
                    yield settle(held)
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield settle(held)
        held = batch = columns = None
        release()

    return blocks.repartition(len(dealing[0]), "deal").sortWithinPartitions("bucket").mapInArrow(run, out)


def _entry(*parts: int) -> int:
    """A signed 64-bit hash of a combination, the same in every process."""
    return int.from_bytes(hashlib.blake2b(struct.pack(f"<{len(parts)}q", *parts), digest_size=8).digest(), "little", signed=True)


def entries(tokens: list[tuple[int, int]], n: int, share: int) -> list[int]:
    """Hashes under which a set is entered, from (pos, code) of its tokens with other holders."""
    want = needed(n, share)
    tokens = sorted(tokens)
    often = [c >> 1 for _, c in tokens if c & 1]
    before, out = 0, []
    for p, c in tokens:
        if c & 1:
            before += 1
        elif p - before < want:
            out.append(c >> 1)
    rare = n - len(often)
    size = n.bit_length() - 1
    for scheme in {size, (100 * n // share).bit_length() - 1} if rare < want else ():
        got, parts = rare, {}
        for token in often:  # in order of the hash
            if got >= want:
                break
            if scheme < 3:
                out.append(_entry(scheme, token))
                got += 1
                continue
            near = parts.setdefault(token >> 48 - scheme + 1, [])
            out += [_entry(scheme, other, token) for other in near]
            got += bool(near)
            near.append(token)
    return list(set(out))


def _entered(nodes: DataFrame, share: int) -> DataFrame:
    """(entry, s1, n, cap) from rows (s1, n, tokens); no set of more than cap tokens can link with this one.

    Common tokens have two holders, so c of those allow sizes n + m of c (100 + share) / share.
    """

    def rows(part: pa.RecordBatch) -> dict:
        out: dict = {"entry": [], "s1": [], "n": [], "cap": []}
        for s1, n, tokens in zip(*(part.column(c).to_pylist() for c in ("s1", "n", "tokens")), strict=True):
            found = entries([(t["pos"], t["code"]) for t in tokens], n, share)
            out["entry"] += found
            out["s1"] += [s1] * len(found)
            out["n"] += [n] * len(found)
            out["cap"] += [len(tokens) * (100 + share) // share - n] * len(found)
        return out

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few files, much work for each row
    return map_rows(nodes.select("s1", "n", "tokens", F.lit("").alias("pad")).repartition(parts, "s1"), "pad", "entry long, s1 long, n int, cap int", rows)


def _joined(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of both ends, those of the second with a 2 after their names."""
    for end, mark in (("x", ""), ("y", "2")):
        pairs = pairs.join(of.select(F.col("s1").alias(end), *(F.col(c).alias(c + mark) for c in columns)), end)
    return pairs


def _likely(pairs: DataFrame, codes: DataFrame, share: int) -> DataFrame:
    """The pairs (x, y) that link by the 48 bits of their tokens; common tokens are among those with other holders."""

    def rows(part: pa.RecordBatch) -> dict:
        keep = []
        for p, q, n, m in zip(_arrays(part.column("codes")), _arrays(part.column("codes2")), *(part.column(c).to_pylist() for c in ("n", "n2")), strict=True):
            common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum()) if len(p) else 0
            keep.append(100 * common >= share * (n + m - common))
        keep = pa.array(keep, pa.bool_())
        return {"x": part.column("x").filter(keep), "y": part.column("y").filter(keep)}

    return map_rows(_joined(pairs, codes, "codes", "n").withColumn("pad", F.lit("")), "pad", "x long, y long", rows)


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays, without a copy."""
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _verified(pairs: DataFrame, texts: DataFrame, share: int, words: int) -> DataFrame:
    """The pairs (x, y) whose whole sets are alike enough."""

    def rows(part: pa.RecordBatch) -> dict:
        known: dict[bytes, np.ndarray] = {}

        def tokens(data: bytes) -> np.ndarray:
            if data not in known:
                known[data] = tokens_of(data, words)
            return known[data]

        keep = []
        for p, q in zip(*(part.column(c).cast(pa.binary()).to_pylist() for c in ("text", "text2")), strict=True):
            p, q = tokens(p), tokens(q)
            common = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * common >= share * (len(p) + len(q) - common))
        keep = pa.array(keep, pa.bool_())
        return {"x": part.column("x").filter(keep), "y": part.column("y").filter(keep)}

    return map_rows(_joined(pairs, texts, "text"), "text", "x long, y long", rows)


def _apart(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Holders with their component, of entries that more than one component holds."""
    held = held.select("entry", "s1", "n", "cap")
    if labels is not None:
        held = held.join(labels.withColumnRenamed("node", "s1"), "s1", "left").withColumn("comp", F.coalesce("comp", "s1"))
    else:
        held = held.withColumn("comp", F.col("s1"))
    mixed = held.groupBy("entry").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high").select("entry", "size")
    return held.join(mixed, "entry")


def _sizes_fit(share: int):
    return F.expr(f"100 * least(n, m) >= {share} * greatest(n, m) and m <= cap and n <= cap2")


def _starred(held: DataFrame, largest: bool, share: int) -> DataFrame:
    """Each holder with the first (or last) holder of its entry, where their components differ."""
    pick = F.max if largest else F.min
    lead = held.groupBy("entry").agg(pick(F.struct("s1", "n", "cap", "comp")).alias("l")).select("entry", F.col("l.s1").alias("lead"), F.col("l.n").alias("m"), F.col("l.cap").alias("cap2"), F.col("l.comp").alias("other"))
    return held.join(lead, "entry").where(_sizes_fit(share)).where("comp <> other").select(F.least("s1", "lead").alias("x"), F.greatest("s1", "lead").alias("y"), "s1", "lead")


def distinct_entries(held: DataFrame) -> DataFrame:
    """One entry of those with the same holders (told by 128 bits, their number and ends); entries of one holder go, and
    before that holders for which all others are too large."""
    held = held.join(held.groupBy("entry").agg(F.min("n").alias("least")), "entry").where("cap >= least").drop("least")
    sets = held.groupBy("entry").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("s1")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "s1")).alias("h2"), F.min("s1").alias("low"), F.max("s1").alias("high")).where("c > 1")
    kept = sets.groupBy("c", "h1", "h2", "low", "high").agg(F.min("entry").alias("entry")).select("entry")
    return held.join(kept, "entry")


def _in_blocks(apart: DataFrame, codes: DataFrame, share: int) -> DataFrame:
    """Edges (x, y) that join the linked holders of entries with many, without a row for each pair.

    Holders are dealt into chunks of about CHUNK, each two chunks of an entry (or one) meet as a block, and a block gives the
    edges that join its linked sets, fewer than it has sets.
    """
    ddl = "x long, y long"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        s1, n, comp, side, codes = zip(*rows, strict=True)
        s1, n, comp, side = (np.array(x) for x in (s1, n, comp, side))
        # codes are in order, so a code that a set holds twice stands beside itself; the second counts as a token of its own
        again = np.concatenate([np.arange(len(c)) - np.searchsorted(c, c) for c in codes])
        token, column = np.unique(np.stack([np.concatenate(codes), again]), axis=1, return_inverse=True) if again.any() else np.unique(np.concatenate(codes), return_inverse=True)
        token, column = token.reshape(-1, token.shape[-1])[0], column.ravel()
        row = np.repeat(np.arange(len(s1)), [len(c) for c in codes])
        common = np.zeros((len(s1), len(s1)), "f4")
        for at in range(0, len(token), COLUMNS):
            part = (column >= at) & (column < at + COLUMNS)
            held = np.zeros((len(s1), min(COLUMNS, len(token) - at)), "f4")
            held[row[part], column[part] - at] = 1
            common += held @ held.T
        linked = 100 * common >= share * (n[:, None] + n[None, :] - common)
        if side.min() != side.max():  # pairs of one chunk are in that chunk's own block
            linked &= side[:, None] != side[None, :]
        root = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for i, j in zip(*np.nonzero(np.triu(linked & (comp[:, None] != comp[None, :]), 1)), strict=True):
            p, q = top(int(comp[i])), top(int(comp[j]))
            if p != q:
                root[p] = q
                out.append(sorted((int(s1[i]), int(s1[j]))))
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for *block, s1, n, comp, side, codes in zip(*(batch.column(c).to_pylist() for c in ("entry", "i", "j", "s1", "n", "comp", "side")), _arrays(batch.column("codes")), strict=True):
                if held and block != now:
                    yield settle(held)
                    held = []
                now = block
                held.append((s1, n, comp, side, codes))
        if held:
            yield settle(held)
        held = []
        release()

    parts = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = apart.withColumn("side", F.pmod(F.xxhash64("s1"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    blocks = dealt.select("entry", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "s1", "comp", "side").join(codes, "s1")
    return blocks.repartition(parts, "entry", "i", "j").sortWithinPartitions("entry", "i", "j").select("entry", "i", "j", "s1", "n", "comp", "side", "codes").mapInArrow(run, ddl).distinct()


def links(held: DataFrame, codes: DataFrame, texts: DataFrame, share: int, words: int) -> DataFrame:
    """The components (node, comp) that links make; edges join all linked sets, and are not every link."""
    tested, edges, labels = None, None, None
    for step in ("one", "star", "last", "rest"):
        held = apart = store(_apart(held, labels), "jaccard-apart")  # entries within one component stay so
        if step == "one":
            pairs = _starred(apart, False, share).groupBy("s1").agg(F.min("lead").alias("lead")).select(F.least("s1", "lead").alias("x"), F.greatest("s1", "lead").alias("y"))
        elif step == "rest":
            few = apart.where(F.col("size") <= RARE)
            other = few.select("entry", F.col("s1").alias("z"), F.col("n").alias("m"), F.col("cap").alias("cap2"), F.col("comp").alias("other"))
            pairs = few.join(other, "entry").where("comp < other").where(_sizes_fit(share)).select(F.least("s1", "z").alias("x"), F.greatest("s1", "z").alias("y"))
        else:
            pairs = _starred(apart, step == "last", share).select("x", "y")
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = store(pairs, "jaccard-pairs")
        likely = _likely(pairs, codes, share)
        if step == "rest":
            likely = likely.unionByName(_in_blocks(apart.where(F.col("size") > RARE), codes, share))
        likely = store(likely.distinct(), "jaccard-likely")
        if edges is not None and not likely.limit(1).count():
            continue
        found = store(_verified(likely, texts, share, words).distinct(), "jaccard-links")
        tested = pairs if tested is None else tested.unionAll(pairs)
        edges = found if edges is None else edges.unionAll(found)
        labels = components(edges)
    return labels


def join(docs: DataFrame, share: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach, its own included), n_same (rows with an equal set)."""
    placed = groups(docs, share, words, id_col, text_col)
    least = placed.where("n > 0").groupBy("comp").agg(F.min("id").alias("component_id"))
    same = placed.where("n > 0").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n_same"))
    out = placed.join(least, "comp", "left").join(same, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_same", F.lit(1)).alias("n_same"))


def groups(docs: DataFrame, share: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per row: id, a, b (the text's key), s1, s2 (the set's key), n (its size) and comp, the same number for all rows that links join.

    Within a run s1 alone names a set. Should two sets share one (of `bits` bits), which s2 tells, the run starts again with another salt.
    """
    for salt in range(8):
        found = _grouped(docs, share, words, id_col, text_col, salt, bits)
        if found is not None:
            return found
    raise ValueError("sets can't be told apart by so few bits")


def _grouped(docs: DataFrame, share: int, words: int, id_col: str, text_col: str, salt: int, bits: int) -> DataFrame | None:
    """The groups, or None if two sets share their s1."""
    with Scratch() as scratch:
        border = np.uint64(FIRST << 56)
        dealing = _dealing(docs)
        kind = docs.schema[id_col].dataType
        a, b = text_key(text_or_empty(text_col))

        def first_sets(part: pa.RecordBatch) -> list[tuple]:
            out = []
            for name, x, y, t in zip(*(part.column(c).to_pylist() for c in ("id", "a", "b")), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                tokens = tokens_of(t, words)
                (s1, s2), first = set_key(tokens, salt, bits), tokens[: np.searchsorted(tokens, border)].copy()
                out.append((s1, first, 0, (s1, name, x, y, s2, len(tokens), len(first))))
            return out

        heads = T.StructType([T.StructField("s1", T.LongType()), T.StructField("id", kind), *T.StructType.fromDDL("a long, b long, s2 long, n int, first int").fields])
        base = docs.select(F.col(id_col).alias("id"), a.alias("a"), b.alias("b"), text_or_empty(text_col).alias("text"))
        both = scratch.keep(store(shared_tokens(_blocks(base, "text", first_sets, dealing, heads), dealing, heads), "jaccard-shared", even=True))
        head = both.where("code is null").drop("code", "pos")
        if not head.groupBy("s1").agg(F.min("s2").alias("low"), F.max("s2").alias("high")).where("low < high").isEmpty():
            scratch.kept.clear()
            return None
        nodes = head.where("n > 0").groupBy("s1").agg(F.min(F.struct("a", "b")).alias("t"), F.max("n").alias("n"), F.max("first").alias("first")).select("s1", "n", "first", "t.a", "t.b")
        shared = both.where("code is not null")
        lists = shared.groupBy("s1").agg(F.collect_set(F.struct("pos", "code")).alias("tokens"))
        spare = F.expr(f"n - ceil({share} * n / 100)")
        listed = nodes.join(lists, "s1", "left").withColumn("tokens", F.coalesce("tokens", F.expr("cast(array() as array<struct<pos:int,code:bigint>>)")))
        listed = listed.where(F.col("first") - F.size("tokens") <= spare).withColumn("lacks", F.col("first") - F.expr("size(filter(tokens, t -> t.code % 2 = 1))") <= spare)
        listed = store(listed.where("lacks or exists(tokens, t -> t.code % 2 = 0)").drop("lacks"), "jaccard-tokens")

        keys = listed.select("s1", "first", "a", "b")
        keys = F.broadcast(keys) if keys.count() <= FEW else keys
        texts = store(keyed(docs, text_col).join(keys, ["a", "b"]).dropDuplicates(["s1"]).select("s1", "first", "text"), "jaccard-texts", compression="zstd")

        def rest_sets(part: pa.RecordBatch) -> list[tuple]:
            firsts = part.column("first").to_pylist()
            found = zip(part.column("s1").to_pylist(), firsts, part.column("text").cast(pa.binary()).to_pylist(), strict=True)
            return [(s1, tokens_of(t, words)[first:], first, None) for s1, first, t in found]

        more = shared_tokens(_blocks(texts, "text", rest_sets, dealing), dealing).groupBy("s1").agg(F.collect_set(F.struct("pos", "code")).alias("more"))
        full = listed.join(more, "s1", "left").withColumn("tokens", F.expr("concat(tokens, coalesce(more, array()))"))
        full = store(full.where(F.size("tokens") >= F.col("n") - spare).select("s1", "n", "tokens"), "jaccard-full")
        held = store(distinct_entries(store(_entered(full, share), "jaccard-entries", even=True)), "jaccard-held")
        codes = full.select("s1", "n", F.array_sort(F.transform("tokens", lambda t: t["code"])).alias("codes"))
        labels = scratch.keep(links(held, codes, texts.select("s1", "text"), share, words))
    return head.drop("first").join(labels.withColumnRenamed("node", "s1"), "s1", "left").withColumn("comp", F.coalesce("comp", "s1"))

