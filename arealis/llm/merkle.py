"""Merkle dataset manifest: a binary tree of sha256 digests over the rows of each group, and one over the groups' roots.

1. A row becomes a leaf: the digest of its fields, each framed by its length, in JVM functions.
2. Leaves get their places in their group: dealt into ranges of (group, order), sorted within them, shifted by the ranges' counts.
3. Blocks of 2**LEVELS aligned leaves are traversed in postorder, each in a task of its own: a call returns its subtree's
   digest and, while it unwinds, appends each half's digest to the leaves of the other half. Block roots, aligned in turn,
   feed another such traversal, until a group has one node left; so the work of a round is 2**LEVELS times less than the last.
4. The groups' roots, in order of the groups, go the same way. A leaf's proof is the chain of what it, its block, the block's
   block and its group were given.

Groups stand for their value by a key ("0" for null, "1" and the value else), so null comes first and the rest in byte order.
A group that holds most rows is as many blocks as its rows need, and no join is on the group alone but between tables with one
row a group.

Defined results: null fields are framed as "-"; rows are ordered by id (null first), then by digest, and equal rows follow each
other in any order, since their leaves are the same; a table without rows gives none; a group of one row has its leaf as root.
Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.common import Scratch, store

#: Levels of a tree that one traversal covers: 1024 leaves a block.
LEVELS = 10


def framed(value: Column) -> Column:
    """The byte count of a value's text, a colon and the text; "-" for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def traverse(leaves: list[bytes], levels: int) -> tuple[bytes, np.ndarray]:
    """The root of aligned leaves over so many levels, and each leaf's siblings from the lowest level up (empty where it has none).

    Digests are hex. Leaves that end early leave single nodes, which are hashed alone.
    """
    beside = np.zeros((len(leaves), levels), "S64")

    def visit(start: int, level: int) -> bytes:
        if not level:
            return leaves[start]
        middle, stop = start + (1 << level - 1), start + (1 << level)
        left = visit(start, level - 1)
        if middle >= len(leaves):
            return sha256(left).hexdigest().encode()
        right = visit(middle, level - 1)
        beside[start:middle, level - 1], beside[middle:stop, level - 1] = right, left
        return sha256(left + right).hexdigest().encode()

    return visit(0, levels), beside


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df, stored, with `at`, a row's place in its group from 0, and `n`, the group's rows. No sort or window holds a whole group."""
    spread = df.withColumn("even", F.monotonically_increasing_id() % 1024)
    dealt = spread.repartitionByRange(group, *order, "even").sortWithinPartitions(group, *order, "even").drop("even")
    placed = store(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("range", F.shiftright("row", 33)), "merkle-places")
    counts = placed.groupBy(group, "range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(group, "range", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("shift"), F.sum("c").over(Window.partitionBy(group)).alias("n"))  # a row for each range, and one more for each group that ends in it
    return placed.join(store(shift, "merkle-ranges"), [group, "range"]).withColumn("at", F.col("row") - F.col("first") + F.col("shift")).drop("row", "range", "first", "shift")


def _blocks(nodes: DataFrame, most: int) -> DataFrame:
    """(g, at, n, digest, path, top): each node's siblings within its block of `most` levels and the block's root."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        levels = min(most, (part.column("n")[0].as_py() - 1).bit_length())
        leaves = [x.encode() for x in part.column("digest").to_pylist()]
        top, beside = traverse(leaves, levels)
        paths = pa.ListArray.from_arrays(pa.array(np.arange(0, beside.size + 1, levels) if levels else np.zeros(len(leaves) + 1), pa.int32()), pa.array(beside.ravel().tolist(), pa.binary()).cast(pa.string()))
        return part.append_column("path", paths).append_column("top", pa.array([top.decode()] * len(leaves)))

    picked = nodes.select("g", "at", "n", "digest").groupBy("g", F.shiftright("at", most).alias("block"))
    return picked.applyInArrow(run, "g string, at long, n long, digest string, path array<string>, top string")


def climb(nodes: DataFrame, levels: int = LEVELS, tops: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(g, at, digest, path, subroot, ...): a row for each of nodes (g, at, n, digest) with all its siblings up to its group's root, and what `tops` gives for the groups' roots (g, subroot)."""
    done = store(_blocks(nodes, levels), "merkle-blocks")
    width = 1 << levels
    above = done.where(F.col("at") % width == 0).select("g", F.shiftright("at", levels).alias("at"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("digest"))
    if above.where("n > 1").limit(1).count():
        upper = climb(above, levels, tops)
    else:
        roots = above.select("g", F.col("digest").alias("subroot"))
        upper = above.select("g", "at", F.expr("cast(array() as array<string>)").alias("path")).join(tops(roots) if tops else roots, "g")
    rest = [c for c in upper.columns if c not in ("g", "at", "path", "digest")]
    upper = upper.select("g", F.col("at").alias("block"), F.col("path").alias("upper"), *rest)
    return done.withColumn("block", F.shiftright("at", levels)).join(upper, ["g", "block"]).select("g", "at", "digest", F.concat("path", "upper").alias("path"), *rest)


def crown(roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(g, subroot, place, crest, root): the tree over the groups' roots, in order of the groups."""
    one = ranked(roots.select(F.lit("").alias("all"), F.col("g").alias("name"), F.col("subroot").alias("digest")), "all", ["name"])
    held = store(one, "merkle-crown")
    found = climb(held.select(F.col("all").alias("g"), "at", "n", "digest"), levels)
    return held.select(F.col("name").alias("g"), "at", F.col("digest").alias("subroot")).join(found.select("at", F.col("path").alias("crest"), F.col("subroot").alias("root")), "at").withColumnRenamed("at", "place")


def folded(start: Column, path: str, at: str) -> Column:
    """The root that a digest leads to along its siblings; the bits of its place say on which side each stands."""
    pairs = F.transform(path, lambda s, j: F.struct(s.alias("s"), F.col(at).alias("at"), j.alias("j")))
    left = lambda e: F.call_function("shiftright", e["at"], e["j"]) % 2 == 1
    return F.aggregate(pairs, start, lambda acc, e: F.when(left(e), F.sha2(F.concat(e["s"], acc), 256)).otherwise(F.sha2(F.concat(acc, e["s"]), 256)))


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", id_col: str = "doc_id", forged: dict[str, Column] | None = None, suspect: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row: its id, leaf, claimed (the leaf to verify), subroot, root, path and crest (siblings up to the subroot and from there to the root, empty where
    there are none), at and place (its place in the group, the group's), folded_root (claimed led along path and crest) and verified (folded_root is root).

    `claimed` is the leaf itself, but where `suspect` holds, that of the row with the columns in `forged` put in place of its own.
    """
    with Scratch() as scratch:
        own = [(forged or {}).get(f, F.col(f"`{f}`")) for f in fields]
        leaf = digest(*[F.col(f"`{f}`") for f in fields])
        key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
        bent = F.when(suspect, digest(*own)) if suspect is not None else F.lit(None).cast("string")
        leaves = store(docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("g"), leaf.alias("digest"), bent.alias("bent")), "merkle-leaves")
        placed = store(ranked(leaves, "g", ["id", "digest"]), "merkle-leaves")
        proofs = scratch.keep(store(climb(placed, levels, lambda roots: crown(roots, levels)), "merkle-proofs"))
        scratch.keep(placed)
    out = placed.select("id", "g", "at", "bent").join(proofs, ["g", "at"])
    out = out.withColumn("claimed", F.coalesce("bent", "digest"))
    out = out.withColumn("folded_root", folded(folded(F.col("claimed"), "path", "at"), "crest", "place"))
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "claimed", "subroot", "root", "path", "crest", "at", "place", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_digest() -> Column:
    """The digest of a row's siblings, from the leaf's up to the root's."""
    return F.sha2(F.array_join(F.concat("path", "crest"), ""), 256)


def crc_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language; where 7 divides the crc32 of the id, one character too many is claimed. A row without an id claims its own leaf."""
    return manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], forged={"n_chars": F.col("n_chars") + 1}, suspect=F.coalesce(crc_of_id() % 7 == 0, F.lit(False)))
