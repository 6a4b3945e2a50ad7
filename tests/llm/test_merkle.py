"""The manifest against a tree built level by level, over blocks smaller than the groups."""

import hashlib

import pytest
from pyspark.sql import functions as F

from arealis.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    """The root and each node's siblings, lowest level first."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for k in range(0, len(nodes) - 1, 2):
            for m in members[k]:
                paths[m].append(nodes[k + 1])
            for m in members[k + 1]:
                paths[m].append(nodes[k])
        members = [sum(members[k : k + 2], []) for k in range(0, len(nodes), 2)]
        nodes = [_h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 33])
def test_traversal(n):
    leaves = [_h(str(i)) for i in range(n)]
    root, paths = _tree(leaves)
    top, beside = merkle.traverse([x.encode() for x in leaves], (n - 1).bit_length())
    assert top.decode() == root
    assert [[s.decode() for s in row if s] for row in beside] == paths


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_blocks_of_blocks(spark, levels):
    """A hot group, groups of one row, more groups than a block holds, and one forged row in five."""
    rows = [(i, "hot" if i % 3 else f"g{i // 3:02d}", f"text {i}") for i in range(75)] + [(90, None, "n"), (91, None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    found = merkle.manifest(docs, ["doc_id", "lang", "text"], forged={"text": F.concat("text", F.lit("!"))}, suspect=F.col("doc_id") % 5 == 0, levels=levels)
    framed = lambda x: "-" if x is None else f"{len(str(x))}:{x}"
    leaf = {r: _h(*map(framed, r)) for r in rows}
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, g or ""))
    trees = [(members, *_tree([leaf[r] for r in members])) for g in groups for members in [sorted(r for r in rows if r[1] == g)]]
    root, crest = _tree([t[1] for t in trees])
    want = {r[0]: (leaf[r], sub, root, _h(*path, *top), r[0] % 5 != 0) for (members, sub, paths), top in zip(trees, crest, strict=True) for r, path in zip(members, paths, strict=True)}
    got = found.withColumn("proof", merkle.proof_digest()).select("doc_id", "leaf", "subroot", "root", "proof", "verified").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want
