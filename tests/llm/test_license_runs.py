"""Runs against all runs of every text, and a long text of fragments."""

import random
import re

import pytest
from pyspark.sql import functions as F

from arealis.llm import license_scan

RNG = random.Random(12)
TEMPLATES = {"A": "use of this work is free for all who name its maker", "B": "all rights in this work are kept by the maker of it", "C": "no warranty"}
FILLER = "lorem ipsum dolor sit amet elit".split()


def _fragments(n):
    """Pieces of templates with filler between and lost or doubled words in them."""
    out = []
    while len(out) < n:
        words = RNG.choice(list(TEMPLATES.values())).split()
        a = RNG.randrange(len(words) // 2)
        out += [w for w in words[a : a + RNG.randint(2, len(words))] for _ in range(RNG.choice([0, 1, 1, 1, 1, 1, 2]))]
        out += [RNG.choice(FILLER) for _ in range(RNG.choice([0, 0, 1, 3]))]
    return " ".join(w + RNG.choice(["", "", "", ",", "\n"]) for w in out[:n])


def _runs(text, threshold=0.8):
    """(dice, template) of every run of words, the best of each template."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    best = {}
    for name, body in TEMPLATES.items():
        t = body.split()
        want = set(zip(t, t[1:], strict=False))
        for s in range(len(words)):
            seen = set()
            for e in range(s + 1, min(len(words), s + 2 * len(t) + 2)):
                seen.add((words[e - 1], words[e]))
                dice = 2 * len(seen & want) / (len(seen) + len(want))
                if dice >= threshold - 1e-12 and dice > best.get(name, 0):
                    best[name] = dice
    return best


def test_runs_against_all_runs(spark):
    """The best unit of every text is found, with its score, and nothing scores more than the best run of its template."""
    texts = [_fragments(n) for n in (5, 12, 30, 30, 60, 60, 90, 120, 120, 200)] + ["", None, "no warranty", "no\nwarranty"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in license_scan.scan(docs, TEMPLATES).collect():
        got.setdefault(r.doc_id, {}).setdefault(r.license, []).append(r.dice)
    for i, text in enumerate(texts):
        want = _runs(text or "")
        assert bool(want) == (i in got), i
        if want:
            assert max(max(d) for d in got[i].values()) == pytest.approx(max(want.values()))
            assert all(max(d) <= want[name] + 1e-12 for name, d in got[i].items())


def test_equal_runs_far_apart(spark):
    """Ties: every copy of a notice in one text is found, at its own line; copies beside each other don't count twice."""
    notice = TEMPLATES["A"]
    text = "\n".join([" ".join(RNG.choice(FILLER) for _ in range(40)) + f" {notice} " + " ".join(RNG.choice(FILLER) for _ in range(40)) for _ in range(30)])
    docs = spark.createDataFrame([(1, text), (1, text), (None, notice)], "doc_id long, text string")
    got = license_scan.scan(docs, TEMPLATES).groupBy("doc_id", "unit", "license").agg(F.countDistinct("place").alias("n"), F.count(F.lit(1)).alias("c"), F.min("dice").alias("d")).collect()
    assert sorted((r.doc_id or 0, r.unit, r.license, r.n, r.c, r.d) for r in got) == [(0, "line", "A", 1, 1, 1.0), (1, "run", "A", 30, 60, 1.0)]


def test_long_text_of_fragments(spark):
    """Most of a megabyte of licence fragments ends, and holds each of the notices that were put in whole."""
    bodies = [t.split() for t in license_scan.TEMPLATES.values()]
    words: list[str] = []
    while len(words) < 120_000:
        body = RNG.choice(bodies)
        a = RNG.randrange(len(body))
        words += body[a : a + RNG.randint(3, 40)] + [RNG.choice(FILLER)] * 5
    notice = license_scan.TEMPLATES["MPL-2.0"]
    for at in (40_000, 80_000):
        words[at:at] = [*["dolor"] * 30, notice, *["dolor"] * 30]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = license_scan.scan(docs).where("license = 'MPL-2.0' and dice = 1").count()
    assert got >= 2
