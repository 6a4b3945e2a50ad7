"""Block-max search against all cosines, the choice of terms, and the operator on planted texts, edge rows and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.llm import toxicity

RNG = random.Random(9)
PLAIN = [a + b for a in ("bo", "ka", "ri", "tu", "se", "mo") for b in ("lan", "nir", "dok", "vel", "pas")]
DIRTY = ["grumbel", "grumblot", "zwackel", "zwackig", "fnord"]


def _text(n, dirty=0):
    words = [RNG.choice(PLAIN) for _ in range(n)] + [RNG.choice(DIRTY) for _ in range(dirty)]
    RNG.shuffle(words)
    return " ".join(words)


def _held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4 == 2


def test_search_is_exact():
    """Ties by id, more examples than a block, empty vectors, and leaving one example out."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        places = np.sort(rng.choice(12, rng.integers(0, 5), replace=False))
        rows.append((1000 - i, int(rng.integers(0, 2)), places, rng.integers(1, 4, len(places))))
    index = toxicity.build(rows, rng.uniform(1, 5, 12))
    dense = np.zeros((300, 12))
    by_id = {r[0]: r for r in rows}
    for n, i in enumerate(index.ids):
        dense[n, by_id[i][2]] = index.weigh(*by_id[i][2:])
    for n in range(300):
        _, _, places, counts = by_id[index.ids[n]]
        cosines = dense @ dense[n]
        for without in (-1, n):
            want = sorted(((c, index.ids[m]) for m, c in enumerate(cosines) if c > 1e-12 and m != without), key=lambda x: (-round(x[0], 9), x[1]))[:15]
            got = index.search(places, index.weigh(places, counts), 15, without)
            np.testing.assert_allclose([c for c, _ in got], [c for c, _ in want], atol=1e-9)
            sure = [j for c, j in want if c > want[-1][0] + 1e-9]
            assert set(sure) <= {index.ids[m] for _, m in got}


def test_terms():
    """Of a word's beginnings only those stay that say more than a surer and longer term; beginnings that toxic words share beat the words."""
    counts = {"los": (30, 25), "lose": (30, 5), "loser$": (30, 0), "gru": (40, 0), "grum": (40, 0), "grumb": (40, 0), "grumbel$": (20, 0)}
    assert toxicity.pick(counts, 1000, 9000) == ["grumb", "loser$", "grumbel$"]


@pytest.fixture(scope="module")
def found(spark):
    texts = [_text(RNG.randint(5, 60), 2 if i % 5 == 0 else 0) for i in range(400)]
    texts[0], texts[2], texts[4], texts[6], texts[8] = None, "", "  12 34 ", " ".join(PLAIN) * 2000 + " fnord fnord", " ".join(PLAIN * 3000)
    rows = [(i, t, "q") for i, t in enumerate(texts)] + [(None, "fnord", "q"), (9, texts[9], "q"), (9, "fnord grumbel", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string").selectExpr("*", "1 AS score", "2 AS key", "3 AS a", "4 AS evidence").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(10, 400)] + [(11, None), (12, 7), (None, 1)], "doc_id long, toxic int")
    return rows, toxicity.score(docs, labels).collect()


def test_planted(found):
    rows, got = found
    assert len(got) == len(rows)
    assert all(r.held_out == _held_out(r.doc_id) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    once = [r for r in got if r.doc_id is not None and r.doc_id > 9 and r.held_out]
    assert len(once) > 50 and all(r.predicted == (r.doc_id % 5 == 0) for r in once)
    assert all(r.evidence[0].toxic == 1 and not _held_out(r.evidence[0].id) for r in once if r.predicted)


def test_edges(found):
    """Nothing to compare gives the same low score; very long texts are read to their end; repeated ids are rows of their own."""
    _, got = found
    by_id = {r.doc_id: r for r in got if r.doc_id != 9}
    assert by_id[0].score == by_id[2].score == by_id[4].score == by_id[8].score < 0.3 and by_id[0].evidence == []
    assert by_id[6].predicted == 1 and by_id[None].predicted == 1 and by_id[None].held_out is False
    assert sorted(r.predicted for r in got if r.doc_id == 9) == [0, 0, 1]


def test_one_class_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "fnord"), (3, "x y")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, one).collect()] == [1.0, 1.0]
    none = one.where("toxic = 0")
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.where(F.lit(False)), one).count() == 0
