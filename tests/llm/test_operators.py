"""Operators over a small table with copies, near copies, nulls, empty and long texts, ties and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from arealis.llm import byte_bpe, decontam, graph, license_scan, matroska, nbsvm, ngram_jaccard, orc_tokens, suffix_dedup, token_counts, window_index

RNG = random.Random(4)
WORDS = ["w%d" % i for i in range(3000)]


def _prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE, ITEM = _prose(60), _prose(20)
BASE = _prose(120)
NEAR = BASE.split()
NEAR[50] = "changed"
TEXTS = [BASE, BASE, " ".join(NEAR), _prose(30) + " " + PASSAGE + "\n" + _prose(10), PASSAGE + " " + _prose(50), None, "", "   ", "one two", "One TWO", _prose(8000), "Released under the MIT License.\n" + _prose(5), _prose(6) + " " + ITEM.upper() + " tail", "ab " * 300, "é" * 900]
BENCH = [(1, ITEM), (2, "w1 absent"), (3, None), (4, "  "), (None, ITEM), (1, ITEM)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id text", "x"), (0, BASE, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_jaccard(docs, nothing):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: min([j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] or [i]) for i in sets}
    got = by_id(ngram_jaccard.join(docs).where("doc_id is not null").select("doc_id", "n_shingles", "component_id"))
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}
    assert ngram_jaccard.join(nothing).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = by_id(graph.components(spark.createDataFrame(edges, "x long, y long")))
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[90] == got[95] != got[0]


def test_licenses(docs, nothing):
    got = [tuple(r) for r in license_scan.scan(docs).select("doc_id", "unit", "place", "license", "dice").collect()]
    assert got == [(11, "line", 1, "MIT", 1.0)]
    assert license_scan.scan(nothing).count() == 0


def test_license_runs(spark):
    notice, body = license_scan.TEMPLATES["GPL-3.0-header"].split(), license_scan.TEMPLATES["MIT-text"]
    wrapped = "\n".join(" ".join(notice[i : i + 7]) for i in range(0, len(notice), 7))
    short = license_scan.TEMPLATES["CC-BY-NC-4.0"]
    cut = body.split()
    del cut[30:34], cut[90:93]
    texts = [_prose(40) + "\n" + wrapped + "\n" + _prose(300), _prose(50) + "\n\n" + body + "\n" + _prose(400), body, _prose(30) + " " + short + " " + _prose(30), "x\nAll rights reserved.\ny", _prose(20) + "\n" + " ".join(cut) + "\n" + _prose(20) + " " + short + "\n" + _prose(400), "Released under the MIT License.", license_scan.TEMPLATES["GPL-3.0-text"] + "\n" + _prose(7000)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(6, texts[6])], "doc_id long, text string")
    got = sorted(tuple(r) for r in license_scan.scan(rows).select("doc_id", "unit", "place", "license", F.round("dice", 3)).collect())
    assert [g for g in got if g[0] == 0] == [(0, "run", 2, "GPL-3.0-header", 1.0)]
    assert [g for g in got if g[0] == 1] == [(1, "run", 3, "MIT-text", 1.0)]
    assert [g for g in got if g[0] == 2] == [(2, "text", 0, "MIT-text", 1.0)]
    assert [g for g in got if g[0] == 3] == [(3, "run", 1, "CC-BY-NC-4.0", 1.0)]
    assert [g for g in got if g[0] == 4] == [(4, "line", 2, "All-rights-reserved", 1.0)]
    assert [g[:4] for g in got if g[0] == 5] == [(5, "line", 2, "MIT-text"), (5, "run", 3, "CC-BY-NC-4.0")]
    assert [g for g in got if g[0] == 6] == 2 * [(6, "line", 1, "MIT", 1.0)]
    assert (7, "run", 1, "GPL-3.0-text", 1.0) in got


def test_decontamination(spark, docs, nothing):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(docs, bench).collect()}
    assert got[12] == (27, 20, ["1"], True)
    assert got[5] == got[6] == (0, 0, [], False) and sum(v[3] for v in got.values()) == 1
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(nothing, bench).count() == 0
    windows, index = decontam.build_index(docs, decontam._items(bench, "item_id", "text"), 13, "doc_id", "text")
    assert decontam.proximity(windows, index, 30).count() > 0


def test_proximity(spark):
    rng = random.Random(9)
    item = ["k%d" % i for i in range(20)]
    changed = [x for w in item for x in (w, "between")]
    shuffled = rng.sample(item, 20)
    texts = [" ".join(t) for t in (changed, shuffled, item, item[::-1], [item[0], *["far"] * 40, *item[1:2]], ["none"], [item[0], "x", item[5], item[0]])]
    bench = spark.createDataFrame([("i", " ".join(item)), ("j", "k3 other words")], "item_id string, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = decontam.store(decontam._items(bench, "item_id", "text"), "t")
    for within in (13, 5):
        windows, index = decontam.build_index(docs, items, 13, "doc_id", "text")
        got = Counter(tuple(r) for r in decontam.proximity(windows, index, within).join(docs.select("doc_id", F.xxhash64("text").alias("a")), "a").select("doc_id", "k", "s", "p1", "p2").collect())
        want = Counter()
        for w in windows.where("q1 <> q2").collect():
            for i, t in enumerate(texts):
                words = t.split()
                want.update((i, w.k, w.s, p, q) for p, x in enumerate(words) for q, y in enumerate(words) if x == w.w1 and y == w.w2 and 0 < abs(p - q) <= within)
        assert got == want and {g[0] for g in got} >= {0, 1, 2, 3}
        found = {r.doc_id: (r.n_near, r.near_items, r.n_hit) for r in decontam.contamination(docs, bench, within=within).collect()}
        ids = {r.k: r.item for r in items.collect()}
        assert {i: v[1] for i, v in found.items()} == {i: sorted({ids[g[1]] for g in got if g[0] == i}) for i in range(len(texts))}
        assert found[1][2] == 0 and found[2][2] == 20


def _dedup(seqs, width, glue):
    seen = Counter(bytes(s[i : i + width]) if isinstance(s, bytes) else tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
    out = []
    for s in seqs:
        gone = set()
        for i in range(len(s) - width + 1):
            if seen[bytes(s[i : i + width]) if isinstance(s, bytes) else tuple(s[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(s), len(gone), hashlib.sha256(glue([x for k, x in enumerate(s) if k not in gone])).hexdigest()))
    return out


def _all(docs):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect()), key=lambda x: x[0])


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(docs, nothing, monkeypatch, hot):
    monkeypatch.setattr("arealis.llm.anchors.HOT", hot)
    rows = _all(docs)
    want = Counter((i, *v) for (i, _), v in zip(rows, _dedup([(t or "").encode() for _, t in rows], 120, bytes), strict=True))
    got = Counter((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digests(suffix_dedup.dedup(docs, width=120, gram=16)).collect())
    assert got == want
    assert hot == 1 or suffix_dedup.dedup(nothing).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(docs, nothing, monkeypatch, hot):
    monkeypatch.setattr("arealis.llm.anchors.HOT", hot)
    rows = _all(docs)
    want = Counter((i, *v) for (i, _), v in zip(rows, _dedup([(t or "").encode().split() for _, t in rows], 35, b" ".join), strict=True))
    got = Counter((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in window_index.digests(window_index.dedup(docs)).collect())
    assert got == want
    assert hot == 1 or window_index.dedup(nothing).count() == 0


def test_media(docs, nothing):
    media = matroska.media_column(docs)
    got = by_id(matroska.media_features(media).where("doc_id is not null").select("doc_id", "n_bytes", "payload_sha256", "tail_crc32"))
    for i, t in enumerate(TEXTS):
        held = matroska.payload((t or "").encode())
        assert got[i] == (len((t or "").encode()), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]))
    broken = media.withColumn("media", F.lit(b"junk")).limit(1)
    assert matroska.packets(broken).first()["fault"] and matroska.packets(media).where("fault is not null").count() == 0
    assert matroska.media_features(matroska.media_column(nothing)).count() == 0


def test_tokens(docs, nothing):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in byte_bpe.encode_documents(docs, path, P.PATTERN).collect()}
    assert all(got[i][1] == (t or "").encode() for i, t in enumerate(TEXTS)) and got[5][0] == []
    digests = by_id(byte_bpe.encode_digests(docs, path, P.PATTERN).select("doc_id", "n_tokens"))
    assert all(digests[i][0] == len(got[i][0]) for i in range(len(TEXTS)))
    counts = by_id(token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")))
    assert counts[5] == (0, 0, False) and counts[10][2] and byte_bpe.encode_digests(nothing, path, P.PATTERN).count() == 0


def test_orc(spark, docs, nothing):
    found = orc_tokens.stored_offsets(docs, P.path("word_bpe_49k.json")).collect()
    rows = sorted(found, key=lambda r: r.start)
    assert len(rows) == docs.count() and rows[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    assert orc_tokens.stored_offsets(nothing, P.path("word_bpe_49k.json")).count() == 0


def test_quality(spark, docs, nothing):
    text = [(i, _prose(20) if i % 2 else _prose(20).upper() + "!!", i % 2) for i in range(200)]
    table = spark.createDataFrame(text, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").unionAll(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    got = nbsvm.classify(table, labels).collect()
    assert all(r.predicted == r.quality for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    clash = nbsvm.classify(docs, labels, train_docs=table)
    assert dict(clash.dtypes)["score"] == "double" and clash.count() == docs.count()
    assert {r.score for r in nbsvm.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert nbsvm.classify(nothing, labels).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Planted cases for the pipeline, with edge rows and columns whose names the stages use inside."""
    good = [_prose(80) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[0]), (101, " ".join(["x", *good[1].split()[1:]])), (102, _prose(40) + " " + PASSAGE), (103, PASSAGE + " " + _prose(45)), (104, ITEM + " " + _prose(10))] + [(200 + i, _prose(30).upper() + "!!") for i in range(60)]
    rows += [(70, good[5]), (None, good[6]), (None, _prose(70)), (71, good[7]), (71, good[7]), (72, _prose(30_000))]
    extra = {"score": 77.0, "predicted": 5, "a": "1", "b": "2", "left_over": "l", "own_1": "o", "arealis_text": "z", "key_a": 1, "kept": "k", "s1": 1, "n": 2, "comp": "c"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, a string, b string, left_over string, own_1 string, arealis_text string, key_a int, kept string, s1 int, n int, comp string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *extra.values()) for i, t in rows], schema)
    base = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, _ in rows if i is not None], "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows, good, extra


def _stages(spark, now, base, out):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in pipeline.STAGES:
        before = now
        stage(spark, now, base).write.parquet(f"{out}/{name}")
        now = spark.read.parquet(f"{out}/{name}")
        yield name, before, now


def test_pipeline_stages(spark, corpus, tmp_path):
    base, rows, good, extra = corpus
    left, texts = {}, {}
    for name, before, now in _stages(spark, spark.read.parquet(f"{base}/documents.parquet"), base, f"file://{tmp_path}"):
        left[name] = Counter(r.doc_id for r in now.collect())
        if name == "tokens":
            assert now.columns == ["doc_id", "n_tokens", "ids"]
            continue
        assert now.columns == before.columns and now.where(" and ".join(f"`{k}` = '{v}'" for k, v in extra.items())).count() == now.count()
        texts[name] = [(r.doc_id, r.text) for r in now.collect()]
    assert left["quality"] == Counter(i for i, _ in rows if i is None or i < 200)
    assert left["quality"] - left["near_duplicates"] == Counter({100: 1, 101: 1, 70: 1, None: 1, 71: 2}) and left["near_duplicates"][7] == 1
    assert left["near_duplicates"] == left["substrings"]
    kept = dict(texts["substrings"])
    assert PASSAGE not in kept[102] and len(kept[102].split()) == 40 and kept[5] == good[5]
    before = sorted(texts["near_duplicates"], key=str)
    want = {}
    for (i, t), (_, gone, digest) in zip(before, _dedup([t.encode().split() for _, t in before], 35, b" ".join), strict=True):
        want[i] = digest if gone else hashlib.sha256(t.encode()).hexdigest()
    assert want == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts["substrings"]}
    assert left["substrings"] - left["decontaminate"] == Counter({104: 1}) and left["tokens"] == left["decontaminate"]


def test_pipeline_edges(spark, corpus, tmp_path):
    base = corpus[0]
    schema = "text string, extra string, doc_id long"
    edges = [(None, "n", 1), ("", "e", 2), ("  ", "s", 2), (None, "n", None), ("", "x", None)]
    for k, rows in enumerate(([], edges)):
        docs = spark.createDataFrame(rows, schema)
        pipeline = pytest.importorskip("corpus_pipeline")
        for _name, stage in pipeline.STAGES[1:]:
            out = stage(spark, docs, base)
            assert Counter(r.doc_id for r in out.collect()) == Counter(r[2] for r in rows)
        assert pipeline.quality(spark, docs, base).columns == docs.columns and k < 2


def test_jaccard_chain_and_groups(spark):
    """Chains whose ends don't link, a group of near copies over one chunk, and sentences drawn from one pool, against all pairs."""
    rng = random.Random(5)
    chain, texts = [_prose(1) + str(i) for i in range(60)], []
    for k in range(12):
        texts.append(" ".join(chain[k : k + 45]))
    base = _prose(60).split()
    for _ in range(330):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(60)] = "e%d" % rng.randrange(10**6)
        texts.append(" ".join(t))
    pool = [_prose(9) for _ in range(25)]
    texts += [" ".join(rng.sample(pool, 8)) for _ in range(60)] + ["a b", "a  B", "c", " ", None]
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(sets)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    got = by_id(ngram_jaccard.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).select("doc_id", "n_shingles", "component_id"))
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))}
    assert len(set(comp[12:342])) > 5


def test_index_reopened(spark):
    """A later session opens the index; copies and shared passages across batches count, and it agrees with one pass over all."""
    from arealis.llm import anchors

    texts = [t or "" for t in TEXTS[:11]]
    old = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 2 == 0], "doc_id long, text string")
    new = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 2] + [(50, BASE)], "doc_id long, text string")
    index = window_index.FingerprintIndex(spark, anchors.Unit(True, 35, 6))
    index.ingest(old)
    for name in index.state["grams"]:
        spark.sql(f"DROP TABLE {name}")
    again = window_index.FingerprintIndex.open(spark, index.path)
    got = Counter(tuple(r) for r in window_index.digests(window_index.append(again, new, old)).collect())
    want = Counter(tuple(r) for r in window_index.digests(window_index.dedup(old.unionAll(new))).join(new.select("doc_id").distinct(), "doc_id").collect())
    assert got == want and any(r[2] for r in got)
    again.compact()
    last = window_index.FingerprintIndex.open(spark, index.path)
    assert len(last.state["grams"]) == 1 and last.keys().count() == again.keys().count() > 0


def test_sets_that_share_a_key(spark):
    """With six bits for the key of a set, different sets meet in one; they stay apart, and copies and links stay together."""
    rng = random.Random(21)
    base = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(9)]
    texts = base + [base[0], base[1].replace(base[1].split()[30], "changed", 1), base[2].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    keys = [ngram_jaccard.set_key(ngram_jaccard.tokens_of(t.encode(), 5), 0, 6)[0] for t in base]
    assert len(set(keys)) < len(keys)  # the first salt must not do
    whole, few = ({r.id: r.comp for r in ngram_jaccard.groups(docs, bits=b).collect()} for b in (64, 6))
    apart = lambda found: {frozenset(i for i in found if found[i] == c) for c in found.values()}
    assert apart(whole) == apart(few) == {frozenset(x) for x in ([0, 9], [1, 10], [2, 11], [3], [4], [5], [6], [7], [8])}


def test_tokens_that_agree_in_48_bits():
    """Blocks count both places of a set's two tokens whose first 48 bits agree."""
    import numpy as np

    block = ngram_jaccard.Block([0], 1)
    tokens = np.array([(5 << 16) + 1, (5 << 16) + 2, (9 << 16)], "u8")
    block.add(1, tokens, 0)
    block.add(2, tokens, 0)
    (row,) = [r for r in block.rows() if r[2] == 0]
    assert len(ngram_jaccard.long(row[5])) == 6


def test_one_training_text_for_each_id(spark):
    """An id that stands on many texts gives one row to the fit; ties at the threshold count as predicted."""
    docs = spark.createDataFrame([(1, f"good text {i}") for i in range(50)] + [(i, "good words" if i % 2 else "bad noise") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    model = nbsvm.train(docs, labels, train_rows=200)
    assert model.score(nbsvm.indicators("good words")) > 0.5 > model.score(nbsvm.indicators("bad noise"))
    top = max(r.score for r in nbsvm.classify(docs, labels).collect())
    assert any(r.predicted == 1 and r.score == top for r in nbsvm.classify(docs, labels, threshold=top).collect())
