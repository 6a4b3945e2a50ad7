"""Parts of the operators against libraries, brute force and round trips; no Spark."""

import base64
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from arealis.llm import anchors, matroska, nbsvm, ngram_jaccard, suffix_array, suffix_dedup, window_index
from arealis.llm.byte_bpe import ByteBPE
from arealis.llm.orc_tokens import WordEncoder
from arealis.llm.token_counts import PieceCounter

BITS = ["a", "the", "The", "é", "ñ", "ß", "中", "\n", " ", "  ", "1", "😀", "x", "ing", "́", "\t", "'s", "Ж", "\x1c", "\x85", "\xa0", "▁", ".", ",", "..", "<|endoftext|>", "</s>", "İ", "Σ", "J"]
TEXTS = ["".join(r.choice(BITS) for _ in range(r.randint(0, 50))) for r in [random.Random(9)] for _ in range(1500)] + ["", " ", "x" * 5000]


def test_bpe_equals_tiktoken():
    bpe = ByteBPE.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in TEXTS:
        ids = bpe.encode(t)
        assert ids == other.encode_ordinary(t) and bpe.decode(ids) == t.encode()


def test_bpe_of_a_small_vocabulary():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aab": 260}
    bpe = ByteBPE(ranks, r"\S+|\s+")
    other = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for n in range(300):
        t = "".join(random.Random(n).choice("abc ") for _ in range(12))
        assert bpe.encode(t) == other.encode_ordinary(t)
    assert base64.b64encode(bpe.decode(bpe.encode("aabc"))) == base64.b64encode(b"aabc")


def test_counts_equal_sentencepiece():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    counter = PieceCounter(path)
    assert counter.cuts and len(counter.proved) > 30_000
    assert counter.count(TEXTS) == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(TEXTS, num_threads=1)]


def test_words_equal_tokenizers():
    encoder = WordEncoder(P.path("word_bpe_49k.json"))
    assert encoder.folds
    words = [random.Random(n).choices("aZé9ß.,$'<|>_-²«İKµªǅ\u0301\x0b\x0c", k=7) for n in range(3000)]
    texts = TEXTS + ["".join(w) for w in words] + [" ".join(map("".join, words[:400]))]
    ids, offsets = encoder.encode(pa.array(texts), 2)
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == encoder.ids(t) + [2], t
    assert encoder.encode(pa.array([], pa.string()), 2)[1].tolist() == [0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([2, 5, 100]))
def test_suffix_array_and_prefixes(symbols, limit):
    text = np.array([*symbols, 0])
    order = suffix_array.suffix_array(text, 5)
    want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert order.tolist() == want
    got = suffix_array.permuted_prefixes(text, order, limit)
    for i, j in zip(want[1:], want, strict=False):
        n = 0
        while n < limit and i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
            n += 1
        assert got[i] == n


def test_repeated_windows_in_a_shard():
    segments, copies = [b"abcabcabc", b"xxabcaxx", b"zzz\0\0zz"], [1, 1, 2]
    got = suffix_dedup.repeated_windows(segments, copies, 4)
    seen = Counter(s[i : i + 4] for s in segments[:2] for i in range(len(s) - 3))
    assert [f.tolist() for f in got[:2]] == [[seen[s[i : i + 4]] > 1 for i in range(len(s) - 3)] for s in segments[:2]]
    assert got[2].all()
    assert [f.tolist() for f in window_index.repeated_windows([b"a b c", b"b c d"], [1, 1], 2)] == [[False, True], [True, False]]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 9), st.integers(0, 20))
def test_equal_windows_have_equal_anchors(data, gram, more):
    width = gram + more
    symbols = np.frombuffer(data + data, "u1").astype("u8")
    key, place, first, n = anchors.runs_of(symbols, width, gram)
    assert n.sum() == max(len(symbols) - width + 1, 0)
    at = {}
    for k, p, f, c in zip(key, place, first, n, strict=True):
        for i in range(f, f + c):
            assert i <= p <= i + width - gram
            window = symbols[i : i + width].tobytes()
            assert at.setdefault(window, (k, p - i)) == (k, p - i)


def test_words_are_split_and_hashed_alike():
    data = "  Ab\tc\x0bd e " .encode() + b"f" * 200
    starts, ends, hashes = anchors.word_spans(data)
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == data.split()
    assert len(set(hashes.tolist())) == len(hashes)
    assert anchors.word_spans(b" Ab ")[2] == anchors.word_spans(b"Ab")[2]


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.FIXED, matroska.EBML_LACE, matroska.NO_LACE])
def test_lacing(kind):
    frames = [bytes([i]) * (300 if kind == matroska.FIXED else 40 + 270 * i) for i in range(1 if kind == matroska.NO_LACE else 4)]
    block = matroska.lace(frames, kind)
    assert [block[a : a + n] for a, n in matroska.unlace(block, 0, len(block), kind)] == frames


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=70_000))
def test_media_round_trip(data):
    held = matroska.payload(data)
    media = matroska.mux(held)
    parsed = matroska.parse(media)
    assert b"".join(media[o : o + n] for _, _, _, o, n in parsed.packets) == held and len(held) % 64 == 0 < len(held)
    assert [c[2] for c in parsed.cues] == parsed.clusters
    times = [p[1] for p in parsed.packets]
    assert times == [sum(p[4] for p in parsed.packets[:k]) * 125_000 for k in range(len(times))]


def test_unknown_sizes_and_damage():
    media = matroska.mux(matroska.payload(b"hello"))
    at = media.index(matroska.SEGMENT.to_bytes(4, "big")) + 4
    width = 9 - media[at].bit_length()
    open_ended = media[:at] + b"\x01" + b"\xff" * 7 + media[at + width :]
    assert len(matroska.parse(open_ended).packets) == 1
    for bad in (b"", b"junk", media[:-3]):
        with pytest.raises((ValueError, IndexError)):
            matroska.parse(bad)


def test_classifier_learns_and_handles_edges():
    random.seed(1)
    good = [" ".join(random.choice(["alpha", "beta", "gamma"]) for _ in range(30)) for _ in range(80)]
    bad = [t.upper() + "!!!" for t in good]
    model = nbsvm.fit([nbsvm.indicators(t) for t in good + bad], np.array([1] * 80 + [0] * 80))
    assert model.score(nbsvm.indicators("beta gamma alpha")) > 0.7 > 0.3 > model.score(nbsvm.indicators("BETA GAMMA!!!"))
    assert 0 <= model.score(nbsvm.indicators("")) <= 1
    assert nbsvm.fit([nbsvm.indicators("a")], np.array([1])).score(nbsvm.indicators("a")) == 0.5


def test_entries_are_enough():
    """Two sets at the threshold share an entry whatever their tokens' classes."""
    rng = np.random.default_rng(3)
    for trial in range(300):
        n = int(rng.integers(1, 60))
        common = np.unique(rng.integers(0, 1 << 63, n).astype("u8") * np.uint64(2))
        extra = lambda k: np.unique(rng.integers(0, 1 << 63, k).astype("u8") * np.uint64(2) + np.uint64(1))
        spare = int(0.25 * len(common))
        k = int(rng.integers(0, spare + 1))
        x, y = np.union1d(common, extra(k)), np.union1d(common, extra(spare - k))
        often = {int(t) for t in common if rng.random() < trial % 5 / 4}
        sides = []
        for s in (x, y):
            if 100 * len(common) < 80 * len(np.union1d(x, y)):
                break
            tokens = [(i, (int(t) >> 16) * 2 + (int(t) in often)) for i, t in enumerate(s)]
            sides.append(set(ngram_jaccard.entries(tokens, len(s), 80)))
        assert len(sides) < 2 or sides[0] & sides[1], (trial, len(x), len(y))
