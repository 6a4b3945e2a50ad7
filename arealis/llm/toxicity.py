"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are the words of a text (runs of letters, lower case) and their beginnings. Only terms that toxic examples use far more than
clean ones, by occurrences and by a likelihood-ratio test, span the vectors, so a text's cosine is about these and not about the
length and topic of the rest. Term frequency counts as 1 + ln tf; document frequencies are counted over all rows.

1. Choose at most `train_rows` distinct labelled texts (those of the smallest hashes) as examples, and the terms by counts over them.
2. Turn every text into its sparse vector, once, and store that; count the terms' document frequencies from the stored vectors.
3. Index the examples: postings by term, in blocks of examples with the largest weight in each. A search adds up the query's
   block maxima, opens blocks from the highest bound down, and stops when no bound reaches the k-th cosine found: exact.
4. Votes of the `nearest` examples are weighted by squared cosine over distance; a logistic curve, fitted on examples that each look among
   the others only, turns the share of toxic votes into a probability. The nearest examples are the evidence.

The index holds at most train_rows x TERMS weights and goes to every task; everything else grows with the table and stays spread.

Defined results: null and empty texts, and any without such terms, have no neighbours and get the curve's value at no votes; labels other than
0 and 1 are left out; contradicting labels of a text count by its least id and label; equal cosines go by the example's id;
without examples of both classes every score is the share of toxic examples (0 without any). Each row gives one row, repeated rows
repeated results; other columns take no part, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from arealis.llm.common import Scratch, map_rows, release, store, text_key, text_or_empty
from arealis.llm.nbsvm import logistic

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of beginnings that count as terms besides whole words, which carry an end mark.
STARTS, END = (3, 4, 5, 6, 7), "$"
#: Terms that span the vectors at most, and what a term needs: examples that hold it, odds over clean ones, and the test's value.
TERMS, HOLDERS, ODDS, SURE = 2048, 5, 4.0, 25.0
#: Occurrences of a term that one example adds to the counts at most.
REPEATS = 4
TRAIN_ROWS, NEAREST, SHOWN = 6000, 15, 5
#: Examples in a block of the index; weight of no vote at all; distance that is added to all; words whose terms a worker remembers.
BLOCK, DOUBT, APART, MEMORY = 64, 1.0, 0.1, 1 << 19


def terms_of(word: str) -> list[str]:
    return [*(word[:n] for n in STARTS if n < len(word)), word + END]


def term_counts(text: str) -> Counter:
    found: Counter = Counter()
    for word, c in Counter(WORD.findall(text.lower())).items():
        for t in terms_of(word):
            found[t] += c
    return found


class Vectors:
    """Term numbers and counts of texts, for a chosen vocabulary; words that were met keep their terms."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.places, self.met = {t: i for i, t in enumerate(vocabulary)}, {}

    def of(self, text: str) -> tuple[list[int], list[int]]:
        met, found = self.met, {}
        for word, c in Counter(WORD.findall(text.lower())).items():
            places = met.get(word)
            if places is None:
                if len(met) >= MEMORY:
                    met.clear()
                places = met[word] = tuple(self.places[t] for t in terms_of(word) if t in self.places)
            for p in places:
                found[p] = found.get(p, 0) + c
        order = sorted(found)
        return order, [found[p] for p in order]


@dataclass
class Index:
    """Postings by term: examples in ascending order, their weights, and where each block of BLOCK examples begins in them."""

    idf: np.ndarray
    ids: list
    toxic: np.ndarray
    examples: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    begins: list[np.ndarray] = field(default_factory=list)
    most: np.ndarray | None = None
    slope: float = 0.0
    shift: float = 0.0

    def weigh(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(counts)) * self.idf[places]
        return raw / np.sqrt(raw @ raw) if len(raw) else raw

    def search(self, places: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k nearest as (cosine, number), nearest first, ties by number; none at a cosine of 0."""
        if not len(places) or not len(self.ids):
            return []
        bounds, found = weights @ self.most[places] + 1e-6, []
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 1e-6 or (len(found) == k and bounds[b] < found[-1][0]):
                break
            total = np.zeros(BLOCK)
            for p, w in zip(places, weights, strict=True):
                lo, hi = self.begins[p][b], self.begins[p][b + 1]
                if lo < hi:
                    total[self.examples[p][lo:hi] - b * BLOCK] += w * self.weights[p][lo:hi]
            floor = found[-1][0] if len(found) == k else 0.0
            fresh = [(float(total[i]), int(b * BLOCK + i)) for i in np.flatnonzero((total > 0) & (total >= floor)) if b * BLOCK + i != without]
            found = sorted(found + fresh, key=lambda x: (-x[0], self.ids[x[1]]))[:k]
        return found

    def vote(self, found: list[tuple[float, int]]) -> float:
        """Share of toxic votes, each weighted by its squared cosine over its distance."""
        weights = [(c * c / (max(0.0, 1 - c) + APART), self.toxic[i]) for c, i in found]
        return sum(w for w, y in weights if y) / (sum(w for w, _ in weights) + DOUBT)

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30)))) if 0 < self.toxic.sum() < len(self.toxic) else float(self.toxic.mean() if len(self.toxic) else 0.0)


def build(rows: list[tuple], idf: np.ndarray, nearest: int = NEAREST) -> Index:
    """The index over rows (id, toxic, places, counts), examples with the same heaviest term beside each other, and its curve."""
    out = Index(idf, [], np.zeros(0))
    vectors = [(i, y, p, out.weigh(p, c)) for i, y, p, c in rows]
    heaviest = [int(p[np.argmax(w)]) if len(p) else -1 for _, _, p, w in vectors]
    vectors = [vectors[j] for j in sorted(range(len(vectors)), key=lambda j: (heaviest[j], vectors[j][0]))]
    out.ids, out.toxic = [v[0] for v in vectors], np.array([v[1] for v in vectors], "f8")
    blocks = -(-len(vectors) // BLOCK)
    sizes = [len(v[2]) for v in vectors]
    holder = np.repeat(np.arange(len(vectors)), sizes)
    place = np.concatenate([v[2] for v in vectors]) if vectors else np.zeros(0, int)
    weight = np.concatenate([v[3] for v in vectors]) if vectors else np.zeros(0)
    order = np.lexsort((holder, place))
    holder, place, weight = holder[order], place[order], weight[order]
    edges = np.searchsorted(place, np.arange(len(idf) + 1))
    out.most = np.zeros((len(idf), blocks))
    np.maximum.at(out.most, (place, holder // BLOCK), weight)
    for t in range(len(idf)):
        part = slice(edges[t], edges[t + 1])
        out.examples.append(holder[part])
        out.weights.append(weight[part])
        out.begins.append(np.searchsorted(holder[part], np.arange(blocks + 1) * BLOCK))
    if 0 < out.toxic.sum() < len(out.toxic):
        votes = np.array([out.vote(out.search(v[2], v[3], nearest, i)) for i, v in enumerate(vectors)])
        out.slope, out.shift = logistic(votes, out.toxic == 1)
    return out


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def examples(keyed: DataFrame, labels: DataFrame, label_col: str, id_col: str, train_rows: int) -> DataFrame:
    """(a, b, key, y): at most train_rows distinct texts with a label that may be learnt from, those of the smallest hashes."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).distinct()
    met = keyed.select("key", "a", "b").join(known, "key").groupBy("a", "b").agg(F.min(F.struct("key", "y")).alias("m")).select("a", "b", "m.key", "m.y")
    return met.orderBy(F.xxhash64("a", "b"), "a", "b").limit(train_rows)


def vocabulary(texts: DataFrame) -> list[str]:
    """The terms that mark toxic texts (y, text), the surest first."""

    def count(part: pa.RecordBatch) -> dict:
        held, used = (Counter(), Counter()), (Counter(), Counter())
        for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
            for t, c in term_counts(text).items():
                held[y][t] += 1
                used[y][t] += min(c, REPEATS)
        terms = sorted(held[0].keys() | held[1].keys())
        return {"term": terms, "held": [held[1][t] for t in terms], "dirty": [used[1][t] for t in terms], "clean": [used[0][t] for t in terms]}

    counts = store(map_rows(texts, "text", "term string, held long, dirty long, clean long", count), "toxic-terms")
    dirty, clean = counts.agg(F.coalesce(F.sum("dirty"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    if not dirty or not clean:
        return []
    summed = counts.groupBy("term").agg(F.sum("held").alias("held"), F.sum("dirty").alias("dirty"), F.sum("clean").alias("clean"))
    candidates = summed.where((F.col("held") >= HOLDERS) & ((F.col("dirty") + 0.5) / dirty >= ODDS * (F.col("clean") + 0.5) / clean))
    rows = candidates.orderBy(F.desc("dirty"), "clean", "term").limit(8 * TERMS).collect()
    return pick({r["term"]: (r["dirty"], r["clean"]) for r in rows}, dirty, clean)


def surety(dirty: int, clean: int, all_dirty: int, all_clean: int) -> float:
    """Twice the log likelihood ratio of a term's occurrences against even use; 0 where toxic texts don't use it ODDS times as much."""
    if dirty <= 0 or (dirty + 0.5) / all_dirty < ODDS * (clean + 0.5) / all_clean:
        return 0.0
    even = (dirty + clean) / (all_dirty + all_clean)
    return 2 * (dirty * np.log(dirty / (even * all_dirty)) + (clean * np.log(clean / (even * all_clean)) if clean > 0 else 0.0))


def pick(counts: dict[str, tuple[int, int]], all_dirty: int, all_clean: int) -> list[str]:
    """The terms (toxic and clean occurrences) to keep, the surest first. What a term owes to a surer and longer one is taken off before it is judged."""
    left = {t: list(c) for t, c in counts.items()}
    order = sorted(counts, key=lambda t: (-round(surety(*counts[t], all_dirty, all_clean), 6), -len(t), t))
    kept = []
    for t in order:
        dirty, clean = left[t]
        if surety(dirty, clean, all_dirty, all_clean) < SURE:
            continue
        kept.append(t)
        for n in STARTS:
            if n < len(t.removesuffix(END)) and t[:n] in left:
                left[t[:n]][0] -= dirty
                left[t[:n]][1] -= clean
    return kept[:TERMS]


def vectors(keyed: DataFrame, terms: list[str]) -> DataFrame:
    """Rows (key, a, b, text) with `places` and `counts` in place of their text."""
    kind, made = keyed.schema["key"].dataType.simpleString(), []

    def run(part: pa.RecordBatch) -> dict:
        if not made:
            made.append(Vectors(terms))
        found = [made[0].of(t) for t in part.column("text").to_pylist()]
        return {"key": part.column("key"), "a": part.column("a"), "b": part.column("b"), "places": [f[0] for f in found], "counts": [f[1] for f in found]}

    return map_rows(keyed, "text", f"key {kind}, a long, b long, places array<int>, counts array<int>", run)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in column)])
    return [flat[ends[i] : ends[i + 1]] for i in range(len(column))]


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.3, train_rows: int = TRAIN_ROWS, nearest: int = NEAREST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, held_out, score, predicted, and evidence: the nearest examples as (id, toxic, cosine), nearest first, SHOWN at most."""
    with Scratch() as scratch:
        text = text_or_empty(text_col)
        a, b = text_key(text)
        keyed = docs.select(F.col(id_col).alias("key"), a.alias("a"), b.alias("b"), text.alias("text"))
        chosen = store(examples(keyed, labels, label_col, id_col, train_rows), "toxic-examples")
        few = F.broadcast(chosen.select("a", "b", "y"))  # at most train_rows rows
        terms = vocabulary(keyed.select("a", "b", "text").join(few, ["a", "b"]).groupBy("a", "b").agg(F.first("y").alias("y"), F.first("text").alias("text")))
        spread = scratch.keep(store(vectors(keyed, terms), "toxic-vectors"))
        n, held = spread.count(), dict(spread.select(F.explode("places").alias("p")).groupBy("p").count().collect())  # a row for each term
        idf = np.array([np.log((1 + n) / (1 + held.get(t, 0))) + 1 for t in range(len(terms))])
        known = spread.join(F.broadcast(chosen.select("a", "b", F.col("key").alias("id"), "y")), ["a", "b"]).groupBy("id", "y", "a", "b").agg(F.first("places").alias("places"), F.first("counts").alias("counts"))
        found = known.select("id", "y", "places", "counts").toArrow()  # at most train_rows rows of TERMS numbers
        parts = {c: found.column(c).combine_chunks() for c in ("places", "counts")}
        index = build(list(zip(found.column("id").to_pylist(), found.column("y").to_pylist(), _arrays(parts["places"]), _arrays(parts["counts"]), strict=True)), idf, nearest)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            scores, shown = [], []
            for places, counts in zip(_arrays(batch.column("places")), _arrays(batch.column("counts")), strict=True):
                same = (places.tobytes(), counts.tobytes())
                if same not in seen:
                    if len(seen) >= MEMORY >> 4:
                        seen.clear()
                    near = index.search(places, index.weigh(places, counts), nearest)
                    seen[same] = index.score(index.vote(near)), [{"id": index.ids[i], "toxic": int(index.toxic[i]), "cosine": round(min(c, 1.0), 6)} for c, i in near[:SHOWN]]
                value, evidence = seen[same]
                scores.append(value)
                shown.append(evidence)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores, "f8"), pa.array(shown, target)], names=["key", "score", "evidence"])
        release()

    shape = f"array<struct<id:{kind},toxic:int,cosine:double>>"
    target = to_arrow_type(T.DataType.fromDDL(shape))
    scored = spread.select("key", "places", "counts").mapInArrow(run, f"key {kind}, score double, evidence {shape}")
    return scored.select(F.col("key").alias(id_col), held_out("key").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence")
