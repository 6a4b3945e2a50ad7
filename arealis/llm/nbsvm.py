"""Quality classifier: naive Bayes support vectors.

A text is a set of indicators: its byte n-grams, and n-grams over marks of whether a word repeats the one before it, all
hashed into 2**BITS places. Each indicator is scaled by the log ratio of its smoothed shares in both classes, and each vector
to unit length. A linear hinge-loss model with a bias is fitted by dual coordinate descent, classes weighted alike;
a logistic curve fitted on rows kept out of that fit turns margins into scores.

The fit uses at most `train_rows` labels, those whose ids have the smallest hashes, with one text each (of several, the one of the smallest hash); their indicator sets, not their
texts, come to the driver. Every row is scored, from its whole text alone.

Defined results: a null text counts as empty and an empty one is scored by the bias; labels other than 0 and 1 are left out;
without labels of both classes every score is 0.5. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealis.llm.common import map_rows, release, text_key, text_or_empty

BITS = 18
#: Byte n-gram lengths and the lengths of repetition n-grams.
GRAMS, REPEATS = (1, 3, 4), (1, 2, 3)
TRAIN_ROWS = 6000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def indicators(text: str) -> np.ndarray:
    """The sorted places of a text's indicators."""
    data = np.frombuffer(text.encode(), "u1").astype("u8")
    found, codes = [], data
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            codes = (codes[:-1] << np.uint64(8)) | data[n - 1 :]
        if n in GRAMS and len(codes):
            found.append(np.unique(codes) * GOLDEN + np.uint64(n * 0xC2B2AE3D27D4EB4F % (1 << 64)) >> np.uint64(64 - BITS))
    words = text.split()
    marks = "".join(["1" if a == b else "0" for a, b in zip(words, words[1:], strict=False)])
    tokens = {marks[i : i + n] for n in REPEATS for i in range(len(marks) - n + 1)} if "1" in marks else set()
    found.append(np.array([int("1" + t, 2) * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - BITS for t in sorted(tokens)], "u8"))
    return np.unique(np.concatenate(found)).astype("i4")


@dataclass
class Model:
    """slope and shift make the logistic curve; `weight` is the product of ratio and weight, `square` that of the ratio with itself."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float = 0.0
    shift: float = 0.0

    def margin(self, places: np.ndarray) -> float:
        length = float(np.sqrt(self.square[places].sum(dtype="f8"))) if len(places) else 0.0
        return (float(self.weight[places].sum(dtype="f8")) / length if length else 0.0) + self.bias

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -30, 30))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 15, seed: int = 0) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; the last weight is the bias."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norms = np.array([v @ v + 1 for v in values])
    cap = {s: cost * len(y) / 2 / max(1, int((y == s).sum())) for s in (-1, 1)}
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[size]) - 1
            step = min(max(alpha[i] - gradient / norms[i], 0.0), cap[int(y[i])]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * values[i]
                w[size] += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> Model:
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(size, "f4"), np.zeros(size, "f4"), 0.0)
    y = np.where(labels == 1, 1, -1)
    kept = np.arange(len(rows)) % 5 != 0 if min((y == 1).sum(), (y == -1).sum()) >= 25 else np.ones(len(rows), bool)
    counts = {s: np.full(size, smooth) for s in (-1, 1)}
    for x, s in zip(rows, y, strict=True):
        counts[int(s)][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    values = [(ratio[x] / (np.linalg.norm(ratio[x]) or 1.0)).astype("f4") for x in rows]
    part = np.flatnonzero(kept)
    w = descend([rows[i] for i in part], [values[i] for i in part], y[part], size)
    model = Model((ratio * w[:-1]).astype("f4"), (ratio * ratio).astype("f4"), float(w[-1]))
    rest = part if kept.all() else np.flatnonzero(~kept)
    model.slope, model.shift = logistic(np.array([model.margin(rows[i]) for i in rest]), y[rest] == 1)
    return model


def logistic(margins: np.ndarray, hits: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, targets drawn in from 0 and 1 by the class counts."""
    up, down = int(hits.sum()), int((~hits).sum())
    target = np.where(hits, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).distinct()
    chosen = known.orderBy(F.xxhash64("key"), "key", "y").limit(train_rows)
    a, b = text_key(text_or_empty(text_col))
    met = docs.select(F.col(id_col).alias("key"), a.alias("a"), b.alias("b"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "key")
    texts = met.groupBy("key", "y").agg(F.min_by("text", F.struct("a", "b")).alias("text"))  # at most train_rows rows, however often an id stands

    def rows(part: pa.RecordBatch) -> dict:
        sets = [indicators(t) for t in part.column("text").to_pylist()]
        return {"key": part.column("key"), "y": part.column("y"), "places": [s.tobytes() for s in sets]}

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_rows(texts, "text", f"key {kind}, y int, places binary", rows).toArrow().sort_by([("key", "ascending"), ("y", "ascending")])
    y, places = np.array(found.column("y").to_pylist()), found.column("places")
    found = None
    model = fit([np.frombuffer(p.as_buffer(), "i4") for p in places], y)
    places = None
    release()
    return model


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", train_docs: DataFrame | None = None) -> DataFrame:
    """Every row of docs with held_out, score and predicted beside its own columns (theirs give way if the names clash)."""
    model = train(docs if train_docs is None else train_docs, labels, label_col, train_rows, id_col, text_col)
    base = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")))
    fields = base.schema.fields
    inner = [f"own_{i}" for i in range(len(fields))]

    def run(batches):
        for batch in batches:
            scores = [model.score(indicators(t.as_py() or "")) for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in inner), pa.array(scores, "f8")], names=[*inner, "score"])
        release()

    shown = base.toDF(*inner)
    out = shown.withColumn("body", text_or_empty(inner[base.columns.index(text_col)])).mapInArrow(run, T.StructType([*shown.schema.fields, T.StructField("score", T.DoubleType())]))
    return out.select(*(F.col(n).alias(f.name) for n, f in zip(inner, fields, strict=True)), held_out(inner[base.columns.index(id_col)]).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
