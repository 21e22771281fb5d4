"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams in two streams of tokens of a text: its bytes (4-grams), and its words as their recency,
which is how many words ago the same word stood there, in powers of two, or that it is new (1- to 4-grams).  The first
stream shows what a text is made of, the second how it repeats itself, whatever its words.  N-grams are hashed.  Each
indicator is scaled by the log-count ratio of the two classes, rows have unit length, and a linear hinge-loss model is fitted
by dual coordinate descent (one dual variable a row, box [0, C]).  Margins of rows that the descent did not see calibrate a
logistic score.

Defined cases: null and empty texts have no indicators and get the score of the bias alone; without any label to learn from
every score is 0.5 and the filter rejects nothing; with labels, but fewer than LEAST texts of a class, training raises
ValueError; texts are read whole, however long; repeated rows get one row each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import slices
from vulnlake.llm.labelled import LEAST, logistic, sample_labels, too_few

#: Hash bits of byte and of recency n-grams, and the recency n-grams' longest n.
BITS, RECENT_BITS, LONGEST = 16, 14, 4
SIZE = (1 << BITS) + (1 << RECENT_BITS)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def recency(words: list[bytes]) -> np.ndarray:
    """For each word 0 if it is new, else the bit length of how many words ago it last stood there (15 at most)."""
    last: dict[bytes, int] = {}
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        before = last.get(w)
        if before is not None:
            out[i] = min((i - before).bit_length(), 15)
        last[w] = i
    return out


def indicators(text: str | None) -> np.ndarray:
    """Sorted numbers of the indicators that hold for a text."""
    data = text.encode() if text else b""
    own = [np.empty(0, np.int32)]
    if len(data) >= 4:
        wide = np.frombuffer(data, np.uint8).astype(np.uint32)
        four = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
        own.append(np.unique((four * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32))
    steps = recency(data.split())
    grams = []
    for n in range(1, min(LONGEST, len(steps)) + 1):
        code = np.full(len(steps) - n + 1, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(16) + steps[i : len(steps) - n + 1 + i]
        grams.append(code * _ODD >> np.uint64(64 - RECENT_BITS))
    if grams:
        own.append((np.unique(np.concatenate(grams)) + np.uint64(1 << BITS)).astype(np.int32))
    return np.concatenate(own)


@dataclass
class QualityModel:
    weights: np.ndarray  # per indicator, the log-count ratio included
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, own: np.ndarray) -> float:
        if not len(own):
            return self.bias
        r = self.ratios[own]
        return float(self.weights[own].sum() / max(np.sqrt(r @ r), 1e-9)) + self.bias

    def score(self, own: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(own) + self.shift, -30, 30))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias by dual coordinate descent; y is -1 or 1, cost the upper bound of each dual variable."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def fit(sample: list[tuple[int, np.ndarray]], counts: dict[int, int], smoothing: float = 1.0) -> QualityModel | float:
    """A model from (label, indicators) rows; 0.5 if there are none, an error if one class has too few."""
    seen = Counter(label for label, _ in sample)
    if not seen:
        return 0.5
    if too_few(seen):
        raise ValueError(f"quality: at least {LEAST} learning texts of each class are needed: {dict(seen)}")
    train, tune = [x for i, x in enumerate(sample) if i % 4], sample[::4]
    held = {0: np.full(SIZE, smoothing), 1: np.full(SIZE, smoothing)}
    for label, own in train:
        held[label][own] += 1
    ratios = np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())

    def scaled(own: np.ndarray) -> np.ndarray:
        r = ratios[own]
        return r / max(np.sqrt(r @ r), 1e-9)

    y = np.array([2 * label - 1 for label, _ in train])
    n = Counter(y.tolist())
    cost = np.array([len(y) / (2 * n[v]) for v in y.tolist()])
    w, bias = descend([own for _, own in train], [scaled(own) for _, own in train], y, SIZE, cost)
    model = QualityModel(w * ratios, ratios, bias, 1.0, 0.0)
    margins = np.array([[model.margin(own)] for _, own in tune])
    t = np.array([label for label, _ in tune])
    got = Counter(t.tolist())
    if len(got) == 2:
        weight = np.array([counts[label] / got[label] for label in t.tolist()])
        model.slope, model.shift = (float(x) for x in logistic(margins, t, weight * len(t) / weight.sum(), ridge=0.05))
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, id_col: str = "doc_id", text_col: str = "text") -> QualityModel | float:
    """Fit on about max_rows labelled texts at most; labels of held-out ids (crc32 divisible by 5) are never seen."""
    chosen, counts = sample_labels(labels, "quality", max_rows, id_col)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("long").alias("id"), "label", F.col(text_col).alias("text"))

    def features(batches):
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                own = pa.array([indicators(t).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), own], ["id", "label", "own"])

    found = rows.mapInArrow(features, "id long, label int, own binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], r["label"], r["own"]))
    return fit([(r["label"], np.frombuffer(r["own"], np.int32)) for r in found], counts)


def score_documents(docs: DataFrame, model: QualityModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not isinstance(model, QualityModel):
        return source.select(F.col("id").alias(id_col), F.lit(float(model)).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array([sent.value.score(indicators(t)) for t in texts], pa.float64())], ["id", "score"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel | float, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose score reaches the threshold; all rows where there was nothing to learn from."""
    if not isinstance(model, QualityModel):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start, texts in slices(batch.column(at)):
                yield batch.slice(start, len(texts)).filter(pa.array([sent.value.score(indicators(t)) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
