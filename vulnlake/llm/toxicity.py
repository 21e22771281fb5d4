"""Toxicity by compression distance.

Zstandard trains two kinds of dictionaries from a bounded labelled sample, each on texts of its own class.  Its base is
trained on the windows of ordinary texts.  Windows that recur in texts of a class (in `least` of them) and that the base
compresses badly (`costly` bytes on average) train the class's own end, which follows the base: one for toxic and one of the
same size for ordinary text.  A window is a word of the running text with the blanks beside it, cut at 62 bytes, compressed in
front of a carrier phrase that all dictionaries hold, since zstandard stores very short inputs as they are; a window shorter
than what the trainer picks at once is repeated to fill that.

A window's evidence is how many bytes shorter the toxic dictionary makes it than the ordinary one, averaged over PAIRS
pairs whose trainers read the windows in other orders: a single pair counts in whole bytes and knows some windows only by
chance.  Where the first pairs save nothing, the window's evidence is 0 and the others are not asked.  How many distinct windows of a text reach each of several thresholds goes into a logistic calibration, fitted on
labelled texts that took no part in the dictionaries.

Equal windows have equal evidence, so a worker keeps a bounded table of it (emptied when full).

Defined cases: null and empty texts have no windows and get the calibrated score of that; without any label to learn from
every score is 0.5 and the filter rejects nothing; with labels, but fewer than LEAST texts of a class, training raises
ValueError; texts are read whole; repeated rows get one row each; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import materialise, release, slices
from vulnlake.llm.labelled import LEAST, logistic, sample_labels, too_few

LETTERS = re.compile(r"[^\W\d_]+")
WINDOW = 62  # bytes of a word in one window
THRESHOLDS = tuple(x / 2 for x in range(3, 15))
PAIRS = 3
FIRST = 1  # bytes that the pairs so far have to have saved together, or the rest is not asked
SEGMENT, LEVEL, TABLE_BITS = 24, 12, 17  # zstandard's trainer and compressor
CACHE = 400_000
#: Of the sample's texts, one in so many calibrates.
FOLDS = 3


def windows_of(text: str | None) -> set[str]:
    """Distinct words of a text, lower-cased."""
    return set(LETTERS.findall(text.lower())) if text else set()


def window_bytes(word: str) -> list[bytes]:
    raw = word.encode()
    return [b" " + raw[i : i + WINDOW] + b" " for i in range(0, max(len(raw), 1), WINDOW)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(content), min_match=3, hash_log=TABLE_BITS, chain_log=TABLE_BITS, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


@dataclass
class ToxicModel:
    """pairs: contents of the ordinary and the toxic dictionary, and the carrier."""

    pairs: list[tuple[bytes, bytes, bytes]]
    weights: list[float] = field(default_factory=list)

    def opened(self) -> Evidence:
        return Evidence(self)

    def score(self, features: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -30, 30)))


class Evidence:
    """Compressors of a model and what they have found so far."""

    def __init__(self, model: ToxicModel):
        self.known: dict[str, float] = {}
        self.pairs = [(compressor(plain), compressor(toxic), carrier) for plain, toxic, carrier in model.pairs]

    def of(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            found = max(map(self._saved, window_bytes(word)))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = found
        return found

    def _saved(self, window: bytes) -> float:
        total = 0.0
        for plain, toxic, carrier in self.pairs:
            subject = window + carrier
            total += len(plain.compress(subject)) - len(toxic.compress(subject))
            if total < FIRST:
                return 0.0
        return total / len(self.pairs)

    def features(self, words: set[str]) -> list[float]:
        found = sorted(x for x in map(self.of, words) if x >= THRESHOLDS[0])
        return [float(np.log1p(len(found) - np.searchsorted(found, t))) for t in THRESHOLDS] + [max(found, default=0.0), float(np.log1p(len(words))), sum(found[-3:])]


def _trained(windows: list[bytes], size: int, seed: int) -> bytes:
    """The end of a dictionary that zstandard trains on the windows."""
    np.random.default_rng(seed).shuffle(windows)
    try:
        return zstandard.train_dictionary(size + 1000, windows, d=6, k=SEGMENT).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(windows)[-size:]


def dictionaries(ordinary: dict[str, int], toxic: dict[str, int], ordinary_least: float, toxic_least: float, base_size: int = 400_000, end_size: int = 8_000, costly: float = 5.0, most: int = 12_000_000) -> ToxicModel:
    """Dictionaries from how many texts of each class hold each word.

    base_size and end_size bound the dictionaries, most the bytes that the base is trained on (most frequent words first).
    """
    plain, size = [], 0
    for word, n in sorted(ordinary.items(), key=lambda x: (-x[1], x[0])):
        for w in window_bytes(word):
            plain += [w] * min(n, 5)
            size += len(w) * min(n, 5)
        if size > most:
            break
    bases = []
    for seed in range(PAIRS):
        base = _trained(list(plain), base_size, seed)
        bases.append((base, base[-48:]))
    opened = [(compressor(base + carrier), carrier) for base, carrier in bases]
    empty = sum(len(c.compress(carrier)) for c, carrier in opened)

    def hard(counts: dict[str, int], least: float) -> list[bytes]:
        out = []
        for word, n in sorted(counts.items()):
            if n >= least:
                for w in window_bytes(word):
                    if sum(len(c.compress(w + carrier)) for c, carrier in opened) - empty >= costly * PAIRS:
                        out += [w * -(-SEGMENT // len(w))] * n
        return out

    ends = hard(ordinary, ordinary_least), hard(toxic, toxic_least)
    pairs = []
    for seed, (base, carrier) in enumerate(bases):
        plain_end, toxic_end = (_trained(list(x), end_size, PAIRS + seed) if x else b"" for x in ends)
        n = max(len(plain_end), len(toxic_end))
        pairs.append(tuple(base + end.rjust(n, b" ")[-n:] + carrier if n else base + carrier for end in (plain_end, toxic_end)) + (carrier,))
    return ToxicModel(pairs)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, least_texts: int = 5, least_share: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel | float:
    """Fit on about max_rows labelled texts at most; labels of held-out ids (crc32 divisible by 5) are never seen."""
    chosen, counts = sample_labels(labels, "toxic", max_rows, id_col)
    if not counts:
        return 0.5
    spark = docs.sparkSession
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col(id_col).cast("long").alias("id"), "label", F.col(text_col).alias("text"))

    def words(batches):
        for batch in batches:
            for start, texts in slices(batch.column(2)):
                own = [sorted(windows_of(t)) for t in texts]
                keys = pa.array([xxhash.xxh3_64_intdigest(" ".join(w)) - (1 << 63) for w in own], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), keys, pa.array(own, pa.list_(pa.string()))], ["id", "label", "key", "words"])

    sample = materialise(rows.mapInArrow(words, "id long, label int, key long, words array<string>"), "toxic-sample")
    fold = F.pmod(F.xxhash64("key"), F.lit(FOLDS))  # copies are in one fold
    held = {(r["tune"], r["label"]): r["n"] for r in sample.groupBy((fold == 0).alias("tune"), "label").agg(F.count("*").alias("n")).collect()}
    every = {label: held.get((True, label), 0) + held.get((False, label), 0) for label in (0, 1)}
    if too_few(every):
        release(sample)
        if not any(every.values()):
            return 0.5
        raise ValueError(f"toxicity: at least {LEAST} learning texts of each class are needed: {every}")
    apart = all((t, label) in held for t in (True, False) for label in (0, 1))  # else so few texts do both
    learning = sample.where(fold != 0 if apart else F.lit(True)).dropDuplicates(["label", "key"])
    tuning = sample.where(fold == 0 if apart else F.lit(True))
    texts = {r["label"]: r["n"] for r in learning.groupBy("label").agg(F.count("*").alias("n")).collect()}
    least = [max(least_texts, least_share * texts[label]) for label in (0, 1)]
    words_ = learning.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    found = words_.where((F.col("n0") >= 2) | (F.col("n1") >= least[1])).toArrow().to_pydict()
    by = [{w: n for w, n in zip(found["word"], found[k], strict=True) if n >= low} for k, low in (("n0", 2), ("n1", least[1]))]
    model = dictionaries(by[0], by[1], least_texts, least[1])
    sent = spark.sparkContext.broadcast(model)

    def features(batches):
        evidence = sent.value.opened()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([evidence.features(set(w)) for w in batch.column(2).to_pylist()], pa.list_(pa.float64()))], ["id", "label", "x"])

    seen = sorted((r["label"], r["id"], r["x"]) for r in tuning.select("id", "label", "words").mapInArrow(features, "id long, label int, x array<double>").collect())
    release(sample)
    sent.destroy()
    y = np.array([r[0] for r in seen])
    weight = np.where(y == 1, counts[1] / max((y == 1).sum(), 1), counts[0] / max((y == 0).sum(), 1))
    model.weights = logistic(np.array([r[2] for r in seen]), y, weight * len(y) / weight.sum(), ridge=0.05).tolist()
    return model


def score_documents(docs: DataFrame, model: ToxicModel | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs; every text is read whole."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    if not isinstance(model, ToxicModel):
        return source.select(F.col("id").alias(id_col), F.lit(float(model)).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        evidence = sent.value.opened()
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                x = np.array([evidence.features(windows_of(t)) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(sent.value.score(x))], ["id", "score"])

    return source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicModel | float, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose score is below the threshold; all rows where there was nothing to learn from."""
    if not isinstance(model, ToxicModel):
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        evidence = sent.value.opened()
        for batch in batches:
            for start, texts in slices(batch.column(at)):
                x = np.array([evidence.features(windows_of(t)) for t in texts])
                yield batch.slice(start, len(texts)).filter(pa.array(sent.value.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
