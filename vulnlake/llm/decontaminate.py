"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 32 words, 16 apart, over whole texts.  Their TF-IDF vectors are over the benchmark's words
(document frequencies are counted over all texts).  A randomised SVD gives the latent space: every task multiplies its
passages' matrix A with a random test matrix O and back, the sums Y = A'(A O) are added up across tasks, and the small
factorisation of Y and O'Y (no second pass over the texts) gives the leading singular values and right singular vectors,
of which `rank` are kept.  The space is fitted on all passages of all texts and on all items; all passages are then
projected and compared with all items, in blocks of items.

A passage whose cosine with an item reaches `cosine` (less for items of fewer than 15 words, which fill less of a window), and which reaches far enough along the item's direction to hold
about half of it (`reach`), is a candidate.  Around a candidate the item must be found again:
its longest common subsequence with that stretch of the text covers `whole` of its words, or `part` of them and also its
answer (the last quarter of its words, of which two thirds must be in the stretch).

Items of fewer than `short` words fill too little of a passage for its direction to tell.  They are also looked up by pairs of
their words that stand up to GAPS places apart: two such pairs, about equally far into the item, make a candidate.

Items that occur word for word are also looked up directly, by the hash of their first words (HEAD at most), whatever their
cosine.  Items of fewer than `least` words say too little for anything else; items without words are left out.  The rank
grows with the square root of the number of items.

Defined cases: null and empty texts have no passages and are never contaminated; a text shorter than a window is one
passage; ties and repeated rows are judged alike; an empty benchmark finds nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import slices

WINDOW, STRIDE = 32, 16
#: Bytes that separate words: ASCII white space and punctuation; A-Z are lower-cased.
_TABLE = bytes(32 if (b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128) else b + 32 if 65 <= b < 91 else b for b in range(256))
#: Items compared with a batch of passages at a time.
ITEM_BLOCK = 2048
#: First words of an item by which it is looked up, and what their hash is made of.
HEAD = 8
#: How far apart the words of a pair stand at most, and how far two pairs of a candidate may be shifted against each other.
GAPS, SHIFT = 3, 8
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_in(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


@dataclass
class Space:
    """Benchmark items, their vocabulary and the latent space.  Its size is that of the benchmark, not of the corpus."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int, list[int]]]  # item id, word numbers
    basis: np.ndarray = None  # (words + 1) x rank, idf included; the last row, of unknown words, is 0
    latent: np.ndarray = None  # items x rank, unit length
    singular: np.ndarray = None  # singular values, largest first
    masks: list[dict[int, int]] = field(default_factory=list)
    lengths: np.ndarray = None  # how far along an item's direction a passage has to reach
    cosines: np.ndarray = None  # and how near it
    heads: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = field(default_factory=dict)  # by their number of words: sorted hashes, items of a hash
    pairs: list[tuple[np.ndarray, ...]] = field(default_factory=list)  # by gap: sorted pairs of words, where their items begin, items, places
    cosine: float = 0.5
    reach: float = 0.5
    whole: float = 0.8
    part: float = 0.6
    least: int = 5
    short: int = 15

    def index_pairs(self) -> None:
        """File the pairs of words of short items."""
        size = len(self.vocabulary)
        for gap in range(1, GAPS + 1):
            rows = sorted((words[i] * size + words[i + gap], at, i) for at, (_, words) in enumerate(self.items) if self.least <= len(words) < self.short for i in range(len(words) - gap))
            codes, first = np.unique(np.array([r[0] for r in rows], np.int64), return_index=True)
            self.pairs.append((codes, np.append(first, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)))

    def paired(self, owns: list[np.ndarray]) -> set[tuple[int, int, int]]:
        """(text, item, window) of short items of which two pairs of words stand close together."""
        if not any(len(codes) for codes, *_ in self.pairs):
            return set()
        size = len(self.vocabulary)
        far = np.full(GAPS, size, np.int32)  # stands in no pair
        flat = np.concatenate([x for own in owns for x in (own, far)]).astype(np.int64)
        begins = np.cumsum([0] + [len(own) + GAPS for own in owns])
        found = []
        for gap, (codes, first, items, places) in enumerate(self.pairs, 1):
            known = np.flatnonzero((flat[:-gap] < size) & (flat[gap:] < size))
            code = flat[known] * size + flat[known + gap]
            slot = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = codes[slot] == code if len(codes) else np.zeros(len(code), bool)
            known, slot = known[hit], slot[hit]
            many = first[slot + 1] - first[slot]
            entry = np.repeat(first[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at = np.repeat(known, many)
            found.append((items[entry], at - places[entry], at))
        item, start, at = (np.concatenate(x) for x in zip(*found, strict=True))
        out = set()
        for shift in (0, SHIFT // 2):  # either grid has close starts in one cell
            cell = np.stack([item, (start + GAPS * SHIFT + shift) // SHIFT])
            order = np.lexsort(cell)
            same = (cell[:, order[1:]] == cell[:, order[:-1]]).all(axis=0)
            for i in order[1:][same].tolist():
                text = int(np.searchsorted(begins, at[i], "right")) - 1
                out.add((text, int(item[i]), max(int(start[i] - begins[text]), 0) // STRIDE))
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_in(text)
        return np.fromiter(map(self.vocabulary.get, words, [len(self.vocabulary)] * len(words)), np.int32, len(words))

    def project(self, own: np.ndarray) -> np.ndarray:
        """Latent vectors of a text's windows."""
        rows = self.basis[own]
        if len(own) <= WINDOW:
            out = rows.sum(axis=0, keepdims=True)
        else:
            half = np.add.reduceat(rows, np.arange(0, len(own), STRIDE), axis=0)
            out = half[:-1] + half[1:]
        return out

    def confirm(self, at: int, own: np.ndarray, window: int) -> float:
        """Share of the item's words in the longest common subsequence near a window; 0 if the checks fail."""
        words = self.items[at][1]
        m = len(words)
        lo, hi = max(0, window * STRIDE - m), min(len(own), window * STRIDE + WINDOW + m)
        near = own[lo:hi].tolist()
        mask = self.masks[at]
        known = [mask[w] for w in near if w in mask]
        if len(known) < self.part * m:
            return 0.0
        full = (1 << m) - 1
        v = full
        for bits in known:  # one bit per word of the item; a zero marks a step of the common subsequence
            u = v & bits
            v = ((v + u) | (v - u)) & full
        share = (m - v.bit_count()) / m
        if share >= self.whole:
            return share
        if share >= self.part:
            answer, there = words[-max(1, m // 4) :], set(near)
            if 3 * sum(w in there for w in answer) >= 2 * len(answer):
                return share
        return 0.0

    def verbatim(self, owns: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, item) of all items that occur word for word."""
        out: set[tuple[int, int]] = set()
        gap = np.array([len(self.vocabulary)], np.int32)  # stands in no item
        flat = np.concatenate([x for own in owns for x in (own, gap)])
        ends = np.cumsum([len(own) + 1 for own in owns])
        for size, code in _codes(flat, max(self.heads, default=0)):
            if size not in self.heads:
                continue
            hashes, items = self.heads[size]
            at = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, code), len(hashes) - 1)] == code)
            for place, text, key in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist(), code[at].tolist(), strict=True):
                for item in items[key]:
                    words = self.items[item][1]
                    if (text, item) not in out and flat[place : place + len(words)].tolist() == words:
                        out.add((text, item))
        return out

    def matches(self, owns: list[np.ndarray]) -> list[list[tuple[int, float]]]:
        """For each text the items found in it, with the share of words found."""
        out: list[list[tuple[int, float]]] = [[] for _ in owns]
        full = [i for i, own in enumerate(owns) if len(own)]
        if not full or not self.items:
            return out
        parts = [self.project(owns[i]) for i in full]
        text = np.repeat(full, [len(p) for p in parts])
        window = np.concatenate([np.arange(len(p)) for p in parts])
        latent = np.concatenate(parts)
        length = np.maximum(np.sqrt((latent * latent).sum(axis=1, keepdims=True)), 1e-9)
        best: dict[tuple[int, int], float] = dict.fromkeys(self.verbatim(owns), 1.0)
        for i, at, window_at in self.paired(owns):
            if best.get((i, at), 0.0) < 1.0 and len(owns[i]):
                share = self.confirm(at, owns[i], window_at)
                if share > best.get((i, at), 0.0):
                    best[i, at] = share
        for start in range(0, len(self.items), ITEM_BLOCK):
            near = latent @ self.latent[start : start + ITEM_BLOCK].T  # the passage along the item's direction
            enough = (near >= self.cosines[start : start + ITEM_BLOCK] * length) & (near >= self.lengths[start : start + ITEM_BLOCK])
            for row, col in np.argwhere(enough).tolist():
                key = (int(text[row]), start + col)
                if best.get(key, 0.0) < 1.0:
                    share = self.confirm(start + col, owns[key[0]], int(window[row]))
                    if share > best.get(key, 0.0):
                        best[key] = share
        for (i, at), share in sorted(best.items()):
            out[i].append((self.items[at][0], share))
        return out


def _codes(flat: np.ndarray, most: int):
    """(n, hash of the n words from each place on) for n up to most."""
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    code, power = np.zeros(len(flat) + 1, np.uint64), np.uint64(1)
    for n in range(1, min(most, len(flat)) + 1):
        code = code[:-1] + mixed[n - 1 :] * power
        power = np.uint64(int(power) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
        yield n, code


def _read_benchmark(benchmark: DataFrame, id_col: str, text_col: str) -> Space:
    """The stated query set; it is held by the driver and every worker."""
    vocabulary: dict[bytes, int] = {}
    items = []
    for r in sorted(benchmark.select(F.col(id_col).cast("long"), text_col).where(F.col(text_col).isNotNull()).distinct().collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        words = [vocabulary.setdefault(w, len(vocabulary)) for w in words_in(r[1])]
        if words:
            items.append((r[0], words))
    space = Space(vocabulary, items)
    for _, words in items:
        mask: dict[int, int] = {}
        for i, w in enumerate(words):
            mask[w] = mask.get(w, 0) | 1 << i
        space.masks.append(mask)
    by: dict[int, dict[int, list[int]]] = {}
    for at, (_, words) in enumerate(items):
        n, code = list(_codes(np.array(words[:HEAD], np.int32), HEAD))[-1]
        by.setdefault(n, {}).setdefault(int(code[0]), []).append(at)
    space.heads = {n: (np.array(sorted(x), np.uint64), x) for n, x in by.items()}
    space.index_pairs()
    return space


def _add_range(total: np.ndarray, owns: list[np.ndarray], scale: np.ndarray, weighted: np.ndarray) -> None:
    """Add A'(A O) of the texts' passages, each of unit length, to total; weighted is the test matrix O times scale."""
    own = np.concatenate(owns) if owns else np.empty(0, np.int32)
    if not len(own):
        return
    size = np.array([len(x) for x in owns])
    halves = -(-size // STRIDE)
    first = np.cumsum(halves) - halves
    half = np.repeat(first, size) + (np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)) // STRIDE
    n = int(halves.sum())
    last = np.zeros(n, bool)
    last[(first + halves - 1)[halves > 0]] = True
    begins = np.zeros(n, bool)
    begins[first[halves > 0]] = True
    window = ~last | begins  # a window begins at each half but the last, unless that is all of the text
    known = scale[own] > 0
    own, half = own[known], half[known]
    if not len(own):
        return
    # squared lengths: a word counts as often as it stands in both halves of a window
    v, two = len(scale), window[half - 1] & ~begins[half]
    inside = window[half]
    key, tf = np.unique(np.concatenate([half[inside], half[two] - 1]) * v + np.concatenate([own[inside], own[two]]), return_counts=True)
    unit = np.bincount(key // v, (tf * scale[key % v]) ** 2, n)
    cuts = np.flatnonzero(np.diff(half, prepend=-1))
    sums = np.zeros((n, weighted.shape[1]), np.float32)
    sums[half[cuts]] = np.add.reduceat(weighted[own], cuts, axis=0)
    along = sums.copy()
    along[:-1][~last[:-1]] += sums[1:][~last[:-1]]
    along *= np.where(window & (unit > 0), 1 / np.maximum(unit, 1e-30), 0)[:, None].astype(np.float32)
    back = along.copy()
    back[1:][~begins[1:]] += along[:-1][~begins[1:]]
    turn = np.argsort(own, kind="stable")
    own, half = own[turn], half[turn]
    cuts = np.flatnonzero(np.diff(own, prepend=-1))
    total[own[cuts]] += scale[own[cuts], None] * np.add.reduceat(back[half], cuts, axis=0)


#: Columns of the test matrix besides the rank, which make the leading vectors more exact.
OVERSAMPLE = 8


def leading(y: np.ndarray, test: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right singular vectors of A from y = A'A O and the test matrix O.

    Nystrom's approximation of A'A, y (O'y)^-1 y', factored; a small shift keeps the inverse stable.
    """
    shift = 1e-7 * max(np.linalg.norm(y), 1e-30)
    y = y + shift * test
    small = test.T @ y
    value, vector = np.linalg.eigh((small + small.T) / 2)
    kept = value > 1e-10 * max(value.max(initial=0.0), 1e-30)
    half = y @ (vector[:, kept] / np.sqrt(value[kept]))
    left, size, _ = np.linalg.svd(half, full_matrices=False)
    size = np.sqrt(np.maximum(size**2 - shift, 0))
    rank = min(rank, int((size > 1e-6 * max(size.max(initial=0.0), 1e-30)).sum()))
    return size[:rank], left[:, :rank]


def fit_space(docs: DataFrame, benchmark: DataFrame, rank: int = 64, text_col: str = "text", item_col: str = "item_id") -> Space:
    """The latent space for one corpus and benchmark."""
    spark = docs.sparkSession
    space = _read_benchmark(benchmark, item_col, "text")
    if not space.items:
        return space
    v = len(space.vocabulary)
    sent = spark.sparkContext.broadcast(space)
    texts = docs.select(F.col(text_col).alias("text"))

    def frequencies(batches):
        seen, rows = np.zeros(v + 1, np.int64), 0
        for batch in batches:
            for _, part in slices(batch.column(0)):
                for text in part:
                    seen[np.unique(sent.value.numbers(text))] += 1
                rows += len(part)
        at = np.flatnonzero(seen[:v])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, v)), pa.array(np.append(seen[at], rows))], ["w", "n"])

    df = np.zeros(v + 1)
    for w, n in texts.mapInArrow(frequencies, "w long, n long").groupBy("w").agg(F.sum("n")).collect():
        df[w] = n
    idf = np.log((df[v] + 1) / (df[:v] + 1)) + 0.1
    rank = min(max(rank, int(4 * np.sqrt(len(space.items)))), v, len(space.items))
    columns = min(rank + OVERSAMPLE, v)
    test = np.random.default_rng(7).standard_normal((v + 1, columns)).astype(np.float32)
    scale = np.append(idf, 0.0).astype(np.float32)
    shared = spark.sparkContext.broadcast((scale, test))
    def ranges(batches):
        scale, test = shared.value
        weighted = scale[:, None] * test
        total = np.zeros(test.shape)
        for batch in batches:
            for _, part in slices(batch.column(0), max(20_000, 16_000_000 // columns)):
                _add_range(total, [sent.value.numbers(t) for t in part], scale, weighted)
        at = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].tolist(), pa.list_(pa.float64()))], ["w", "y"])

    summed = texts.mapInArrow(ranges, "w long, y array<double>").select("w", *[F.col("y")[i].alias(f"y{i}") for i in range(columns)]).groupBy("w").agg(*[F.sum(f"y{i}").alias(f"y{i}") for i in range(columns)])
    y = np.zeros((v, columns))
    for row in summed.collect():  # at most one row a word of the benchmark
        y[row[0]] = row[1:]
    # the items are passages too, so the basis spans them even where no text has their words
    own = np.zeros((v, columns))
    for _, words in space.items:
        w, tf = np.unique(words, return_counts=True)
        a = tf * idf[w]
        own[w] += a[:, None] * (a @ test[w] / (a @ a))
    y = y / max(np.linalg.norm(y), 1e-9) + own / max(np.linalg.norm(own), 1e-9)
    space.singular, basis = leading(y, test[:v].astype(np.float64), rank)
    space.basis = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
    latent = np.array([space.basis[words].sum(axis=0) for _, words in space.items])
    length = np.linalg.norm(latent, axis=1)
    space.latent = (latent / np.maximum(length[:, None], 1e-9)).astype(np.float32)
    size = np.array([len(words) for _, words in space.items])
    # an item's share of a window's length grows with the root of its number of words
    space.cosines = (space.cosine * np.minimum(1.0, np.sqrt(size / 15))).astype(np.float32)
    # of an item longer than a window, some window holds at least the words that a stride leaves
    space.lengths = (space.reach * length * np.minimum(1.0, 0.75 * WINDOW / size)).astype(np.float32)
    space.lengths[size < space.least] = np.inf  # they are looked up only
    return space


def find_leaks(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, share): one row for each item found in a row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        own = sent.value
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                found = own.matches([own.numbers(t) for t in texts])
                at = [i for i, f in enumerate(found) for _ in f]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)).take(pa.array(at, pa.int64())), pa.array([x for f in found for x, _ in f], pa.int64()), pa.array([s for f in found for _, s in f], pa.float64())], ["id", "item_id", "share"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, item_id long, share double").withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, space: Space, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, in which no item is found."""
    sent = docs.sparkSession.sparkContext.broadcast(space)
    at = docs.columns.index(text_col)

    def run(batches):
        own = sent.value
        for batch in batches:
            for start, texts in slices(batch.column(at)):
                found = own.matches([own.numbers(t) for t in texts])
                yield batch.slice(start, len(texts)).filter(pa.array([not f for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
