"""Ranked lexical search over inverted treaps.

A pass over the documents keeps, for the terms that the items hold, every document's term frequencies, and gives the statistics
of the ranking (over all documents).  A search task then takes blocks of documents.  In a block each term's postings are a treap: a
search tree by document, a heap by impact, so that a subtree's root bounds everything below it; equal impacts are ordered by
a hash of the document, which keeps the trees shallow among copies.  An item walks the treaps of its terms at once: a range of documents is
dropped when the summed weighted maxima of its subtrees cannot enter the item's best k; else the document of the largest one is
scored, and the range is split there.  The ranges of one depth are walked together, as arrays.  A task carries the k-th best scores of its
items from block to block; the blocks' best k of each item are merged by a window with a limit.

Items are the stated query set: they are taken in blocks of about ITEM_BYTES, each of which goes to the tasks by broadcast and
asks all documents.

Defined cases: null, empty and termless documents count nowhere; a null id ranks after all others of its score; repeated documents
are ranked each; equal items (id and text) count once, and equal ids of different texts are ranked each; an item without terms,
or without a document above 0, has no row; empty tables give an empty result; further columns are ignored; texts of any
length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import lower_ascii, materialise, slices

#: Fixed value: letters and digits of ASCII and everything beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Text of the items of one block.
ITEM_BYTES = 4_000_000
#: A block of documents: this many, or this many postings.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 4_000_000
#: Cells (ranges x terms) that are walked together.
CELLS = 2_000_000
LONG_TEXT, BATCH = 2_000_000, 100_000


def terms_of(text: str | None) -> Counter:
    """Frequencies of a text's terms."""
    lowered = lower_ascii(text) if text else ""
    if len(lowered) < LONG_TEXT:
        return Counter(TERM.findall(lowered))
    found = Counter()
    for part in batched((m.group() for m in TERM.finditer(lowered)), BATCH):
        found.update(part)
    return found


def impact(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The part of a score that a term's frequency gives in a document of n terms; docs and length: of all documents."""
    m = 25 + (75 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Treaps:
    """The treaps of a block: postings sorted by term and document; node 0 is the empty tree."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((doc, term))
        term, doc, impacts = term[order], doc[order], impacts[order]
        n = len(term)
        self.doc, self.impact = np.append(-1, doc), np.append(0, impacts)
        # position i of the postings is node i + 1; a term's first and last node are bounded by positions of another term
        mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        rank = (impacts << 20) | mixed.astype(np.int64)
        rank = np.concatenate(([np.iinfo(np.int64).max], rank, [np.iinfo(np.int64).max]))
        own = np.concatenate(([-1], term, [-1]))
        at = np.arange(1, n + 1)
        # nearest greater neighbours; the left one of two equals is the greater
        before = self._nearest(at, -1, rank, own, lambda other, mine: other < mine)
        after = self._nearest(at, 1, rank, own, lambda other, mine: other <= mine)
        out_left, out_right = own[before] != own[at], own[after] != own[at]
        to_right = ~out_right & (out_left | (rank[after] <= rank[before]))
        to_left = ~out_left & ~to_right
        self.left, self.right = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.left[after[to_right]] = at[to_right]
        self.right[before[to_left]] = at[to_left]
        roots = at[out_left & out_right]
        self.roots = dict(zip(own[roots].tolist(), roots.tolist(), strict=True))

    @staticmethod
    def _nearest(at, step, rank, own, below):
        """For every position the nearest one on a side that isn't below it, or lies in another term; found by jumping over what neighbours have found."""
        found = np.concatenate(([0], at + step, [len(at) + 1]))
        active = at
        while len(active):
            to = found[active]
            active = active[(own[to] == own[active]) & below(rank[to], rank[active])]
            found[active] = found[found[active]]
        return found[at]

    def settle(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest node of each subtree that lies in [low, high)."""
        node = node.copy()
        active = np.flatnonzero(node)
        while len(active):
            x = node[active]
            d = self.doc[x]
            under, over = d < low[active], d >= high[active]
            x = np.where(under, self.right[x], self.left[x])
            moved = under | over
            active, x = active[moved], x[moved]
            node[active] = x
            active = active[x > 0]
        return node

    def search(self, terms: np.ndarray, weights: np.ndarray, docs: int, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of the k best of a list of terms, ties to smaller documents, none under `least`; and how many were scored."""
        have = [i for i, t in enumerate(terms.tolist()) if t in self.roots and weights[i] > 0]
        top_doc, top_score, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not have:
            return top_doc, top_score, seen
        weights = weights[have]
        width, cap = len(have), max(1, CELLS // len(have))
        stack = [(np.array([[self.roots[t] for t in terms[have].tolist()]]), np.zeros(1, np.int64), np.full(1, docs))]
        while stack:
            nodes, low, high = stack.pop()
            parts = self.impact[nodes] * weights
            bound = parts.sum(axis=1)
            keep = bound >= max(least, 1)
            if len(top_doc) == k:
                keep &= (bound > top_score[-1]) | ((bound == top_score[-1]) & (low < top_doc[-1]))
            nodes, low, high, parts, bound = (x[keep] for x in (nodes, low, high, parts, bound))
            if not len(nodes):
                continue
            pivot = self.doc[nodes[np.arange(len(nodes)), parts.argmax(axis=1)]]
            flat, at = nodes.ravel(), np.repeat(pivot, width)
            hit = self.settle(flat, at, at + 1).reshape(nodes.shape)
            score = (self.impact[hit] * weights).sum(axis=1)
            seen += len(score)
            top_doc, top_score = np.append(top_doc, pivot), np.append(top_score, score)
            best = np.lexsort((top_doc, -top_score))[:k]
            top_doc, top_score = top_doc[best], top_score[best]
            if len(top_doc) == k:
                least = max(least, int(top_score[-1]))
            lows, highs = np.concatenate((low, pivot + 1)), np.concatenate((pivot, high))
            both = self.settle(np.concatenate((flat, flat)), np.repeat(lows, width), np.repeat(highs, width)).reshape(-1, width)
            some = both.any(axis=1)
            both, lows, highs = both[some], lows[some], highs[some]
            bound = (self.impact[both] * weights).sum(axis=1)
            order = np.argsort(bound, kind="stable")  # the most promising ranges on top of the stack
            for part in np.array_split(order, max(1, -(-len(order) // cap))):
                if len(part):
                    stack.append((both[part], lows[part], highs[part]))
        good = top_score > 0
        return top_doc[good], top_score[good], seen


def term_rows(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of every document with a term; of terms only those that are shared."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches):
        known = shared.value
        for batch in batches:
            for start, texts in slices(batch.column("text")):
                at, n, terms, tfs = [], [], [], []
                for i, text in enumerate(texts):
                    if found := terms_of(text):
                        own = [(known[t], c) for t, c in found.items() if t in known]
                        at.append(start + i)
                        n.append(found.total())
                        terms.append([t for t, _ in own])
                        tfs.append([c for _, c in own])
                ids = batch.column("id").take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"])

    return source.mapInArrow(run, f"id {dict(source.dtypes)['id']}, n long, terms array<int>, tfs array<long>")


def frequencies(rows: DataFrame) -> dict[int, int]:
    """Documents that hold each of the shared terms."""

    def run(batches):
        total = Counter()
        for batch in batches:
            terms, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            total.update(dict(zip(terms.tolist(), counts.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["term", "df"])

    return {r["term"]: r["df"] for r in rows.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _search_blocks(shared, docs: int, length: int, k: int):
    """The best k of every item in every block of a task's documents."""
    names = ["item", "id", "score", "scored"]

    def block(items, best, batches):
        ids = pa.concat_arrays([b.column("id") for b in batches])
        n = np.concatenate([b.column("n").to_numpy() for b in batches])
        sizes = np.concatenate([pc.list_value_length(b.column("terms")).to_numpy() for b in batches])
        term = np.concatenate([b.column("terms").flatten().to_numpy() for b in batches])
        tf = np.concatenate([b.column("tfs").flatten().to_numpy() for b in batches])
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = np.repeat(np.arange(len(n)), sizes)
        treaps = Treaps(term.astype(np.int64), place[row], impact(tf, n[row], docs, length))
        ids = ids.take(pa.array(order))
        for i, (terms, weights) in enumerate(items):
            held = best.setdefault(i, np.zeros(0, np.int64))
            doc, score, scored = treaps.search(terms, weights, len(n), k, int(held[-1]) if len(held) == k else 1)
            best[i] = np.sort(np.append(held, score))[::-1][:k]
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), i), pa.int32()), ids.take(pa.array(doc)), pa.array(score), pa.array(np.full(len(doc), scored), pa.int64())], names)

    def run(batches):
        items, best, held, size, postings = shared.value, {}, [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if size >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield from block(items, best, held)
                held, size, postings = [], 0, 0
        if size:
            yield from block(items, best, held)

    return run


def _rank_block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str, item_type) -> DataFrame:
    spark = docs.sparkSession
    counted = [terms_of(text) for _, text in items]
    known = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    rows = materialise(term_rows(docs, spark.sparkContext.broadcast(known), id_col, text_col), "term-rows")
    total = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = frequencies(rows)
    w = {t: weight(df[i], total["docs"]) for t, i in known.items() if i in df}
    asked = [(np.array([known[t] for t in c if t in w], np.int64), np.array([w[t] * q for t, q in c.items() if t in w], np.int64)) for c in counted]
    id_type = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(_search_blocks(spark.sparkContext.broadcast(asked), total["docs"], total["length"], k), f"item int, id {id_type}, score long, scored long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.select("item", "id", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], f"item int, item_id {item_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias(id_col), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, id, score): the k best documents of every item (item_id, text), best first, ties to smaller ids."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    item_type = dict(items.dtypes)["item_id"]
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 100), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-size // item_bytes)
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    out = None
    for b in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.where(of == b).distinct().collect()]
        part = _rank_block(docs, own, k, id_col, text_col, item_type) if own else None
        out = part if out is None else out if part is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], f"item_id {item_type}, rank int, {id_col} {dict(docs.dtypes)[id_col]}, score long")
    return out
