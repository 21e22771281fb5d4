"""Exact nearest neighbours under a key, with pivots that keep most items from being compared.

Every key's items go to the nearest of the key's pivots (items of it, by the hash of their id; their number follows the number
of items).  A pivot's items, sorted by their distance from it, are cut into rings of RING items at most; a ring is one packed row.  By the
triangle inequality no item of a ring is nearer to a query than the query's distance from the pivot is off the ring's range of
distances, nor than half of what the pivot is farther off than the query's nearest pivot.  A query first asks its most promising
rings, until they hold enough items; the distance of its last result then bounds which other rings it asks.  Where vectors are
spread so evenly that nothing can be left out, all rings are asked, in blocks of rings and queries.

Of items of one vector only those that can be a result are kept: the n + 1 smallest ids, since a query leaves out one at most.

A key of no more items than a ring is joined plainly.  A common key is many rings, and its queries are many blocks of BLOCK at most; what asks
a ring is dealt over as many groups as it is blocks, so groups grow with the asks and not with rings times blocks.  No task holds all of a key's queries or items.

Defined cases: rows of a null key, id or vector, or whose vector holds a null or a number that is not finite, take no part; vectors
are compared with those of their length; a query's own item (equal id) is left out; distances are rounded to 6 digits and ties go to
smaller ids; queries are told apart by key and id; a query of an unknown key has no row; repeated items are results of their own; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.session import materialise

#: Items of a ring, queries of a block, and most pivots of a key.
RING, BLOCK, PIVOTS = 1_000, 4_096, 256
#: What a bound may be off by rounding.
SLACK = 2e-6


def _valid(df: DataFrame, key: str, id_col: str, vector: str) -> DataFrame:
    """(k, dim, id, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return df.select(F.col(key).alias("k"), F.size(v).alias("dim"), F.col(id_col).alias("id"), v.alias("v")).where(F.col("k").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a matrix."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).reshape(-1, dim) if parts else np.zeros((0, dim))


def _distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of every row from every other, from the differences themselves."""
    out = np.empty((len(rows), len(to)))
    for i, row in enumerate(rows):
        d = to - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def pivots_of(items: DataFrame, ring: int, most: int) -> DataFrame:
    """(k, dim, n, pivots): for every key its number of items and as many pivots as the root of its number of rings asks for."""
    ranked = items.withColumn("__r", F.row_number().over(Window.partitionBy("k", "dim").orderBy(F.xxhash64("id"), "id"))).where(F.col("__r") <= most)
    counts = items.groupBy("k", "dim").agg(F.count("*").alias("n"))
    chosen = ranked.groupBy("k", "dim").agg(F.array_sort(F.collect_list(F.struct("__r", "v"))).alias("a"))
    wanted = F.least(F.lit(most), F.ceil(F.col("n") / ring)).cast("int")
    return counts.join(chosen, ["k", "dim"]).select("k", "dim", "n", F.transform(F.slice("a", F.lit(1), wanted), lambda x: x["v"]).alias("pivots"))


def _assign(items: pa.Table, heads: pa.Table) -> pa.Table:
    """(k, dim, cell, off, id, v) of a block of items."""
    names = ["k", "dim", "cell", "off", "id", "v"]
    dim = items.column("dim")[0].as_py() if items.num_rows else 0
    if not items.num_rows or not heads.num_rows:
        return pa.table([items.column("k").slice(0, 0), items.column("dim").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64()), items.column("id").slice(0, 0), items.column("v").slice(0, 0)], names)
    pivots = np.array(heads.column("pivots")[0].as_py(), float).reshape(-1, dim)
    d = _distances(_rows(items.column("v"), dim), pivots)
    cell = d.argmin(axis=1)
    return pa.table([items.column("k"), items.column("dim"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), items.column("id"), items.column("v")], names)


def _pack(ring: int):
    """Rings of the sorted rows of a partition, one row each."""

    def run(batches):
        number, base = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held, size = [], 0

        def out(final):
            nonlocal held, size, number
            table = pa.Table.from_batches(held)
            cells = np.stack([table.column("cell").to_numpy(), table.column("dim").to_numpy()])
            keys = np.array(table.column("k").combine_chunks().dictionary_encode().indices)
            new = np.flatnonzero((keys[1:] != keys[:-1]) | (cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1
            cuts = [0]
            for end in [*new.tolist(), len(keys)]:
                while cuts[-1] < end:
                    cuts.append(min(end, cuts[-1] + ring))
            if not final and len(cuts) > 1:
                cuts.pop()  # the last ring may go on in the next batch
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(a, b - a).combine_chunks()
                first, off = part.slice(0, 1), part.column("off").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([base + number]), first.column("k").combine_chunks(), first.column("dim").combine_chunks(), first.column("cell").combine_chunks(), pa.array([off.min()]), pa.array([off.max()]), pa.array([b - a], pa.int64()), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), part.column("id").combine_chunks()), pa.array([_rows(part.column("v"), first.column("dim")[0].as_py()).tobytes()], pa.binary())], ["ring", "k", "dim", "cell", "low", "high", "n", "ids", "vectors"])
                number += 1
            rest = table.slice(cuts[-1])
            held, size = rest.to_batches(), rest.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= 4 * ring:
                    yield from out(False)
        if size:
            yield from out(True)

    return run


def index(corpus: DataFrame, key: str, id_col: str = "item_id", vector: str = "v", ring: int = RING, most: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(rings, heads): packed rings, and for every key its pivots and its number of items."""
    return _index(materialise(_valid(corpus, key, id_col, vector), "neighbour-items"), ring, most)


def _index(items: DataFrame, ring: int, most: int) -> tuple[DataFrame, DataFrame]:
    types = dict(items.dtypes)
    heads = materialise(pivots_of(items, ring, most), "neighbour-pivots")
    blocks = heads.select("k", "dim", F.ceil(F.col("n") / BLOCK).cast("int").alias("__b"))
    dealt = items.join(blocks, ["k", "dim"]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("__b")).cast("int")).drop("__b")
    spread = heads.select("k", "dim", "pivots", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)).alias("block"))
    by = ["k", "dim", "block"]
    assigned = dealt.groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(_assign, f"k {types['k']}, dim int, cell int, off double, id {types['id']}, v array<double>")
    placed = assigned.repartitionByRange("k", "dim", "cell", "off", "id").sortWithinPartitions("k", "dim", "cell", "off", "id")
    rings = placed.mapInArrow(_pack(ring), f"ring long, k {types['k']}, dim int, cell int, low double, high double, n long, ids array<{types['id']}>, vectors binary")
    return materialise(rings, "neighbour-rings"), heads


def _visits(n: int, second: bool):
    """The rings that each query of a block asks: first those of the least bounds that hold n items beside its own, then all others within reach."""

    def run(queries: pa.Table, tops: pa.Table) -> pa.Table:
        at, found = [], []
        if queries.num_rows and tops.num_rows:
            dim = queries.column("dim")[0].as_py()
            pivots = np.array(tops.filter(pc.is_null(tops.column("ring"))).column("pivots")[0].as_py(), float).reshape(-1, dim)
            rings = tops.filter(pc.is_valid(tops.column("ring"))).sort_by("ring")
            low, high, sizes, ids, cell = (rings.column(c).to_numpy() for c in ("low", "high", "n", "ring", "cell"))
            reach = queries.column("reach").to_numpy() if second else None
            d = _distances(_rows(queries.column("v"), dim), pivots)
            for i, (own, nearest_pivot) in enumerate(zip(d[:, cell] if len(d) * len(cell) < 4_000_000 else (x[cell] for x in d), d.min(axis=1), strict=True)):
                bound = np.maximum(np.maximum(low - own, own - high), np.maximum((own - nearest_pivot) / 2, 0.0))
                order = np.argpartition(bound, n + 1)[: n + 2] if len(bound) > n + 2 else np.arange(len(bound))  # rings hold an item at least
                order = order[np.lexsort((order, bound[order]))]
                asked = order[: int(np.searchsorted(np.cumsum(sizes[order]), n + 1)) + 1]
                if second:
                    asked = np.setdiff1d(np.flatnonzero(bound <= reach[i] + SLACK), asked, assume_unique=True)
                at += [i] * len(asked)
                found += ids[asked].tolist()
        own = queries.take(pa.array(at, pa.int64()))
        return pa.table([pa.array(found, pa.int64()), own.column("block"), own.column("k"), own.column("id"), own.column("v")], ["ring", "block", "k", "id", "v"])

    return run


def _compare(n: int):
    """The n nearest items of a ring for each query of a block."""

    def run(asked: pa.Table, ring: pa.Table) -> pa.Table:
        items = ring.column("ids").combine_chunks().flatten() if ring.num_rows else pa.array([], asked.column("id").type)
        at, found, far = [], [], []
        if asked.num_rows and ring.num_rows:
            dim = ring.column("dim")[0].as_py()
            vectors = np.frombuffer(ring.column("vectors")[0].as_py()).reshape(-1, dim) if dim else np.zeros((len(items), 0))
            rank = np.argsort(np.argsort(np.array(items.to_pylist(), object), kind="stable"))
            place = {}
            for j, x in enumerate(items.to_pylist()):
                place.setdefault(x, []).append(j)
            for i, (own, q) in enumerate(zip(asked.column("id").to_pylist(), _rows(asked.column("v"), dim), strict=True)):
                d = np.floor(_distances(q[None], vectors)[0] * 1e6 + 0.5) / 1e6
                d[place.get(own, [])] = np.inf
                near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1]) if len(d) > n else np.arange(len(d))
                near = near[np.lexsort((rank[near], d[near]))][:n]
                near = near[d[near] < np.inf]
                at += [i] * len(near)
                found += near.tolist()
                far += d[near].tolist()
        return pa.table([asked.column("k").take(pa.array(at, pa.int64())), asked.column("id").take(pa.array(at, pa.int64())), items.take(pa.array(found, pa.int64())), pa.array(far, pa.float64())], ["k", "query_id", "item_id", "d"])

    return run


def _dealt(visits: DataFrame) -> DataFrame:
    """visits with the block of each row among those that ask its ring, BLOCK rows each or about that."""
    parts = visits.groupBy("ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__b"))
    return visits.join(parts, "ring").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("__b")).cast("int")).drop("__b")


def _ask(visits: DataFrame, rings: DataFrame, n: int) -> DataFrame:
    visits = _dealt(materialise(visits, "neighbour-visits"))
    kinds = dict(visits.dtypes)
    blocks = visits.select(F.col("ring").alias("of"), F.col("block").alias("part")).distinct()  # other names than those of the side it is grouped with
    wanted = blocks.join(rings.select(F.col("ring").alias("of"), "dim", "ids", "vectors"), "of")
    item = dict(rings.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    return visits.groupBy("ring", "block").cogroup(wanted.groupBy("of", "part")).applyInArrow(_compare(n), f"k {kinds['k']}, query_id {kinds['id']}, item_id {item}, d double")


def visits(queries: DataFrame, rings: DataFrame, heads: DataFrame, n: int, second: bool = False) -> DataFrame:
    """(ring, block, k, id, v): which rings the prepared queries ask in the first or, if they have a reach, the second round."""
    kinds, own = dict(queries.dtypes), [F.col("k").alias("of"), F.col("dim").alias("size")]
    bounds = rings.select(*own, "dim", "ring", "cell", "low", "high", "n", F.lit(None).cast("array<array<double>>").alias("pivots"))
    tops = bounds.unionByName(heads.select(*own, "pivots"), allowMissingColumns=True)
    dealt = tops.join(queries.select(*own, F.col("block").alias("part")).distinct(), ["of", "size"])
    return queries.groupBy("k", "dim", "block").cogroup(dealt.groupBy("of", "size", "part")).applyInArrow(_visits(n, second), f"ring long, block int, k {kinds['k']}, id {kinds['id']}, v array<double>")


def prepared(queries: DataFrame, key: str, id_col: str = "query_id", vector: str = "q") -> DataFrame:
    """(k, dim, id, v, block): queries that take part, each once, in blocks of their key."""
    rows = _valid(queries, key, id_col, vector).distinct()
    counts = rows.groupBy("k", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__b"))
    return rows.join(counts, ["k", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("__b")).cast("int")).drop("__b")


def _possible(items: DataFrame, n: int) -> DataFrame:
    """Items without those that n + 1 others of their vector and of smaller ids keep from being a result; of repeats n are enough."""
    of = ["k", "dim", "v"]
    few = items.withColumn("__d", F.dense_rank().over(Window.partitionBy(*of).orderBy("id"))).where(F.col("__d") <= n + 1).drop("__d")
    return few.withColumn("__r", F.row_number().over(Window.partitionBy(*of, "id").orderBy("id"))).where(F.col("__r") <= n).drop("__r")


def nearest(queries: DataFrame, corpus: DataFrame, key: str, n: int, ring: int = RING, most: int = PIVOTS) -> DataFrame:
    """(key, query_id, item_id, d, rank): the n nearest items of the same key; queries: (key, query_id, q), corpus: (key, item_id, v)."""
    items = materialise(_possible(_valid(corpus, key, "item_id", "v"), n), "neighbour-items")
    asked = materialise(prepared(queries, key), "neighbour-queries")
    large = items.groupBy("k", "dim").agg(F.count("*").alias("n")).where(F.col("n") > ring).select("k", "dim")
    best = Window.partitionBy("k", "query_id").orderBy("d", "item_id")
    if large.limit(1).count():
        both = _few(asked, items.join(large, ["k", "dim"], "left_anti")).unionAll(_many(asked.join(large, ["k", "dim"], "left_semi"), items.join(large, ["k", "dim"], "left_semi"), n, ring, most, best))
    else:
        both = _few(asked, items)
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(F.col("k").alias(key), "query_id", "item_id", "d", "rank")


def _few(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Distances of keys that would be one ring: a query meets no more items than that, so a plain join does."""
    d = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = asked.select("k", "dim", F.col("id").alias("query_id"), F.col("v").alias("q")).join(items.select("k", "dim", F.col("id").alias("item_id"), "v"), ["k", "dim"])
    return pairs.where("query_id <> item_id").select("k", "query_id", "item_id", F.round(d, 6).alias("d"))


def _many(asked: DataFrame, items: DataFrame, n: int, ring: int, most: int, best) -> DataFrame:
    """Candidates of keys of many rings, in two rounds."""
    rings, heads = _index(items, ring, most)
    first = materialise(_ask(visits(asked, rings, heads, n), rings, n), "neighbour-first")
    reach = first.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= n).groupBy("k", "query_id").agg(F.max("d").alias("d"), F.count("*").alias("c"))
    reach = reach.select("k", F.col("query_id").alias("id"), F.when(F.col("c") >= n, F.col("d")).otherwise(float("inf")).alias("reach"))
    wider = asked.join(reach, ["k", "id"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))).select("k", "dim", "id", "v", "block", "reach")
    return first.unionAll(_ask(visits(wider, rings, heads, n, True), rings, n))
