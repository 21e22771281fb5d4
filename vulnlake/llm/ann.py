"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are lifted so that the largest inner product is the smallest distance: x becomes (x / M, sqrt(1 - |x|^2 / M^2)) with
M the largest norm, a query becomes (q / |q|, 0).  A table hashes with m Gaussian projections, each cut into cells of width
w.  Besides its own bucket a query visits those whose cells differ a little, in the order of their estimated success: the
squared distances from its projections to the cells that are entered instead, summed, smallest first.  Candidates from all
tables are ranked by the exact inner product, in double precision, of the original vectors.

The number of projections grows with the logarithm of the number of vectors, so that buckets keep their size.  The number
of probes is fitted: on a bounded sample, the true neighbours' buckets have to come early enough in the queries' order
that the share `recall` of them is found in some table.  Where more than PROBES of them would be needed, fewer projections
are used instead, down to none, which compares everything; so the share is reached at every number of vectors.  All vectors
are indexed, and all queries use that number.  A query that then holds fewer than k is asked again in all buckets of a table.

Buckets stand on shelves by their hash, about BLOCK vectors to a shelf; a query goes once to each shelf that holds a bucket it
visits, and only vectors of those buckets are its candidates.  Larger shelves have several blocks, and the queries go to
each.  A task holds one block of vectors and streams its queries past it, so neither side has to fit in memory.  A block answers with each query's best k at most, and only those
that reach a floor: the k-th best score among the vectors of a bounded sample that stand in buckets the query visits, so at
least k that it finds reach it.  Of equal vectors, the k + 1 smallest ids can be in a result, and only they are indexed;
how many equal vectors there are does not matter.

Defined cases: vectors that are null, zero, of another length than the most common one, or that hold null or non-finite
components take no part, nor do rows without an id; rows that are repeated count once; ties go to the smaller id; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import materialise, release

BLOCK = 4096
PROBES = 8192  # buckets of a table that a query visits at most; with more projections than that allows, recall would be lost
REACH = 2  # cells to either side that a probe may move in one projection


@dataclass
class Index:
    """Projections of all tables: (tables, m, dims + 1), offsets (tables, m), cell width, largest norm, probes, floor sample."""

    lines: np.ndarray
    offsets: np.ndarray
    width: float
    largest: float
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_codes: np.ndarray  # their buckets, one column a table

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of cells: (rows, tables, m)."""
        norm = np.linalg.norm(x, axis=1)
        if query:
            lifted = np.column_stack([x / norm[:, None], np.zeros(len(x))])
        else:
            share = norm / self.largest
            lifted = np.column_stack([x / self.largest, np.sqrt(np.maximum(0, 1 - share * share))])
        return np.einsum("nd,tmd->ntm", lifted, self.lines) / self.width + self.offsets

    def costs(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of one table for one query, and what it costs to move REACH cells down to REACH up in each projection."""
        cell = np.floor(place).astype(np.int64)
        inside = (place - cell)[:, None]
        move = np.arange(-REACH, REACH + 1)[None, :]
        return cell, np.where(move < 0, inside - move - 1, np.where(move > 0, move - inside, 0.0)) ** 2

    def probe(self, place: np.ndarray, most: int) -> np.ndarray:
        """Codes of one table's buckets for one query's projections, in the order of their estimated success."""
        cell, cost = self.costs(place)
        m, span = cost.shape
        if m == 0:
            return code_of(np.zeros((1, 0), np.int64))
        if span**m <= 100_000:  # all perturbations at once
            total = cost[0]
            for row in cost[1:]:
                total = (total[:, None] + row[None, :]).ravel()
            order = np.argsort(total, kind="stable")[:most]
            moves = np.stack(np.unravel_index(order, (span,) * m), axis=1) - REACH
            return code_of(cell + moves)
        moves = sorted((float(cost[i, d + REACH]), i, d) for i in range(m) for d in range(-REACH, REACH + 1) if d)
        out, heap = [cell], [(moves[0][0], (0,))]
        while heap and len(out) < most:
            sum_, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if last + 1 < len(moves):  # the next larger perturbations: one more move, or the last one exchanged
                step = moves[last + 1][0]
                heapq.heappush(heap, (sum_ - moves[last][0] + step, (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (sum_ + step, (*chosen, last + 1)))
            axes = [moves[i][1] for i in chosen]
            if len(set(axes)) == len(axes):
                moved = cell.copy()
                for i in chosen:
                    moved[moves[i][1]] += moves[i][2]
                out.append(moved)
        return code_of(np.array(out))


def code_of(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cells; should two buckets share one, they are visited together."""
    code = np.full(len(cells), 17, np.uint64)
    for column in cells.T.astype(np.int64).view(np.uint64):
        code = (code ^ column) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code.view(np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0)).dropDuplicates(["id", "v"])


def fit(rows: DataFrame, n: int, k: int, tables: int = 2, per_bucket: int = 256, width: float = 1.25, sample_rows: int = 16_000, fit_rows: int = 4_000, recall: float = 0.97, seed: int = 11) -> Index:
    """Projections for n vectors and the number of probes that finds enough of the sample's neighbours."""
    rate = min(1.0, sample_rows / max(n, 1))
    found = rows.where(F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).orderBy("id").collect()
    largest = rows.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    x, ids = np.array([r["v"] for r in found]), np.array([r["id"] for r in found])
    # a projection tells about 1.6 bits; so few vectors that they are one bucket need none, and all of them are compared
    wanted = max(1, int(round(np.log2(n / per_bucket) / 1.6))) if n > per_bucket and len(x) > k + 1 else 0
    for m in range(wanted + 1):
        rng = np.random.default_rng(seed)
        dims = x.shape[1] + 1 if len(x) else 2
        index = Index(rng.standard_normal((tables, m, dims)), rng.random((tables, m)), width, float(largest), 1, x, ids, np.zeros((len(x), tables), np.int64))
        if len(x):
            own = index.places(x, False)
            index.sample_codes = np.stack([code_of(np.floor(own[:, t]).astype(np.int64)) for t in range(tables)], axis=1)
        most = min((2 * REACH + 1) ** m, PROBES)
        if m:
            index.probes = _probes(index, rng, k, most, fit_rows, recall)
        if index.probes <= most:
            best = index
        elif most == PROBES:  # more projections need still more probes
            break
    return best


def _probes(index: Index, rng: np.random.Generator, k: int, most: int, fit_rows: int, recall: float) -> int:
    """How many probes find the share `recall` of the sample's true neighbours; most + 1 if so many do not."""
    some = rng.permutation(len(index.sample))[:fit_rows]
    x, codes = index.sample[some], index.sample_codes[some]
    asked = rng.permutation(len(x))[: min(300, len(x))]
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :k]
    at = index.places(x[asked], True)
    late = []
    for i in range(len(asked)):
        first = np.full(k, most + 1)
        for t in range(at.shape[1]):
            order = {code: j + 1 for j, code in enumerate(index.probe(at[i, t], most).tolist())}
            first = np.minimum(first, [order.get(c, most + 1) for c in codes[near[i], t].tolist()])
        late.append(first)
    return int(np.quantile(np.concatenate(late), recall, method="higher"))


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each row where `queries` (of column id) is true."""
    rows = materialise(usable(vectors, id_col, vector_col), "ann-vectors")
    n = rows.count()
    if n == 0:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    index = fit(rows, n, k, **options)
    sent = rows.sparkSession.sparkContext.broadcast(index)  # projections and a sample of fixed size
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).select("id", "v")

    def matrix(column) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(len(column), -1)

    shelves = max(1, -(-n // BLOCK))

    def shelf_of(code: np.ndarray) -> np.ndarray:
        return (code.view(np.uint64) >> np.uint64(7)) % np.uint64(shelves)

    def placed(batches):
        own = sent.value
        for batch in batches:
            if batch.num_rows:
                at = own.places(matrix(batch.column(1)), False)
                for t in range(at.shape[1]):
                    code = code_of(np.floor(at[:, t]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), t, np.int32)), pa.array(shelf_of(code).astype(np.int64)), pa.array(code), batch.column(0), batch.column(1)], ["t", "shelf", "code", "id", "v"])

    def probing(batches):
        own = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                q, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
                scores = q @ own.sample.T
                scores[own.sample_ids[None, :] == ids[:, None]] = -np.inf
                floor = np.full(len(q), -np.inf)
                places, table, shelf, codes, at = own.places(q, True), [], [], [], []
                for i in range(len(q)):
                    met = np.zeros(len(own.sample), bool)
                    for t in range(places.shape[1]):
                        code = own.probe(places[i, t], own.probes)
                        met |= np.isin(own.sample_codes[:, t], code)
                        where = shelf_of(code)
                        turn = np.argsort(where, kind="stable")
                        cuts = np.flatnonzero(np.diff(where[turn])) + 1
                        for part in np.split(turn, cuts):  # all of a query's buckets on one shelf go in one row
                            table.append(t), shelf.append(int(where[part[0]])), codes.append(code[part].tobytes()), at.append(i)
                    met = scores[i, met]
                    if len(met) >= k:
                        floor[i] = np.partition(met, len(met) - k)[len(met) - k]
                        floor[i] -= 1e-9 * max(1.0, abs(floor[i]))  # products of other shapes are rounded otherwise
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(shelf, pa.int64()), pa.array(codes, pa.binary()), batch.column(0).take(take), batch.column(1).take(take), pa.array(floor).take(take)], ["t", "shelf", "codes", "query", "q", "floor"])

    members = kept.mapInArrow(placed, "t int, shelf long, code long, id long, v array<double>")
    asked = rows.where(queries).mapInArrow(probing, "t int, shelf long, codes binary, query long, q array<double>, floor double")
    blocks = members.groupBy("t", "shelf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = members.join(blocks, ["t", "shelf"]).select("t", "shelf", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "code", "id", "v")
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    right = asked.join(blocks, ["t", "shelf"]).select("t", "shelf", each_block, "codes", "query", "q", "floor")

    def best(batches):
        """Rows come sorted by place, the members of a place before its queries; one place's members are held at a time."""
        place, parts, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, shelf, block, kind = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(shelf) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if (own := (t[lo], shelf[lo], block[lo])) != place:
                    place, parts, ready = own, [], None
                run = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    parts.append((run.column(4).to_numpy(), matrix(run.column(5)), run.column(6).to_numpy()))
                elif parts:
                    if ready is None:
                        ids, x, code = (np.concatenate(c) for c in zip(*parts, strict=True))
                        turn = np.argsort(ids, kind="stable")
                        ready = (ids[turn], x[turn], *np.unique(code[turn], return_inverse=True))
                    for start in range(0, run.num_rows, 256):
                        yield answer(*ready, run.slice(start, 256))

    def answer(ids, x, distinct, bucket, asking):
        names, q, codes, floors = asking.column(4).to_numpy(), matrix(asking.column(5)), asking.column(7).to_pylist(), asking.column(8).to_numpy()
        scores = q @ x.T
        out_q, out_id, out_s = [], [], []
        for i, sought in enumerate(codes):  # null asks all buckets
            near = scores[i] >= floors[i]
            if sought is not None:
                near &= np.isin(distinct, np.frombuffer(sought, np.int64))[bucket]
            at = np.flatnonzero(near & (ids != names[i]))
            if len(at) > k:  # what rounding may have put on the wrong side of the k-th stays
                last = np.partition(scores[i, at], len(at) - k)[len(at) - k]
                at = at[scores[i, at] >= last - 1e-9 * max(1.0, abs(last))]
            exact = (x[at] * q[i]).sum(axis=1)  # in one order for each pair, so equal vectors have equal scores
            at, exact = (z[np.lexsort((ids[at], -exact))[:k]] for z in (at, exact))
            out_q.append(np.full(len(at), names[i])), out_id.append(ids[at]), out_s.append(exact)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (out_q, out_id, out_s)], ["query_id", "id", "score"])

    def answers(members: DataFrame, asking: DataFrame) -> DataFrame:
        place = ["t", "shelf", "block"]
        none = lambda kind: F.lit(None).cast(kind)
        held = members.select(*place, F.lit(0).cast("byte").alias("kind"), "id", "v", "code", none("binary").alias("codes"), none("double").alias("floor"))
        met = held.unionByName(asking.select(*place, F.lit(1).cast("byte").alias("kind"), F.col("query").alias("id"), F.col("q").alias("v"), none("long").alias("code"), "codes", "floor"))
        found = met.repartition(*place).sortWithinPartitions(*place, "kind").mapInArrow(best, "query_id long, id long, score double")
        found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")

    found = answers(left, right)
    if index.lines.shape[1] == 0:  # everything was compared
        return found
    found = materialise(found, "ann-found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = materialise(rows.where(queries).join(full, "id", "left_anti"), "ann-short")
    if short.isEmpty():
        release(short)
        return found
    every = short.withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shelves - 1).cast("long")))).join(blocks.where("t = 0"), "shelf")
    again = every.select(F.lit(0).alias("t"), "shelf", each_block, F.lit(None).cast("binary").alias("codes"), F.col("id").alias("query"), F.col("v").alias("q"), F.lit(float("-inf")).alias("floor"))
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(*found.columns).unionByName(answers(left.where("t = 0"), again))
