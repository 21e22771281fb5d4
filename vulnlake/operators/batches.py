"""Greedy batches of one long list over many tasks.

A list is numbered and summed up by ranges.  Where a batch that begins at a row ends follows from the sums alone: the row in whose
span the budget behind the begin falls begins the next batch.  Stretches of HOPS budgets are cut by these sums; each gets the rows of
the next one's first budget too, so all its rows' next begins are found in it by a search.  Begins by which a list's batches enter
a stretch stand in its first budget (or are its first row), so only for those it is told where they leave it and after how many
batches; pointers between them are doubled until all that the first row leads to are known.  A stretch is kept as one packed row,
so numbering it needs its entry and the batches before it, but no other shuffle of its rows.

Rows without tokens take no span; a run of them lies in one stretch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.session import materialise, release

#: Budgets of a stretch.
HOPS = 64


def numbered(rows: DataFrame) -> DataFrame:
    """(k, pos, tokens, i, s): rows of (k, pos, tokens) with their place in their key and the sum before them; no key needs to fit a task."""
    kinds = dict(rows.dtypes)
    ordered = rows.repartitionByRange("k", "pos", "tokens").sortWithinPartitions("k", "pos", "tokens")

    def count(batches):
        part = TaskContext.get().partitionId()
        last, place, total = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("k").dictionary_encode()
            codes, tokens = keys.indices.to_numpy(), batch.column("tokens").to_numpy()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
            before = np.cumsum(tokens) - tokens
            i, s = np.arange(len(codes)) - first[run], before - before[first][run]
            if batch.column("k")[0].as_py() == last:
                i[run == 0] += place
                s[run == 0] += total
            last, place, total = batch.column("k")[-1].as_py(), int(i[-1]) + 1, int(s[-1] + tokens[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part), pa.int32()), pa.array(i), pa.array(s)], ["k", "pos", "tokens", "part", "li", "ls"])

    local = materialise(ordered.mapInArrow(count, f"k {kinds['k']}, pos {kinds['pos']}, tokens long, part int, li long, ls long"), "batch-rows")
    parts = local.groupBy("k", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    w = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("k", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("t").over(w), F.lit(0)).alias("t"))
    return local.join(before, ["k", "part"]).select("k", "pos", "tokens", (F.col("li") + F.col("n")).alias("i"), (F.col("ls") + F.col("t")).alias("s"))


def _next(s: np.ndarray, tokens: np.ndarray, budget: int) -> np.ndarray:
    """Place of the row that begins the next batch after one that begins at each row; len(s) or more if no such row is here."""
    full = np.flatnonzero(tokens > 0)
    if not len(full):
        return np.full(len(s), len(s))
    hit = np.searchsorted(s[full], s + budget, "right") - 1  # the last row with tokens that begins within the budget
    at = full[np.maximum(hit, 0)]
    spans = (hit >= 0) & (s[at] + tokens[at] > s + budget)
    # the row that the budget falls into begins the next batch, unless it is this batch's first one with tokens
    return np.where(spans, np.where(s[at] == s, at + 1, at), len(s) + 1)


def _pack(budget: int, hops: int):
    """A stretch as one row: its first number, positions, next begins (-1: the list ends before); and for the rows that can be its entry where they leave it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, s, tokens = (table.column(c).to_numpy() for c in ("i", "s", "tokens"))
        own = int((~table.column("halo").to_numpy()).sum())  # what is lent follows
        to = _next(s, tokens, budget)
        to = np.where(to <= len(s), i[0] + to, -1)[:own]
        left, count = to.copy(), np.ones(own, np.int64)
        while len(inside := np.flatnonzero((left >= i[0]) & (left < i[0] + own))):
            at = left[inside] - i[0]
            left[inside], count[inside] = left[at], count[inside] + count[at]
        cand = np.flatnonzero((s[:own] - table.column("stretch")[0].as_py() * budget * hops <= budget) | (np.arange(own) == 0))
        pack = lambda x: pa.array([x.astype(np.int64).tobytes()], pa.binary())
        of = table.slice(0, 1)
        pos = table.column("pos").slice(0, own).combine_chunks()
        return pa.table([of.column("k"), of.column("stretch"), pa.array(i[:1]), pa.ListArray.from_arrays(pa.array([0, own], pa.int32()), pos), pack(to), pack(i[cand]), pack(left[cand]), pack(count[cand])], PACKED)

    return run


PACKED = ["k", "stretch", "first", "pos", "next", "at", "exit", "count"]


def _exits(batches):
    """(k, stretch, i, exit, count) of the rows that can be a stretch's entry."""
    for batch in batches:
        for j in range(batch.num_rows):
            at, left, count = (np.frombuffer(batch.column(c)[j].as_py(), np.int64) for c in ("at", "exit", "count"))
            index = pa.array(np.full(len(at), j))
            yield pa.RecordBatch.from_arrays([batch.column("k").take(index), batch.column("stretch").take(index), pa.array(at), pa.array(left), pa.array(count)], ["k", "stretch", "i", "exit", "count"])


def _mark(batches):
    """(k, pos, batch) of packed stretches with their entry (null: none) and the batches before it."""
    for batch in batches:
        for j in range(batch.num_rows):
            first, entry, before, pos = batch.column("first")[j].as_py(), batch.column("entry")[j].as_py(), batch.column("before")[j].as_py(), batch.column("pos")[j].values
            to = np.frombuffer(batch.column("next")[j].as_py(), np.int64)
            begins, at = np.zeros(len(to), np.int64), entry
            while at is not None and first <= at < first + len(to):
                begins[at - first] = 1
                at = int(to[at - first])
            number = (before - 1 + np.cumsum(begins)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(np.full(len(to), j))), pos, pa.array(number)], ["k", "pos", "batch"])


def long_batches(rows: DataFrame, key: str, pos: str, tokens: str, budget: int = 300_000, hops: int = HOPS) -> DataFrame:
    """(key, pos, batch): texts in order, a new batch where the next would go over the budget; a key may be of any length.

    A single text over the budget is a batch of its own; no batch is empty; a null count is 0; equal positions are
    ordered by their counts; rows of a null key are left out.
    """
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(pos).alias("pos"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    kinds = dict(plain.dtypes)
    stretch = F.floor(F.col("s") / (budget * hops)).cast("long")
    lent = (F.col("own") > 0) & (F.col("s") - F.col("own") * (budget * hops) <= budget)
    dealt = numbered(plain).withColumn("own", stretch).withColumn("stretch", F.explode(F.when(lent, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))))
    dealt = dealt.select("k", "stretch", "pos", "tokens", "i", "s", (F.col("stretch") != F.col("own")).alias("halo"))
    schema = f"k {kinds['k']}, stretch long, first long, pos array<{kinds['pos']}>, next binary, at binary, exit binary, count binary"
    packed = materialise(dealt.groupBy("k", "stretch").applyInArrow(_pack(budget, hops), schema), "batch-stretches")
    left = materialise(packed.select("k", "stretch", "at", "exit", "count").mapInArrow(_exits, f"k {kinds['k']}, stretch long, i long, exit long, count long"), "batch-exits")
    nodes = left.where("exit >= 0").select("k", F.col("exit").alias("i")).unionAll(left.where("i = 0").select("k", "i")).distinct()
    jumps = materialise(left.join(nodes, ["k", "i"]).select("k", "i", "exit"), "batch-jumps")
    reached = materialise(left.where("i = 0").select("k", "i").distinct(), "batch-reached")
    while True:
        on = reached.join(jumps, ["k", "i"]).where("exit >= 0").select("k", F.col("exit").alias("i"))
        wider = materialise(reached.unionAll(on).distinct(), "batch-reached")
        grown = wider.count() > reached.count()
        release(reached)
        reached = wider
        if not grown:
            break
        further = jumps.select("k", F.col("i").alias("exit"), F.col("exit").alias("to"))
        doubled = materialise(jumps.join(further, ["k", "exit"], "left").select("k", "i", F.coalesce(F.when(F.col("exit") >= 0, F.col("to")), F.lit(-1)).alias("exit")), "batch-jumps")
        release(jumps)
        jumps = doubled
    entries = left.join(reached, ["k", "i"]).select("k", "stretch", F.col("i").alias("entry"), "count")
    met = packed.select("k", "stretch").join(entries, ["k", "stretch"], "left")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = met.select("k", "stretch", "entry", before.alias("before"))
    found = packed.select("k", "stretch", "first", "pos", "next").join(numbers, ["k", "stretch"])
    return found.mapInArrow(_mark, f"k {kinds['k']}, pos {kinds['pos']}, batch int").select(F.col("k").alias(key), F.col("pos").alias(pos), "batch")
