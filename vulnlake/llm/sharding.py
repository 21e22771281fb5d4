"""Sharding by sampled splitters (native).

A size-weighted sample of the keys gives quantile boundaries; records are range-partitioned by them, ranges that come
out overfull get boundaries of their own, from ever denser samples, until none is that could be divided, and a running sum inside each range (plus the offsets of the ranges before
it) gives every record its exact place in key order.  A record's shard is where the middle of its bytes falls, so
shard sizes differ by about one record.

The key is (hash of the text, id, row position): equal texts are neighbours, and a text that a third of all rows
share is still split, because the id and the position go into the boundaries too.

Defined cases: a null text has no bytes (its size is the fixed overhead) and the checksum of the empty text; null ids
sort first; repeated rows are separate records; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import materialise, release

#: Boundaries are searched in levels of about this many.
FAN = 32


def _levels(bounds: list[tuple]) -> list[list]:
    """Sorted boundaries as levels of groups of FAN, the coarsest first; a coarser level has the last one of each group."""
    levels, now = [], bounds
    while True:
        groups = [now[i : i + FAN] for i in range(0, len(now), FAN)] or [[]]
        levels.insert(0, groups)
        if len(groups) == 1:
            return levels
        now = [g[-1] for g in groups]


def _ranged(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
    """rows with r, how many of the sorted boundaries are at or before the row's key.

    The boundaries are one value, which goes to the tasks with the plan; there are as many as ranges, which the caller bounds.
    """
    point = F.struct("k", "d", "p")
    levels = _levels(bounds)
    kind = "array<array<struct<k:long,d:long,p:long>>>"
    tree = rows.sparkSession.createDataFrame([(levels,)], "t array<" + kind + ">")
    placed = rows.withColumn("t", tree.scalar()).withColumn("r", F.lit(0))
    for i, groups in enumerate(levels):
        group = F.coalesce(F.get(F.col("t")[i], F.col("r")), F.array().cast("array<struct<k:long,d:long,p:long>>"))
        placed = placed.withColumn("r", F.least(F.col("r") * FAN + F.size(F.filter(group, lambda b: b <= point)), F.lit(sum(map(len, groups)))))
    return placed.drop("t")


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, ranges_per_shard: int = 16, samples_per_range: int = 24, range_bytes: int = 4 << 30) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of docs.

    There are n_shards * ranges_per_shard ranges, or more where one would hold more than about range_bytes, so that a task
    sorts as much at any size of the input.  The driver holds samples_per_range keys of each range at most.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"),
        F.monotonically_increasing_id().alias("p"),
    )
    base = materialise(base, "shard-keys")
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = max(n_shards * ranges_per_shard, -(-total // range_bytes))
    # Half of a record's weight is its size and half the mean size: ranges are even in bytes, and none has very many rows.
    weight = F.col("size") + F.lit(total / max(rows, 1))
    chance = F.pmod(F.xxhash64("k", "d", "p", F.lit("splitters")), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def sampled(of: DataFrame, rate: float) -> list[tuple]:
        found = of.where(chance < weight * F.lit(rate)).select("k", "d", "p").toArrow()
        return sorted(zip(*(found.column(i).to_pylist() for i in range(3)), strict=True))

    rate = n_ranges * samples_per_range / max(2.0 * total, 1.0)
    bounds = sampled(base, rate)[samples_per_range::samples_per_range]
    share = 2.0 * total / n_ranges
    step = rate
    while step < 1.0:  # at 1 every record of an overfull range is a boundary's candidate
        step = min(1.0, step * 8)
        loads = _ranged(base, bounds).groupBy("r").agg((F.sum(weight) - F.max(weight)).alias("w"))  # beside its largest record, which no boundary can divide
        full = {r["r"]: r["w"] for r in loads.where(F.col("w") > 2 * share).collect()}  # at most half as many as ranges
        if not full:
            break
        keys: dict[int, list] = {}
        for key in sampled(_ranged(base, bounds).join(F.broadcast(docs.sparkSession.createDataFrame([(r,) for r in full], "r int")), "r"), step):
            keys.setdefault(bisect_right(bounds, key), []).append(key)
        for r, own in keys.items():  # as many parts as shares
            parts = int(full.get(r, 0) // share) + 2
            bounds = [*bounds, *(own[len(own) * i // parts] for i in range(1, parts))]
        bounds = sorted(set(bounds))
    placed = _ranged(base, bounds)
    order = Window.partitionBy("r").orderBy("k", "d", "p")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets, ahead = [], 0
    for r, b in sorted(tuple(x) for x in placed.groupBy("r").agg(F.sum("size")).collect()):  # a row a range
        offsets.append((r, ahead))
        ahead += b
    before = docs.sparkSession.createDataFrame(offsets, "r int, before long")
    middle = F.col("before") + F.sum("size").over(upto) - F.col("size") / 2
    shard = F.least(F.floor(middle * n_shards / F.lit(float(max(total, 1)))), F.lit(n_shards - 1)).cast("int")
    ranked = materialise(placed.join(F.broadcast(before), "r").select("id", "size", "text_crc32", "r", F.row_number().over(order).cast("long").alias("n"), shard.alias("shard")), "shard-ranks")
    release(base)
    # Shards are runs of the key order: a (range, shard) pair needs where it starts in its range and what its shard had before.
    starts, had = [], dict.fromkeys(range(n_shards), 0)
    for r, s, first, n in sorted(tuple(x) for x in ranked.groupBy("r", "shard").agg(F.min("n"), F.count("*")).collect()):
        starts.append((r, s, had[s] - first))
        had[s] += n
    spark = docs.sparkSession
    shift = spark.createDataFrame(starts, "r int, shard int, shift long")  # at most ranges + shards rows
    return ranked.join(F.broadcast(shift), ["r", "shard"]).select("id", "size", "text_crc32", "shard", (F.col("n") + F.col("shift")).alias("slot")).withColumnRenamed("id", id_col)
