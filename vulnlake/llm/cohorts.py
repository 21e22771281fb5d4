"""Cohort retention with bitmap cells: who of a cohort is still seen, as one state of knowledge or another has it.

Clients that have a start get dense ids.  Every cell (state, segment, cohort, period) holds its clients as bitmaps, one a
chunk of 2^CHUNK_BITS ids, compressed: a sorted list of positions while that is shorter than the bits.  Tasks build the bitmaps of
the clicks that they read; the bitmaps of a cell and chunk are OR-merged; their popcount is the number of users, their
intersection with the chunk's bitmap of moved clients (made from the bitmaps of the two states' cohorts) the number of moved
ones, and a lookup of the set bits in the chunk's table of checksums the sum of crc32.

Clicks meet the starts in a shuffle join on the client, which adaptive execution splits where one client has many rows.  The
dense ids follow that shuffle's partitions, so a task's clients share few chunks and its bitmaps are well filled; results
don't depend on it.  A chunk's cells are dealt over PARTS groups, each of which gets the chunk's table.  Nothing that grows with the
input goes through one task, to the driver or into a broadcast; the numbers of clients of the shuffle's partitions do.

Defined cases: equal clicks count once; a click without a time or client is dropped, one without arrival is known to the last
state alone, one without id arrives as stated, one of a null or non-finite value adds no cents; a client of several rows in
`clients` has its smallest source, one without a row or source the segment ''; a client without a start has no cell; empty
tables give an empty result; further columns of `clients` are ignored, further columns of clicks take part in equality only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import materialise, partitions

CHUNK_BITS = 12
#: Groups that a chunk's cells are dealt over.
PARTS = 16
#: Clicks of the two states that a task holds before it turns them into bitmaps.
HELD = 2_000_000
WEEK = 7 * 86_400_000_000
CELL = "state int, segment string, cohort long, period long"


def pack(lows: np.ndarray, bits: int = CHUNK_BITS) -> bytes:
    """A bitmap of distinct ascending positions: b"\\0" and 16-bit positions, or b"\\1" and all bits."""
    if 2 * len(lows) < 1 << (bits - 3):
        return b"\0" + lows.astype("<u2").tobytes()
    full = np.zeros(1 << bits, np.uint8)
    full[lows] = 1
    return b"\1" + np.packbits(full, bitorder="little").tobytes()


def merge_into(row: np.ndarray, packed: bytes) -> None:
    """OR a packed bitmap into a row of bytes."""
    if packed[0]:
        row |= np.frombuffer(packed, np.uint8, offset=1)
    else:
        lows = np.frombuffer(packed, "<u2", offset=1)
        np.bitwise_or.at(row, lows >> 3, np.left_shift(1, lows & 7).astype(np.uint8))


def known_clicks(clicks: DataFrame, until: str, error_kind: str) -> DataFrame:
    """(client_id, ts, starts, known, cents) of every different click: whether it can start a client, whether state 0 knows it."""
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.when(h % 3 == 0, (h % 100).cast("int")).otherwise(F.lit(0))
    arrival = F.col("arrived_at").cast("timestamp_ntz") + F.make_dt_interval(late)
    value = F.col("value").cast("double")
    cents = F.when(F.abs(value) < float("inf"), F.floor(value * 100 + 0.5)).otherwise(F.lit(0)).cast("long")
    return clicks.where("ts IS NOT NULL AND client_id IS NOT NULL").distinct().select(
        F.col("client_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.coalesce(F.col("kind") == error_kind, F.lit(False)).alias("starts"),
        F.coalesce(arrival < F.lit(until).cast("timestamp_ntz"), F.lit(False)).alias("known"), cents.alias("cents"))


def dense_starts(known: DataFrame, clients: DataFrame) -> DataFrame:
    """(client_id, id, s0, s1, segment): the starts of every client that has one, with ids 0, 1, ... in the order of the shuffle."""
    buckets = partitions(known.sparkSession)
    starts = known.where("starts").groupBy("client_id").agg(F.min(F.when(F.col("known"), F.col("ts"))).alias("s0"), F.min("ts").alias("s1"))
    segment = clients.where("client_id IS NOT NULL").groupBy("client_id").agg(F.min("source").alias("segment"))
    starts = starts.join(segment, "client_id", "left").select("client_id", "s0", "s1", F.coalesce("segment", F.lit("")).alias("segment"), F.pmod(F.hash("client_id"), F.lit(buckets)).alias("__bucket"))
    counts = starts.groupBy("__bucket").count()  # a row for each partition of the shuffle
    before = counts.select("__bucket", (F.sum("count").over(Window.orderBy("__bucket")) - F.col("count")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy("client_id")) - 1
    return starts.withColumn("__place", place).join(F.broadcast(before), "__bucket").select("client_id", (F.col("__before") + F.col("__place")).alias("id"), "s0", "s1", "segment")


def _us(column) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds and validity of an Arrow timestamp column."""
    plain = column.cast(pa.timestamp("us")).cast(pa.int64())
    return plain.fill_null(0).to_numpy(zero_copy_only=False), plain.is_valid().to_numpy(zero_copy_only=False)


def _partial_cells(bits: int):
    schema = pa.schema([("state", pa.int32()), ("segment", pa.string()), ("cohort", pa.int64()), ("period", pa.int64()), ("chunk", pa.int64()), ("bitmap", pa.binary()), ("cents", pa.int64())])

    def flush(names: list[str], held: list):
        state, segment, cohort, period, ids, cents = (np.concatenate(x) for x in zip(*held, strict=True))
        chunk = ids >> bits
        order = np.lexsort((ids, chunk, period, cohort, segment, state))
        keys = [x[order] for x in (state, segment, cohort, period, chunk)]
        ids, cents = ids[order], cents[order]
        new = np.ones(len(ids), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(cents, first)
        fresh = new.copy()
        fresh[1:] |= ids[1:] != ids[:-1]
        lows, ends = (ids & ((1 << bits) - 1))[fresh], np.append(np.cumsum(fresh)[first] - 1, fresh.sum())
        maps = [pack(lows[a:b], bits) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        state, segment, cohort, period, chunk = (k[first] for k in keys)
        for i in range(0, len(first), 20_000):
            cut = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(state[cut], pa.int32()), pa.array([names[s] for s in segment[cut]], pa.string()), pa.array(cohort[cut]), pa.array(period[cut]), pa.array(chunk[cut]), pa.array(maps[cut], pa.binary()), pa.array(sums[cut])], schema=schema)

    def run(batches):
        names: dict[str, int] = {}
        held, size = [], 0
        for batch in batches:
            ts, _ = _us(batch.column("ts"))
            known = batch.column("known").to_numpy(zero_copy_only=False)
            ids, cents = batch.column("id").to_numpy(), batch.column("cents").to_numpy()
            coded = batch.column("segment").dictionary_encode()
            code = np.array([names.setdefault(s, len(names)) for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(ids) else ids
            for state, (start, has) in enumerate((_us(batch.column("s0")), _us(batch.column("s1")))):
                use = np.flatnonzero(has & (ts >= start) & (known if state == 0 else True))
                held.append((np.full(len(use), state), code[use], start[use] // WEEK, (ts[use] - start[use]) // WEEK, ids[use], cents[use]))
                size += len(use)
            if size > HELD:
                yield from flush(list(names), held)
                names, held, size = {}, [], 0
        if size:
            yield from flush(list(names), held)

    return run


def _partial_chunks(bits: int):
    """Per chunk the positions of the clients that a task reads, their checksums, and their cohorts in the two states (absent: null)."""
    schema = pa.schema([("chunk", pa.int64()), ("lows", pa.list_(pa.int32())), ("crcs", pa.list_(pa.int64())), ("c0", pa.list_(pa.int64())), ("c1", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, crcs = batch.column("id").to_numpy(), batch.column("crc").to_numpy()
            cohorts = [[int(x) if ok else None for x, ok in zip(us // WEEK, has, strict=True)] for us, has in (_us(batch.column("s0")), _us(batch.column("s1")))]
            order = np.argsort(ids, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(ids[order] >> bits)) + 1) if len(ids) else []:
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[own[0]] >> bits)]), pa.array([ids[own] & ((1 << bits) - 1)], schema.field("lows").type), pa.array([crcs[own]], schema.field("crcs").type), *(pa.array([[c[i] for i in own]], schema.field("c0").type) for c in cohorts)], schema=schema)

    return run


def _chunk_table(bits: int):
    """A chunk's checksums by position, and the bitmap of clients whose cohort differs between the states."""
    schema = pa.schema([("chunk", pa.int64()), ("crcs", pa.binary()), ("moved", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        lows = np.concatenate([x.values.to_numpy() for x in table.column("lows")])
        crcs = np.zeros(1 << bits, "<i8")
        crcs[lows] = np.concatenate([x.values.to_numpy() for x in table.column("crcs")])
        of = []  # for each state, the bitmap of every cohort's starts
        for name in ("c0", "c1"):
            own: dict[int, np.ndarray] = {}
            for low, cohort in zip(lows, [c for x in table.column(name) for c in x.as_py()], strict=True):
                if cohort is not None:
                    row = own.setdefault(cohort, np.zeros(1 << (bits - 3), np.uint8))
                    row[low >> 3] |= 1 << (low & 7)
            of.append(own)
        none = np.zeros(1 << (bits - 3), np.uint8)
        both = np.bitwise_or.reduce([none, *of[0].values()]) & np.bitwise_or.reduce([none, *of[1].values()])
        same = np.bitwise_or.reduce([none, *(row & of[1][c] for c, row in of[0].items() if c in of[1])])
        return pa.table([table.column("chunk").slice(0, 1), pa.array([crcs.tobytes()], pa.binary()), pa.array([(both & ~same).tobytes()], pa.binary())], schema=schema)

    return run


def _measure(bits: int):
    """The cells of a group and their chunk's table to users, checksums, moved users and cents of that chunk."""
    schema = pa.schema([("state", pa.int32()), ("segment", pa.string()), ("cohort", pa.int64()), ("period", pa.int64()), ("users", pa.int64()), ("users_crc32", pa.int64()), ("moved", pa.int64()), ("cents", pa.int64())])

    def run(cells: pa.Table, chunks: pa.Table) -> pa.Table:
        if not cells.num_rows or not chunks.num_rows:
            return schema.empty_table()
        crcs = np.frombuffer(chunks.column("crcs")[0].as_py(), "<i8")
        moved = np.frombuffer(chunks.column("moved")[0].as_py(), np.uint8)
        keys = list(zip(*(cells.column(c).to_pylist() for c in ("state", "segment", "cohort", "period")), strict=True))
        rows = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        maps, cents = np.zeros((len(rows), 1 << (bits - 3)), np.uint8), [0] * len(rows)
        for key, packed, c in zip(keys, cells.column("bitmap"), cells.column("cents").to_pylist(), strict=True):
            merge_into(maps[rows[key]], packed.as_buffer().to_pybytes())
            cents[rows[key]] += c
        users = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        stay = np.bitwise_count(maps & moved).sum(axis=1, dtype=np.int64)
        sums = [int(crcs[np.flatnonzero(np.unpackbits(m, bitorder="little"))].sum()) for m in maps]
        return pa.table([*(pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=False)), pa.array(users), pa.array(sums, pa.int64()), pa.array(stay), pa.array(cents, pa.int64())], schema=schema)

    return run


def retention(clicks: DataFrame, clients: DataFrame, until: str = "2024-02-01 00:00:00", error_kind: str = "error", bits: int = CHUNK_BITS) -> DataFrame:
    """(state, segment, cohort, period, users, users_crc32, moved, cents) of every nonempty cell."""
    known = materialise(known_clicks(clicks, until, error_kind), "cohort-clicks")
    starts = materialise(dense_starts(known, clients), "cohort-starts")
    joined = known.join(starts, "client_id").select("ts", "known", "cents", "id", "s0", "s1", "segment")
    cells = joined.mapInArrow(_partial_cells(bits), f"{CELL}, chunk long, bitmap binary, cents long")
    dealt = cells.withColumn("part", _part(F.xxhash64("state", "segment", "cohort", "period")))
    crc = F.crc32(F.col("client_id").cast("string").cast("binary"))
    pieces = starts.select("id", crc.alias("crc"), "s0", "s1").mapInArrow(_partial_chunks(bits), "chunk long, lows array<int>, crcs array<long>, c0 array<long>, c1 array<long>")
    chunks = pieces.groupBy("chunk").applyInArrow(_chunk_table(bits), "chunk long, crcs binary, moved binary")
    chunks = chunks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    sums = dealt.groupBy("chunk", "part").cogroup(chunks.groupBy("chunk", "part")).applyInArrow(_measure(bits), f"{CELL}, users long, users_crc32 long, moved long, cents long")
    return sums.groupBy("state", "segment", "cohort", "period").agg(*(F.sum(c).alias(c) for c in ("users", "users_crc32", "moved", "cents")))


def _part(h: Column) -> Column:
    return F.pmod(h, F.lit(PARTS)).cast("int")
