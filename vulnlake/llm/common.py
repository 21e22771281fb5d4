"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vulnlake.session import materialise, release, shared_dir  # noqa: F401


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, everything else as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text in UTF-8: runs of anything but ASCII white space; none for null."""
    return text.encode().lower().split() if text else []


def lower_ascii_col(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(key: Column, buckets: int) -> Column:
    """crc32 of a key as text, modulo buckets; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(buckets)


def is_held_out(key: Column, buckets: int) -> Column:
    """True where the key's crc32 is divisible by buckets; a null key is not held out."""
    return F.coalesce(bucket_of(key, buckets) == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(column, budget: int = 2_000_000):
    """Consecutive runs of an Arrow string column as Python lists, each of about `budget` bytes (one row at least)."""
    n, start = len(column), 0
    while start < n:
        stop, size = start, 0
        while stop < n and (stop == start or size < budget):
            step = min(n, stop + 32)
            size += column.slice(stop, step - stop).nbytes
            stop = step
        yield start, column.slice(start, stop - start).to_pylist()
        start = stop
