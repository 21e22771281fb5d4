"""Writers.  All go through Spark's committers, so a file is there whole or not at all."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def json_object(df: DataFrame, path: str, key: str, one_file: bool = False) -> None:
    """A folder of files that each hold one object keyed by `key`, an entry a line; rows stream through their writers.

    one_file: a single file, and so a single writer, for a reader that wants it; what the rows come from stays parallel.
    """
    record = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    entry = F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(": "), record)

    def lines(batches):
        first = True
        for batch in batches:
            found = batch.column(0).to_pylist()
            if found:
                yield pa.RecordBatch.from_pydict({"value": pa.array([("{\n" if first and i == 0 else ",") + x for i, x in enumerate(found)], pa.string())})
                first = False
        if not first or one_file:
            yield pa.RecordBatch.from_pydict({"value": pa.array(["{}" if first else "}"])})

    rows = df.select(entry.alias("value"))
    (rows.repartition(1) if one_file else rows).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def json_array(df: DataFrame, path: str) -> None:
    """A folder of files that each hold one array; rows stream through their writers."""

    def lines(batches):
        first = True
        for batch in batches:
            found = batch.column(0).to_pylist()
            if found:
                yield pa.RecordBatch.from_pydict({"value": pa.array([("[" if first and i == 0 else ",") + x for i, x in enumerate(found)], pa.string())})
                first = False
        if not first:
            yield pa.RecordBatch.from_pydict({"value": pa.array(["]"])})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header; mode "append" adds files, each with its own header, which readers skip."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def by_key(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """A folder for each key.  Rows of a key are brought together first, so that a key has few files."""
    df.repartition(F.col(key)).write.mode(mode).partitionBy(key).json(path)


def files_by_key(records: DataFrame, files: DataFrame, path: str, key: str, id_col: str, pattern: str) -> None:
    """A folder for each key with its records' files: (name, content) of files whose name holds a record's id.

    pattern: a regular expression whose first group is the id in a file's name.  The content goes along as a column.
    """
    named = files.withColumn(id_col, F.regexp_extract("name", pattern, 1)).where(F.col(id_col) != "")
    by_key(records.select(key, id_col).distinct().join(named, id_col), path, key)


def add_to_ledger(done: DataFrame, path: str, key: str) -> None:
    """Append finished keys."""
    done.select(key).distinct().write.mode("append").parquet(path)


def pending(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the ledger."""
    return df.join(ledger.select(key).distinct(), key, "left_anti")
