"""Readers: JSON objects and arrays, CSV, line lists, directories of pages and bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vulnlake.functions import code

FILE_KEY = r"([^/]+?)(?:\.[^./]+)?$"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) not in (None, [])


def json_object(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """(id, record) of files that hold one object keyed by id; value_type is the records' type."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value_type}>")).alias("id", "record"))


def json_object_lines(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """(id, record) of files that hold one object keyed by id with an entry a line; a file of any size is read in splits."""
    bare = F.regexp_replace(F.trim("value"), r"^,\s*|\s*,$", "")
    rows = spark.read.text(path).select(bare.alias("e")).where(F.col("e").startswith('"'))
    return rows.select(F.explode(F.from_json(F.concat(F.lit("{"), "e", F.lit("}")), f"map<string,{value_type}>")).alias("id", "record"))


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of files that hold one array; unreadable ones stay in _corrupt_record if the schema has it."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_mixed(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of files of which some hold an array of records and some an object of records."""
    whole = spark.read.text(path, wholetext=True)
    is_list = F.trim("value").startswith("[")
    a = whole.where(is_list).select(F.explode(F.from_json("value", f"array<{record}>")).alias("r"))
    b = whole.where(~is_list).select(F.explode(F.map_values(F.from_json("value", f"map<string,{record}>"))).alias("r"))
    return a.unionByName(b).select("r.*")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def csv_typed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def csv_headless(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.csv(path, header=False, multiLine=True, escape='"').toDF(*names)


def id_lines(spark: SparkSession, path: str, upper: bool = False, distinct: bool = False) -> DataFrame:
    """Lines without white space around them and without empty ones."""
    line = F.trim(F.regexp_replace("value", r"\s+$", ""))
    rows = spark.read.text(path).select((F.upper(line) if upper else line).alias("id")).where(F.col("id") != "")
    return rows.distinct() if distinct else rows


def keyed_files(spark: SparkSession, path: str, column: str = "content", key: str = FILE_KEY) -> DataFrame:
    """(id, content) of a folder of files; key: a regular expression whose first group is the id in a file's path, by default its name."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), key, 1).alias("id"), F.col("value").alias(column))


def keyed_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a folder of JSON files with the file's name as id."""
    return spark.read.schema(schema).json(path, multiLine=True).select(F.regexp_extract(F.col("_metadata.file_name"), FILE_KEY, 1).alias("id"), "*")


def thread_bodies(spark: SparkSession, path: str, group: str = r"([^/]+)/[^/]+$", thread: str = FILE_KEY) -> DataFrame:
    """(year_quarter, thread_id, body) of bodies kept as <year_quarter>/<thread_id>.txt, or where the two expressions find them in a path."""
    where = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract(where, group, 1).alias("year_quarter"), F.regexp_extract(where, thread, 1).alias("thread_id"), F.col("value").alias("body"))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, author, date, message, files) of exported logs, an entry a row; logs are read in splits, however long."""
    entries = spark.read.option("lineSep", "\ncommit ").text(path).select(F.when(F.col("value").startswith("commit "), F.col("value")).otherwise(F.concat(F.lit("commit "), "value")).alias("b"))
    return entries.where(F.col("b").rlike("^commit [0-9a-f]{7,40}")).select(code.log_entry(F.col("b")).alias("e")).select("e.*")


def optional(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    """read(spark, path), or an empty table with the schema if nothing is there."""
    return read(spark, path) if _exists(spark, path) else spark.createDataFrame([], schema)


def windows(spark: SparkSession, first: str, last: str, days: int = 120) -> DataFrame:
    """(start, end) of consecutive windows that cover first to last."""
    at = F.explode(F.expr(f"sequence(timestamp '{first}', timestamp '{last}', interval {days} days)")).alias("start")
    end = F.least(F.expr(f"start + interval {days} days"), F.expr(f"timestamp '{last}'"))
    return spark.range(1).select(at).select("start", end.alias("end")).where("start < end")


def pages(spark: SparkSession, total: int, size: int) -> DataFrame:
    """Offsets of a paged source."""
    return spark.range(0, total, size).select(F.col("id").alias("offset"), F.least(F.lit(size), F.lit(total) - F.col("id")).alias("n"))
