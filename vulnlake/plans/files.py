"""Queries of readers and writers: tables go out in each format and come back through the reader for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vulnlake.plans.evaluation import cve_col, cve_sql
from vulnlake.session import scratch, table
from vulnlake.sources import readers, sinks
from vulnlake.streaming import resume


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(cve_col(F.col("s_suppkey")).alias("cve"), "s_name", "s_nationkey")


def s1_json_object(spark, sf_dir):
    """K1: objects keyed by id, an entry a line, read in splits."""
    path = scratch(spark, "s1")
    sinks.json_object(_suppliers(spark, sf_dir), path, "cve")
    return readers.json_object_lines(spark, path, "struct<s_name:string,s_nationkey:int>").select("id", "record.s_name", "record.s_nationkey")


def s2_json_array(spark, sf_dir):
    """Files that hold one array each."""
    path = scratch(spark, "s2")
    sinks.json_array(_suppliers(spark, sf_dir).repartition(3, "cve"), path)
    return readers.json_array(spark, path, "cve string, s_name string, s_nationkey int")


def s3_json_mixed(spark, sf_dir):
    """Some files hold an array of records, some an object of records."""
    path = scratch(spark, "s3")
    rows = _suppliers(spark, sf_dir)
    sinks.json_array(rows.where("s_nationkey % 2 = 0"), f"{path}/a")
    sinks.json_object(rows.where("s_nationkey % 2 = 1").withColumn("key", F.col("cve")), f"{path}/b", "key")
    return readers.json_mixed(spark, f"{path}/*", "struct<cve:string,s_name:string,s_nationkey:int>")


def s2_s3_json_records(spark, sf_dir):
    """JSON lines, the form for large tables."""
    path = scratch(spark, "s2")
    sinks.json_rows(_suppliers(spark, sf_dir), path)
    return spark.read.schema("cve string, s_name string, s_nationkey int").json(path)


def s4_s6_csv(spark, sf_dir):
    """All columns as text, then with declared types."""
    path = scratch(spark, "s4")
    sinks.csv(_suppliers(spark, sf_dir), path)
    typed = readers.csv_typed(spark, path, "cve string, s_name string, s_nationkey int")
    return readers.csv_text(spark, path).select("cve", F.col("s_nationkey").alias("as_text")).join(typed, "cve")


def s6_headless_csv(spark, sf_dir):
    """CSV without a header; K3: written in two appends."""
    path = scratch(spark, "s6")
    rows = _suppliers(spark, sf_dir).select("cve", F.concat(F.lit('a "q", '), "s_name").alias("note"))
    for part in (0, 1):
        rows.where(F.length("note") % 2 == part).write.mode("append").option("escape", '"').csv(path)
    return readers.csv_headless(spark, path, ["cve", "note"])


def s7_id_lines(spark, sf_dir):
    path = scratch(spark, "s7")
    _suppliers(spark, sf_dir).select(F.concat(F.lit(" "), F.lower("cve"), F.when(F.col("s_nationkey") % 2 == 0, " ").otherwise("")).alias("value")).write.text(path)
    return readers.id_lines(spark, path, upper=True, distinct=True)


def s8_s10_keyed_files(spark, sf_dir):
    """A folder for each key, the content as a column instead of copied files."""
    path = scratch(spark, "s8")
    sinks.by_key(_suppliers(spark, sf_dir).select(F.col("s_nationkey").alias("nation"), "cve"), path, "nation")
    back = spark.read.schema("cve string, nation int").json(path)
    return back.groupBy("nation").agg(F.array_join(F.array_sort(F.collect_list("cve")), ",").alias("cves"))


#: Files that a task writes.
FILES = 250


def _bodies(spark, sf_dir, path: str) -> None:
    """A text file for each supplier in a folder of its own below its nation's, written by the tasks that hold the rows."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("id"), F.concat(F.lit("body of "), "s_name", F.lit("\n"), F.col("s_nationkey").cast("string")).alias("value"))
    tasks = rows.count() // FILES + 1  # a number that grows with the files; else a small table's files would all be one task's
    rows.repartition(tasks, "id").write.partitionBy("group", "id").option("lineSep", "\0").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def s9_keyed_files(spark, sf_dir):
    """A folder of files, a file an id."""
    path = scratch(spark, "s9")
    _bodies(spark, sf_dir, path)
    body = F.regexp_replace("body", "\0$", "")
    return readers.keyed_files(spark, f"{path}/*/*/*.txt", "body", r"/id=([^/]+)/[^/]+$").select("id", F.md5(body.cast("binary")).alias("digest"))


def s10_thread_bodies(spark, sf_dir):
    """Bodies by group and thread, looked up by both; a thread without a body keeps none."""
    path = scratch(spark, "s10")
    _bodies(spark, sf_dir, path)
    bodies = readers.thread_bodies(spark, path, r"/group=([^/]+)/", r"/id=([^/]+)/[^/]+$").withColumn("body", F.regexp_replace("body", "\0$", ""))
    threads = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("year_quarter"), F.when(F.col("s_suppkey") % 5 == 0, "none").otherwise(F.col("s_suppkey").cast("string")).alias("thread_id"), "s_suppkey")
    return threads.join(bodies, ["year_quarter", "thread_id"], "left").select("s_suppkey", "year_quarter", "body")


def s17_commit_log(spark, sf_dir):
    """An exported log of all commits, read back as a table of them."""
    path = scratch(spark, "s17")
    k = F.col("p_partkey").cast("string")
    entry = F.concat(F.lit("commit "), F.md5(k.cast("binary")), F.lit("00000000\nAuthor: "), "p_brand", F.lit(" <a@b>\nDate:   today\n\n    fix "), k, F.lit("\n\nM\t"), k, F.lit(".c\n"))
    table(spark, sf_dir, "part").select(entry.alias("value")).write.text(path)
    return readers.commit_log(spark, path).select("hash", "author", "message", F.col("files")[0]["name"].alias("file"))


def k5_files_by_key(spark, sf_dir):
    """The files that belong to a key's records, in the key's folder."""
    path = scratch(spark, "k5")
    records = table(spark, sf_dir, "supplier").select(cve_col(F.col("s_nationkey")).alias("cve"), F.col("s_suppkey").cast("string").alias("id"))
    files = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "_notes.txt").otherwise("_exploit.c")).alias("name"), F.col("p_name").alias("content"))
    sinks.files_by_key(records, files, path, "cve", "id", r"^(\d+)_exploit\.")
    return spark.read.schema("cve string, id string, name string, content string").json(path)


def k7_ledger(spark, sf_dir):
    path = scratch(spark, "k7")
    rows = _suppliers(spark, sf_dir)
    sinks.add_to_ledger(rows.where("s_nationkey % 3 = 0"), path, "cve")
    sinks.add_to_ledger(rows.where("s_nationkey % 3 = 1"), path, "cve")
    return sinks.pending(rows, spark.read.parquet(path), "cve").select("cve", "s_name")


def s11_optional(spark, sf_dir):
    """A source that is not there attaches nothing."""
    none = readers.optional(spark, scratch(spark, "none"), "cve string, note string", readers.csv_text)
    return _suppliers(spark, sf_dir).join(none, "cve", "left").select("cve", "note")


def s12_resumed_increments(spark, sf_dir):
    """Files that come in two runs of one stream; keys that the ledger has are not handed on again."""
    path = scratch(spark, "increments")
    rows = table(spark, sf_dir, "client_changes").where("client_id is not null").select(F.col("client_id").alias("key"), "city")
    source, done, ledger = f"{path}/source", f"{path}/done", f"{path}/ledger"
    for run, part in enumerate((rows.where("key % 3 <> 0"), rows.where("key % 2 = 0"))):
        part.write.mode("append").json(source)
        resume.run_increment(spark, source, "key long, city string", ledger, f"{path}/checkpoint", "key", lambda new, run=run: new.select("key", F.lit(run).alias("run")).write.mode("append").parquet(done))
    return spark.read.parquet(done).select("key", "run")


QUERIES = {f.__name__: f for f in (s1_json_object, s2_json_array, s3_json_mixed, s2_s3_json_records, s4_s6_csv, s6_headless_csv, s7_id_lines, s8_s10_keyed_files, s9_keyed_files, s10_thread_bodies, s17_commit_log, k5_files_by_key, k7_ledger, s11_optional, s12_resumed_increments)}

_C = cve_sql("s_suppkey")
SQL = {
    "s1_json_object": f"SELECT {_C} AS id, s_name, s_nationkey FROM supplier",
    "s2_json_array": f"SELECT {_C} AS cve, s_name, s_nationkey FROM supplier",
    "s3_json_mixed": f"SELECT {_C} AS cve, s_name, s_nationkey FROM supplier",
    "s6_headless_csv": f"SELECT {_C} AS cve, 'a \"q\", ' || s_name AS note FROM supplier",
    "s9_keyed_files": "SELECT CAST(s_suppkey AS VARCHAR) AS id, md5('body of ' || s_name || chr(10) || CAST(s_nationkey AS VARCHAR)) AS digest FROM supplier",
    "s10_thread_bodies": "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS year_quarter, CASE WHEN s_suppkey % 5 <> 0 THEN 'body of ' || s_name || chr(10) || CAST(s_nationkey AS VARCHAR) END AS body FROM supplier",
    "s17_commit_log": "SELECT md5(CAST(p_partkey AS VARCHAR)) || '00000000' AS hash, p_brand || ' <a@b>' AS author, 'fix ' || CAST(p_partkey AS VARCHAR) AS message, CAST(p_partkey AS VARCHAR) || '.c' AS file FROM part",
    "k5_files_by_key": f"SELECT {cve_sql('s_nationkey')} AS cve, CAST(s_suppkey AS VARCHAR) AS id, CAST(p_partkey AS VARCHAR) || '_exploit.c' AS name, p_name AS content FROM supplier JOIN part ON p_partkey = s_suppkey WHERE p_partkey % 3 <> 0",
    "s2_s3_json_records": f"SELECT {_C} AS cve, s_name, s_nationkey FROM supplier",
    "s4_s6_csv": f"SELECT {_C} AS cve, CAST(s_nationkey AS VARCHAR) AS as_text, s_name, s_nationkey FROM supplier",
    "s7_id_lines": f"SELECT {_C} AS id FROM supplier",
    "s8_s10_keyed_files": f"SELECT s_nationkey AS nation, string_agg({_C}, ',' ORDER BY {_C}) AS cves FROM supplier GROUP BY 1",
    "k7_ledger": f"SELECT {_C} AS cve, s_name FROM supplier WHERE s_nationkey % 3 = 2",
    "s12_resumed_increments": "SELECT client_id AS key, CAST(CASE WHEN client_id % 3 <> 0 THEN 0 ELSE 1 END AS INT) AS run FROM client_changes WHERE client_id % 3 <> 0 OR client_id % 2 = 0 GROUP BY client_id",
    "s11_optional": f"SELECT {_C} AS cve, CAST(NULL AS VARCHAR) AS note FROM supplier",
}
