"""Readers and writers on small files, and the resumable stream."""

import json

from vulnlake.sources import external, readers, sinks
from vulnlake.streaming import resume


def test_json_readers(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"CVE-1": {"a": 1}, "CVE-2": {"a": 2}}))
    (tmp_path / "a.json").write_text(json.dumps([{"a": 3}, {"a": 4}]))
    assert {r["id"]: r["record"]["a"] for r in readers.json_object(spark, f"{tmp_path}/o.json", "struct<a:int>").collect()} == {"CVE-1": 1, "CVE-2": 2}
    assert sorted(r["a"] for r in readers.json_array(spark, f"{tmp_path}/a.json", "a int").collect()) == [3, 4]
    assert sorted(r["a"] for r in readers.json_mixed(spark, f"{tmp_path}/*.json", "struct<a:int>").collect()) == [1, 2, 3, 4]
    assert {r["id"] for r in readers.keyed_files(spark, f"{tmp_path}/*.json").collect()} == {"o", "a"}


def test_text_and_csv_readers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" cve-1 \n\ncve-2\ncve-1\n")
    (tmp_path / "h.csv").write_text('a,b\n1,"x, ""y"""\n')
    assert sorted(r["id"] for r in readers.id_lines(spark, f"{tmp_path}/ids.txt", upper=True, distinct=True).collect()) == ["CVE-1", "CVE-2"]
    assert readers.id_lines(spark, f"{tmp_path}/ids.txt").count() == 3
    assert readers.csv_text(spark, f"{tmp_path}/h.csv").first().asDict() == {"a": "1", "b": 'x, "y"'}
    assert readers.csv_typed(spark, f"{tmp_path}/h.csv", "a int, b string").first()["a"] == 1
    assert readers.csv_headless(spark, f"{tmp_path}/h.csv", ["p", "q"]).count() == 2
    quarter = tmp_path / "m" / "2020_Q1"
    quarter.mkdir(parents=True)
    (quarter / "17.txt").write_text("body\nmore")
    assert readers.thread_bodies(spark, f"{tmp_path}/m").first().asDict() == {"year_quarter": "2020_Q1", "thread_id": "17", "body": "body\nmore"}
    assert readers.optional(spark, f"{tmp_path}/none", "a int", readers.csv_text).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("CVE-1", 1, 'x "q"'), ("CVE-1", 2, "y"), ("CVE-2", 3, None)], "cve string, n int, t string")
    sinks.by_key(df, f"{tmp_path}/k", "cve")
    assert sorted(p.name for p in (tmp_path / "k").iterdir() if p.is_dir()) == ["cve=CVE-1", "cve=CVE-2"]
    sinks.csv(df, f"{tmp_path}/c")
    sinks.csv(df.limit(1), f"{tmp_path}/c", "append")
    assert readers.csv_text(spark, f"{tmp_path}/c").count() == 4
    sinks.json_rows(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    sinks.add_to_ledger(df.where("n = 1"), f"{tmp_path}/l", "cve")
    assert [r["cve"] for r in sinks.pending(df, spark.read.parquet(f"{tmp_path}/l"), "cve").collect()] == ["CVE-2"]


def test_increments_resume(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    run = lambda: resume.run_increment(spark, str(source), "cve string, v int", f"{tmp_path}/ledger", f"{tmp_path}/cp", "cve", lambda df: seen.extend(r["cve"] for r in df.collect()))
    (source / "1.json").write_text('{"cve": "a", "v": 1}\n{"cve": "b", "v": 1}\n{"cve": "a", "v": 2}')
    run()
    (source / "2.json").write_text('{"cve": "b", "v": 3}\n{"cve": "c", "v": 3}')
    run()
    run()
    assert sorted(seen) == ["a", "b", "c"]


def test_external_interfaces(spark):
    waits = []

    def flaky(key, seen={}):  # noqa: B006
        seen[key] = seen.get(key, 0) + 1
        if seen[key] < 3:
            raise OSError
        return f"page of {key}"

    tried = external.with_retries(flaky, 4, 1.0, sleep=waits.append)
    assert tried("a") == "page of a" and waits == [1.0, 2.0]
    assert external.with_retries(lambda k: 1 / 0, 2, sleep=waits.append)("a") is None
    df = spark.createDataFrame([("x",), (None,)], "k string")
    assert {r["content"] for r in external.fetch(df, "k", lambda k: None if k is None else k * 2).collect()} == {"xx", None}
    assert {r["answer"] for r in external.ask(df, "k", lambda batch: [f"a {p}" for p in batch]).collect()} == {"a x", "a "}
