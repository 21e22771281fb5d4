"""Diffs, patches, C bodies and ragged lists on cases that the tables don't hold."""

import difflib
import json
import random

from pyspark.sql import functions as F

from vulnlake.functions import code
from vulnlake.functions.ragged import flat_strings, list_depth

NO_END = "\\ No newline at end of file\n"


def unified(before, after, context):
    """A diff as a version control system writes it."""
    rows = difflib.unified_diff(before.splitlines(True), after.splitlines(True), "a/f", "b/f", n=context)
    return "diff --git a/f b/f\n" + "".join(r if r.endswith("\n") else r + "\n" + NO_END for r in rows)


def test_applied_patches_are_the_after_text_and_back(spark):
    r = random.Random(4)
    rows = []
    for i in range(300):
        before = [r.choice("abc-+ @") * r.randint(0, 3) for _ in range(r.randint(0, 30))]
        after = [x for x in before if r.random() > 0.15]
        for _ in range(r.randint(0, 4)):
            after.insert(r.randint(0, len(after)), r.choice(["new", "-- x", "++ y", "", "@@ -1 +1 @@"]))
        ends = lambda ls: "\n".join(ls) + ("\n" if ls and r.random() < 0.6 else "")
        b, a = ends(before), ends(after)
        rows.append((i, b, a, unified(b, a, r.randint(0, 3))))
    df = spark.createDataFrame(rows, "i int, before string, after string, diff string").withColumn("f", F.get(code.file_changes(F.col("diff")), 0))
    df = df.withColumn("made", code.apply_hunks(F.col("before"), F.col("f.hunks"))).withColumn("back", code.apply_hunks(F.col("after"), F.col("f.hunks"), True))
    for x in df.collect():
        assert x["made"] == x["after"] and x["back"] == x["before"], x


def test_patches_that_do_not_fit_and_files_of_every_status(spark):
    diff = "\n".join(["From: x", "diff --git a/a.c b/a.c", "deleted file mode 100644", "--- a/a.c", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-one", "--- two", "diff --git a/b.c b/b.c", "new file mode 100644", "index 0..1", "diff --git a/c.c b/d.c", "similarity index 90%", "rename from c.c", "rename to d.c", "--- a/c.c", "+++ b/d.c", "@@ -2 +2,2 @@ void f(int a)", "-x", "+y", "+z", "", "-- ", "2.40"])
    df = spark.createDataFrame([(diff,), (None,), ("",), ("no diff",)], "diff string").select(code.file_changes(F.col("diff")).alias("f"))
    files = [r["f"] for r in df.collect()]
    assert files[1] is None and files[2] == [] and files[3] == []
    assert [(f["old_path"], f["new_path"], f["status"], len(f["hunks"])) for f in files[0]] == [("a.c", None, "D", 1), (None, "b.c", "A", 0), ("c.c", "d.c", "R", 1)]
    assert files[0][0]["hunks"][0]["lines"] == ["-one", "--- two"] and files[0][2]["hunks"][0]["lines"] == ["-x", "+y", "+z"]
    assert files[0][2]["hunks"][0]["section"] == "void f(int a)" and files[0][2]["hunks"][0]["old_len"] == 1
    rows = spark.createDataFrame([("w\nx\n", 0), ("w\nq\n", 1), ("w", 2), (None, 3), ("one\n-- two\n", 4)], "before string, i int")
    both = rows.crossJoin(F.broadcast(df.limit(1)))
    out = {r["i"]: (r["moved"], r["gone"]) for r in both.select("i", code.apply_hunks(F.col("before"), F.col("f")[2]["hunks"]).alias("moved"), code.apply_hunks(F.col("before"), F.col("f")[0]["hunks"]).alias("gone")).collect()}
    assert out == {0: ("w\ny\nz\n", None), 1: (None, None), 2: (None, None), 3: (None, None), 4: (None, "")}


def test_bodies_of_odd_sources(spark):
    cases = {"int f() {\n}": "int f() {\n}", "int f();": None, "": None, "{ /* } \n": None, "} {\n}": "} {", "{ } {\n} x\n}": "{ } {\n} x", 's = "{"; {\n}\n': 's = "{"; {\n}', "{ '\n}\n": "{ '\n}", "// {\n{ // }\n}": "// {\n{ // }\n}", "{\n} /* a\nb */": "{\n} /* a", "{" * 3000 + "\n" + "}" * 3000 + "\nx": "{" * 3000 + "\n" + "}" * 3000, '{ "' + "x\\\"" * 20_000 + '" }\n': '{ "' + "x\\\"" * 20_000 + '" }'}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", code.balanced_lines(F.col("s")).alias("b"), code.function_body(F.col("s"), F.lit(9)).alias("none"))
    for r in df.collect():
        assert r["b"] == cases[r["s"]], (r["s"][:50], r["b"])
        assert r["none"] is None
    assert spark.createDataFrame([(None,)], "s string").select(code.balanced_lines(F.col("s"))).first()[0] is None


def test_ragged_lists(spark):
    deep = ["x"]
    for _ in range(12):
        deep = [deep, "y"]
    cases = [["a", ["b", ["c", "", 5, None, {"k": ["no"]}, True]], []], deep, [], "text", {"a": ["b"]}, ["[", "]]", '"', "\\"], None]
    want = [["a", "b", "c"], ["x"] + ["y"] * 12, [], [], [], ["[", "]]", '"', "\\"], []]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(7, None), (8, "[broken")], "i int, j string")
    assert {r["i"]: r["flat"] for r in flat_strings(df, "j").collect()} == dict(enumerate([*want, [], []]))
    assert df.select(list_depth(F.col("j"))).where("i = 1").first()[0] == 13
    assert flat_strings(df.limit(0), "j").count() == 0
