"""Assembly of nested portfolios: places written twice, parts, sources of several shapes, sections that are missing."""

import json

from pyspark.sql import functions as F

from vulnlake.operators import assembly as asm


def records(spark, rows):
    return spark.createDataFrame([(c, s, json.dumps(r)) for c, s, r in rows], "cve string, seq long, j string").select("cve", "seq", F.parse_json("j").alias("record"))


def sources(spark):
    spine = asm.spine_facts(records(spark, [("C1", 1, {"descriptions": [{"value": "old"}]}), ("C1", 2, {"descriptions": [{"value": "new"}], "weaknesses": [{"source": "n", "type": "P", "description": [{"lang": "en", "value": "CWE-1"}]}], "metrics": {"v": 1}, "configurations": [{"nodes": []}, {"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:o:v:p:1"}, {"criteria": "short"}, {}]}]}]}), ("C2", 1, {}), (None, 1, {})]))
    items = asm.item_facts(records(spark, [("C1", 1, {"url": "u1", "title": "a", "kind": "pull"}), ("C1", 3, {"url": "u1", "title": "b", "kind": "pull", "body": "text"}), ("C1", 2, {"url": "u2", "role": "exploit", "summary": "s", "files": [{"path": "x.c", "patch": "+1"}, {"patch": ""}]}), ("OFF", 1, {"url": "u3"}), ("C2", 1, {"url": "u4", "kind": "advisory", "cvss": {"s": 2}, "patch_text": "<html>"})]), "host", scores=True)
    notes = asm.distribution_facts(records(spark, [("C1", 1, {"description": asm.SAME, "notes": "n1", "s": "7"}), ("C2", 1, {"description": "own", "notes": ""})]), "host", ["s"], "notes")
    bugs = asm.bug_facts(spark.createDataFrame([("C1", 5, "b2", "k2", "later", "x", None), ("C1", 1, "b1", "k1", "first", None, "d"), ("C1", 2, "b2", "k1", "mid", "y", "d"), ("C1", 9, "b2", "k2", "last", "x", None)], "cve string, seq long, bug_id string, comment_id string, content string, author string, date string"), "tracker")
    return [spine, items, notes, bugs]


def test_last_writing_wins_and_the_spine_restricts(spark):
    rows = {r["cve"]: r for r in asm.assemble(sources(spark)).select("cve", "description", "cwe", "developer_discussion", "cpe", F.map_keys("cvss").alias("scored"), F.transform_values("patch_set", lambda k, v: F.transform_values(v, lambda u, x: F.to_json(x))).alias("patches"), F.map_keys("exploit_set").alias("exploits")).collect()}
    assert set(rows) == {"C1", "C2"}
    one, two = rows["C1"], rows["C2"]
    assert one["description"] == {"nvd": "new"} and two["description"] == {"host": "own"}
    assert [w["description"][0]["value"] for w in one["cwe"]] == ["CWE-1"] and two["cwe"] == []
    assert dict(one["cpe"]) == {"cpe:2.3:o:v:p:1": one["cpe"]["cpe:2.3:o:v:p:1"]} and one["cpe"]["cpe:2.3:o:v:p:1"]["version"] == "cpe2.3"
    assert json.loads(one["patches"]["host"]["u1"])["title"] == "b" and one["exploits"] == ["host"] and two["exploits"] == []
    host, tracker = one["developer_discussion"]["host"], one["developer_discussion"]["tracker"]
    assert host["value"] == ["n1"] and [(e["url"], e["title"], e["type"]) for e in host["entries"]] == [("u2", None, "bulletin"), ("u1", "b", "pull")]
    assert [(b["bug_id"], [c["content"] for c in b["comments"]]) for b in tracker["bugs"]] == [("b1", ["first"]), ("b2", ["mid", "last"])]
    assert sorted(one["scored"]) == ["host", "nvd"]


def test_parts_share_the_items_and_give_the_same_documents(spark):
    for catalogue in asm.CATALOGUES:
        whole = asm.documents(asm.assemble(sources(spark)), catalogue).select("cve", "source", "text").collect()
        if catalogue == "advisory":
            parts = asm.assemble(sources(spark), parts=5)
            assert parts.select("part").distinct().count() > 1
            assert sorted(map(str, asm.documents(parts, catalogue).select("cve", "source", "text").collect())) == sorted(map(str, whole))
            texts = {(r["cve"], r["source"]): r["text"] for r in whole}
            assert texts["C1", "patch:host"] == "[PATCH from host] u1\ntitle: b\nbody: text"
            assert texts["C1", "exploit code:host"] == "[EXPLOIT CODE]\n--- x.c\n+1" and ("C2", "patch diff:host") not in texts
            assert texts["C1", "host:bulletin"] == "summary: s\nurl: u2" and texts["C1", "cpe"] == "Affected CPEs:\ncpe:2.3:o:v:p:1"
        assert all(r["text"] for r in whole)


def test_one_shuffle_and_no_join(spark):
    plan = asm.assemble(sources(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_code_blocks_of_every_shape(spark):
    rows = records(spark, [(str(i), 1, {"Vulnerable code block": b} if b is not None else {"File": "x"}) for i, b in enumerate(["t", ["a", ["b", "c"], {"k": "d"}], {"f": "e", "g": "h"}, [], None])])
    location = F.try_variant_get("record", "$", "map<string,variant>")
    found = {r[0]: r[1] for r in rows.select("cve", asm.code_blocks(location)).collect()}
    assert found == {"0": ["t"], "1": ["a", "b", "c", "d"], "2": ["e", "h"], "3": [], "4": []}


def test_no_sources_of_a_cve_and_empty_tables(spark):
    empty = [s.limit(0) for s in sources(spark)]
    assert asm.assemble(empty).count() == 0 and asm.documents(asm.assemble(empty), "kernel").count() == 0
