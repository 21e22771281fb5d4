"""Queries of portfolio assembly and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.operators import portfolio as pf
from vulnlake.plans.evaluation import cve_col, cve_sql
from vulnlake.session import table

_C = cve_sql("c_custkey")
_O = cve_sql("o_custkey")


def _spine(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(cve_col(F.col("c_custkey")).alias("cve"), F.concat(F.lit("flaw "), F.col("c_name")).alias("nvd"), "c_acctbal")


def _redhat(spark, sf_dir):
    """One row an order; the last order of a CVE wins.  Some are off the spine."""
    o = table(spark, sf_dir, "orders").select(cve_col(F.col("o_custkey") + 700).alias("cve"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("impact"), "o_totalprice")
    return pf.last_wins(o, "cve", "seq")


def j1_j2_portfolio(spark, sf_dir):
    """The spine with what the other source has of it."""
    return pf.attach(_spine(spark, sf_dir), _redhat(spark, sf_dir)).select("cve", "nvd", "impact", "seq")


def a22_last_wins(spark, sf_dir):
    return _redhat(spark, sf_dir).select("cve", "seq", "impact")


def a23_first_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return pf.first_wins(e, "user_id", "event_id")


def j3_inner(spark, sf_dir):
    return _spine(spark, sf_dir).join(_redhat(spark, sf_dir), "cve").select("cve", "c_acctbal", "o_totalprice")


def j6_url_lookup(spark, sf_dir):
    """Rows that look a dimension up by address; of equal addresses the last counts."""
    url = lambda k: F.concat(F.lit("https://lists.example.org/"), k.cast("string"))
    dim = pf.last_wins(table(spark, sf_dir, "part").select(url(F.col("p_partkey") % 300).alias("url"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("subject")), "url", "seq")
    return table(spark, sf_dir, "supplier").select("s_suppkey", url(F.col("s_suppkey")).alias("url")).join(dim, "url").select("s_suppkey", "url", "subject")


def j7_j8_composite(spark, sf_dir):
    """Functions by (cve, commit, file); a CVE's text cuts long numbers, so the number itself is met beside it."""
    li = table(spark, sf_dir, "lineitem")
    have = li.select(F.col("l_orderkey").alias("number"), cve_col(F.col("l_orderkey")).alias("cve"), F.col("l_partkey").alias("commit"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("file"), "l_quantity")
    want = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("number"), cve_col(F.col("o_orderkey")).alias("cve"), F.explode(F.array(F.lit("f1"), F.lit("f2"))).alias("file"))
    return want.join(have, ["number", "cve", "file"]).select("cve", "commit", "file", "l_quantity")


def j11_file_join(spark, sf_dir):
    """Files named <id>_exploit.<ext> under their records."""
    files = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "_other.txt").otherwise("_exploit.c")).alias("name"), "p_size")
    files = files.select(F.regexp_extract("name", r"^(\d+)_exploit\.", 1).alias("id"), "name", "p_size").where("id <> ''")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id")).join(files, "id").select("id", "name", "p_size")


def j12_patched_prefix(spark, sf_dir):
    """A file belongs to one CVE, however many records of the spine name it."""
    files = table(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "P").otherwise(""), cve_col(F.col("c_custkey"))).alias("name"), "c_acctbal")
    return _spine(spark, sf_dir).select("cve", F.concat(F.lit("P"), "cve").alias("name")).distinct().join(files, "name").select("cve", "name", "c_acctbal")


def j10_sorted_pairs(spark, sf_dir):
    """Two score tables joined on the CVE, not on their positions."""
    a = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("h"))
    b = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 5).alias("m"))
    return a.join(b, "c_custkey").select("c_custkey", F.abs(F.col("h") - F.col("m")).alias("d"))


def p1_p3_descriptions(spark, sf_dir):
    k = F.col("c_custkey")
    d = lambda lang, v: F.struct(F.lit(lang).alias("lang"), v.alias("value"))
    rows = F.when(k % 3 == 0, F.array(d("es", F.lit("hola")), d("en", F.col("c_name")))).when(k % 3 == 1, F.array(d("en", F.col("c_mktsegment")))).otherwise(F.array(d("fr", F.lit("non"))))
    return table(spark, sf_dir, "customer").select("c_custkey", rows.alias("d")).select("c_custkey", F.try_element_at("d", F.lit(1))["value"].alias("first"), pf.english(F.col("d")).alias("english"))


def p5_safe_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("missing"))


def p6_cpe(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    cpe = F.when(F.col("p_partkey") % 5 == 0, "cpe:2.3:a").otherwise(F.concat(F.lit("cpe:2.3:o:"), F.col("p_brand"), F.lit(":tool:"), k, F.lit(":*:*")))
    return table(spark, sf_dir, "part").select("p_partkey", pf.cpe_parts(cpe).alias("c")).where("c is not null").select("p_partkey", "c.*")


def p7_cvss_record(spark, sf_dir):
    k = F.col("o_orderkey")
    nested = F.when(k % 2 == 0, F.struct((k % 10).cast("string").alias("score"), F.lit("AV:N").alias("vector"), F.lit("").alias("severity")))
    flat = F.struct(F.lit("5").alias("score"), F.lit("").alias("vector"), F.col("o_orderpriority").alias("severity"))
    return table(spark, sf_dir, "orders").select("o_orderkey", pf.cvss_block(nested, flat).alias("b")).select("o_orderkey", "b.*")


def _payloads(spark, sf_dir):
    """An update guide's JSON payloads, flat or nested, with fields under either of their names or without them."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit('{"'), F.when(k % 2 == 0, "title").otherwise("cveTitle"), F.lit('":"flaw '), k.cast("string"), F.lit('","description":"","executiveSummary":"'), F.col("p_type"),
        F.lit('","impact":null,"cweList":["CWE-'), (k % 9).cast("string"), F.lit('"],'),
        F.when(k % 3 == 0, F.concat(F.lit('"cvssScoreSets":[{"score":'), (k % 10).cast("string"), F.lit('.5,"vectorString":"AV:N"}]'))).otherwise(F.concat(F.lit('"baseScore":'), (k % 10).cast("string"), F.lit(',"severity":"Low"'))),
        F.lit(',"affectedProducts":[{"productName":"'), F.col("p_brand"), F.lit('","platform":"x","versions":["1","'), k.cast("string"), F.lit('"]},"odd"],"kbArticles":[{"id":"KB'), k.cast("string"), F.lit('","downloadUrl":"https://example.org/'), k.cast("string"),
        F.lit('"}],"references":["https://example.org/r",{"href":"https://example.org/'), k.cast("string"), F.lit('","title":"t"}],"publiclyDisclosed":'), F.when(k % 4 == 0, "true").otherwise("null"), F.lit(',"releasedDate":"2020-01-0'), (k % 9 + 1).cast("string"), F.lit('"}'),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand").repartition("p_partkey")  # payloads cost more than the file's few splits can share
    return part.select("p_partkey", cve_col(k).alias("cve"), text.alias("payload"))


def p9_guide_record(spark, sf_dir):
    """The update guide's record; null fields are left out of its JSON."""
    rows = _payloads(spark, sf_dir).select("p_partkey", pf.guide_record(F.col("cve"), F.col("payload")).alias("r"))
    return rows.select("p_partkey", "r.url", "r.title", "r.description", "r.impact", F.col("r.cvss.base_score").alias("base_score"), F.col("r.cvss.vector").alias("vector"), F.col("r.cvss.severity").alias("severity"), F.array_join("r.cwe", ",").alias("cwe"), "r.exploited", "r.publicly_disclosed", "r.release_date", F.size(F.expr("json_object_keys(to_json(r))")).alias("filled"))


def p8_products(spark, sf_dir):
    """Normalised products, remediations and references; what is no record is left out, a plain address is a reference."""
    p = F.from_json("payload", "map<string,string>")
    rows = _payloads(spark, sf_dir).select("p_partkey", p.alias("p")).select("p_partkey", pf.product_list(F.col("p")).alias("a"), pf.remediation_list(F.col("p")).alias("m"), pf.reference_list(F.col("p")).alias("f"))
    text = lambda c, f: F.array_join(F.transform(c, f), ";")
    return rows.select("p_partkey", text("a", lambda x: F.concat_ws("|", x["name"], x["platform"], F.array_join(x["versions"], "+"))).alias("products"), text("m", lambda x: F.concat_ws("|", x["kb"], x["url"])).alias("remediations"), text("f", lambda x: F.concat_ws("|", x["url"], x["label"])).alias("references"))


_ITEM_KINDS = ["commit", "pull", "issue", "advisory", "release", "repo", "compare"]
#: Made payloads of each kind; {k} is a key, {t} a text, {m} true or false.
_ITEM_PAYLOADS = [
    '{"sha":"a{k}","commit":{"message":"{t}\\nmore of {k}","author":{"name":"A{k}","email":"a@b","date":"2020"}},"files":[{"filename":"{k}.c","status":"modified","additions":{k},"patch":"+x"}]}',
    '{"title":"{t}","body":"b{k}","state":"closed","merged":{m},"merged_at":null,"user":{"login":"u{k}"},"labels":[{"name":"bug"},{"name":"{t}"}],"head":{"sha":"h{k}"}}',
    '{"title":"{t}","state":"open","user":null,"labels":[],"closed_at":"2021"}',
    '{"ghsa_id":"GHSA-{k}","summary":"","title":"{t}","description":"d{k}","severity":"high","cwe_ids":["CWE-{k}"],"references":["r{k}"]}',
    '{"tag_name":"v{k}","name":"{t}","body":"notes"}',
    '{"full_name":"o/{k}","description":"{t}","stargazers_count":{k},"language":"C"}',
    '{"any":"{k}"}',
]


def p10_p11_item_kinds(spark, sf_dir):
    """A record of each kind of item, from its payload."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, _ITEM_KINDS)), (k % 7 + 1).cast("int"))
    payload = F.element_at(F.array(*map(F.lit, _ITEM_PAYLOADS)), (k % 7 + 1).cast("int"))
    for mark, value in (("{k}", k.cast("string")), ("{t}", F.col("o_orderpriority")), ("{m}", F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("false"))):
        payload = F.replace(payload, F.lit(mark), value)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), payload.alias("payload"))
    r = rows.select("o_orderkey", "kind", pf.item_record(F.col("kind"), F.col("payload")).alias("r"))
    return r.select("o_orderkey", "kind", "r.title", "r.body", "r.state", "r.author", "r.date", F.array_join("r.labels", ",").alias("labels"), "r.sha", F.col("r.files")[0]["path"].alias("path"), "r.severity", F.array_join("r.cwe_ids", ",").alias("cwe"), "r.name", "r.tag_name", "r.stars", "r.raw")


def p12_p13_metric_and_cwe(spark, sf_dir):
    k = F.col("o_orderkey")
    v = lambda test, name: F.when(test, F.array(F.lit(name), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    metric = pf.primary_metric(v(k % 5 == 0, "V40"), v(k % 3 == 0, "V31"), v(k % 2 == 0, "V30"), v(k % 7 == 0, "V2"))
    w = lambda *names: F.struct(F.array(*[F.struct(F.lit(n).alias("value")) for n in names]).alias("description"))
    weak = F.when(k % 3 == 0, F.array(w("CWE-1", "CWE-2"), w("CWE-1"))).when(k % 3 == 1, F.array(w("CWE-9")))
    return table(spark, sf_dir, "orders").select("o_orderkey", metric.alias("metric"), pf.cwe_values(weak).alias("cwe"))


def p14_p16_renamed(spark, sf_dir):
    """Lookup with a fallback to the value itself, a split once, a conditional overwrite."""
    dim = spark.createDataFrame([("BUILDING", "b"), ("MACHINERY", "m")], "seg string, short string")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.split(F.concat_ws("_", "c_mktsegment", "c_name"), "_", 2)[1].alias("rest"))
    return rows.join(F.broadcast(dim), "seg", "left").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "x").otherwise(F.coalesce("short", "seg")).alias("label"), "rest")  # two rows


def r11_discussions(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ["pull", "commit", "bulletin", "advisory"])), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(cve_col(F.col("o_custkey")).alias("cve"), kind.alias("kind"), k.alias("pos"), F.col("o_orderpriority").alias("title"), F.when(k % 3 == 0, "s").otherwise("").alias("summary"), F.lit("").alias("details"))
    return pf.discussion(rows).select("cve", F.array_join(F.transform("entries", lambda e: F.concat(e["kind"], F.lit(":"), e["title"])), ";").alias("entries"))


def r12_roles(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(cve_col(F.col("o_custkey")).alias("cve"), F.when(k % 3 == 0, "exploit").when(k % 3 == 1, "patch").alias("role"), k.cast("string").alias("item"), F.col("o_orderpriority").alias("record"))
    return pf.by_role(rows).select("cve", F.array_join(F.array_sort(F.map_keys("patch_set")), ",").alias("patches"), F.array_join(F.array_sort(F.map_keys("exploit_set")), ",").alias("exploits"))


def w3_positions(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).alias("pos"))


def a1_grouped_records(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    return rows.select("o_custkey", F.array_join(F.transform("r", lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("records"))


def t4_slice(spark, sf_dir):
    """Rows start to end of the order of an explicit sequence column, without a global window."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey")
    return o.offset(100).limit(400)


def t7_sorted_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


def s12_windows(spark, sf_dir):
    from vulnlake.sources.readers import windows

    return windows(spark, "2020-01-01 00:00:00", "2021-01-01 00:00:00")


def s18_pages(spark, sf_dir):
    from vulnlake.sources.readers import pages

    return pages(spark, 22395, 100)


QUERIES = {f.__name__: f for f in (j1_j2_portfolio, a22_last_wins, a23_first_wins, j3_inner, j6_url_lookup, j7_j8_composite, j11_file_join, j12_patched_prefix, j10_sorted_pairs, p1_p3_descriptions, p5_safe_path, p6_cpe, p7_cvss_record, p8_products, p9_guide_record, p10_p11_item_kinds, p12_p13_metric_and_cwe, p14_p16_renamed, r11_discussions, r12_roles, w3_positions, a1_grouped_records, t4_slice, t7_sorted_distinct, s12_windows, s18_pages)}

_RH = f"(SELECT {cve_sql('(o_custkey + 700)')} AS cve, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS impact, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1)"
_SPINE = f"(SELECT {_C} AS cve, 'flaw ' || c_name AS nvd, c_acctbal FROM customer)"



def _sql_list(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


_K = "CAST(p_partkey AS VARCHAR)"
_PAYLOADS = f"""(SELECT p_partkey, CAST('{{"' || CASE WHEN p_partkey % 2 = 0 THEN 'title' ELSE 'cveTitle' END || '":"flaw ' || {_K} || '","description":"","executiveSummary":"' || p_type || '","impact":null,"cweList":["CWE-' || CAST(p_partkey % 9 AS VARCHAR) || '"],'
 || CASE WHEN p_partkey % 3 = 0 THEN '"cvssScoreSets":[{{"score":' || CAST(p_partkey % 10 AS VARCHAR) || '.5,"vectorString":"AV:N"}}]' ELSE '"baseScore":' || CAST(p_partkey % 10 AS VARCHAR) || ',"severity":"Low"' END
 || ',"affectedProducts":[{{"productName":"' || p_brand || '","platform":"x","versions":["1","' || {_K} || '"]}},"odd"],"kbArticles":[{{"id":"KB' || {_K} || '","downloadUrl":"https://example.org/' || {_K}
 || '"}}],"references":["https://example.org/r",{{"href":"https://example.org/' || {_K} || '","title":"t"}}],"publiclyDisclosed":' || CASE WHEN p_partkey % 4 = 0 THEN 'true' ELSE 'null' END || ',"releasedDate":"2020-01-0' || CAST(p_partkey % 9 + 1 AS VARCHAR) || '"}}' AS JSON) AS j FROM part)"""

SQL = {
    "j1_j2_portfolio": f"SELECT cve, nvd, impact, seq FROM {_SPINE} LEFT JOIN {_RH} USING (cve)",
    "a22_last_wins": f"SELECT cve, seq, impact FROM {_RH}",
    "a23_first_wins": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id",
    "j3_inner": f"SELECT cve, c_acctbal, o_totalprice FROM {_SPINE} JOIN {_RH} USING (cve)",
    "j6_url_lookup": "WITH d AS (SELECT p_partkey % 300 AS k, arg_max(p_name, p_partkey) AS subject FROM part GROUP BY 1) SELECT s_suppkey, 'https://lists.example.org/' || CAST(s_suppkey AS VARCHAR) AS url, subject FROM supplier JOIN d ON k = s_suppkey",
    "j7_j8_composite": f"SELECT {cve_sql('l_orderkey')} AS cve, l_partkey AS commit, 'f' || CAST(l_linenumber AS VARCHAR) AS file, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber IN (1, 2) AND o_orderkey % 3 = 0",
    "j11_file_join": "SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(p_partkey AS VARCHAR) || '_exploit.c' AS name, p_size FROM supplier JOIN part ON p_partkey = s_suppkey WHERE p_partkey % 4 <> 0",
    "j12_patched_prefix": f"SELECT {_C} AS cve, 'P' || {_C} AS name, c_acctbal FROM customer WHERE c_custkey % 2 = 0",
    "j10_sorted_pairs": "SELECT c_custkey, abs(c_custkey % 5 - c_custkey * 7 % 5) AS d FROM customer",
    "p1_p3_descriptions": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'hola' WHEN 1 THEN c_mktsegment ELSE 'non' END AS first, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS english FROM customer",
    "p5_safe_path": "SELECT event_id, coalesce(props ->> '$.k', '0') AS k, coalesce(props ->> '$.a.b', 'none') AS missing FROM events",
    "p6_cpe": "SELECT p_partkey, 'cpe:2.3:o:' || p_brand || ':tool:' || CAST(p_partkey AS VARCHAR) || ':*:*' AS cpe, 'cpe2.3' AS version, p_brand AS vendor, 'tool' AS product, CAST(p_partkey AS VARCHAR) AS product_version FROM part WHERE p_partkey % 5 <> 0",
    "p7_cvss_record": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 10 AS VARCHAR) ELSE '5' END AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'AV:N' END AS vector, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS severity FROM orders",
    "p8_products": f"SELECT p_partkey, (j ->> '$.affectedProducts[0].productName') || '|x|' || (j ->> '$.affectedProducts[0].versions[0]') || '+' || (j ->> '$.affectedProducts[0].versions[1]') AS products, (j ->> '$.kbArticles[0].id') || '|' || (j ->> '$.kbArticles[0].downloadUrl') AS remediations, (j ->> '$.references[0]') || ';' || (j ->> '$.references[1].href') || '|' || (j ->> '$.references[1].title') AS \"references\" FROM {_PAYLOADS}",
    "p9_guide_record": f"""SELECT p_partkey, 'https://msrc.microsoft.com/update-guide/vulnerability/' || {cve_sql('p_partkey')} AS url, coalesce(j ->> '$.title', j ->> '$.cveTitle') AS title, coalesce(nullif(j ->> '$.description', ''), j ->> '$.executiveSummary') AS description, j ->> '$.impact' AS impact,
 coalesce(j ->> '$.cvssScoreSets[0].score', j ->> '$.baseScore') AS base_score, j ->> '$.cvssScoreSets[0].vectorString' AS vector, j ->> '$.severity' AS severity, j ->> '$.cweList[0]' AS cwe, coalesce(j ->> '$.publiclyDisclosed', 'false') AS exploited, j ->> '$.publiclyDisclosed' AS publicly_disclosed, j ->> '$.releasedDate' AS release_date,
 CAST(15 + CASE WHEN j ->> '$.publiclyDisclosed' = 'true' THEN 1 ELSE 0 END AS INTEGER) AS filled FROM {_PAYLOADS}""",
    "p10_p11_item_kinds": f"""WITH r AS (SELECT o_orderkey, o_orderkey % 7 AS i, replace(replace(replace({_sql_list(_ITEM_PAYLOADS)}[CAST(o_orderkey % 7 AS INTEGER) + 1], '{{k}}', CAST(o_orderkey AS VARCHAR)), '{{t}}', o_orderpriority), '{{m}}', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END) AS t FROM orders), p AS (SELECT *, CAST(t AS JSON) AS j FROM r)
SELECT o_orderkey, {_sql_list(_ITEM_KINDS)}[CAST(i AS INTEGER) + 1] AS kind,
 CASE i WHEN 0 THEN string_split(j ->> '$.commit.message', chr(10))[1] WHEN 1 THEN j ->> '$.title' WHEN 2 THEN j ->> '$.title' WHEN 3 THEN coalesce(nullif(j ->> '$.summary', ''), j ->> '$.title') END AS title,
 CASE i WHEN 0 THEN j ->> '$.commit.message' WHEN 1 THEN j ->> '$.body' WHEN 2 THEN j ->> '$.body' WHEN 3 THEN j ->> '$.description' WHEN 4 THEN j ->> '$.body' WHEN 5 THEN j ->> '$.description' END AS body,
 CASE i WHEN 1 THEN CASE WHEN j ->> '$.merged' = 'true' THEN 'merged' ELSE j ->> '$.state' END WHEN 2 THEN j ->> '$.state' END AS state,
 CASE i WHEN 0 THEN j ->> '$.commit.author.name' ELSE j ->> '$.user.login' END AS author,
 CASE i WHEN 0 THEN j ->> '$.commit.author.date' WHEN 1 THEN j ->> '$.merged_at' WHEN 2 THEN j ->> '$.closed_at' END AS date,
 CASE WHEN i IN (1, 2) THEN array_to_string(coalesce(j ->> '$.labels[*].name', []), ',') END AS labels,
 CASE i WHEN 0 THEN j ->> '$.sha' WHEN 1 THEN j ->> '$.head.sha' END AS sha, j ->> '$.files[0].filename' AS path, j ->> '$.severity' AS severity, j ->> '$.cwe_ids[0]' AS cwe,
 CASE i WHEN 4 THEN j ->> '$.name' WHEN 5 THEN j ->> '$.full_name' END AS name, j ->> '$.tag_name' AS tag_name, CAST(j ->> '$.stargazers_count' AS BIGINT) AS stars, CASE WHEN i = 6 THEN t END AS raw FROM p""",
    "p12_p13_metric_and_cwe": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'V40' WHEN o_orderkey % 3 = 0 THEN 'V31' WHEN o_orderkey % 2 = 0 THEN 'V30' WHEN o_orderkey % 7 = 0 THEN 'V2' END AS metric, CASE o_orderkey % 3 WHEN 0 THEN 'CWE-1, CWE-2' WHEN 1 THEN 'CWE-9' ELSE 'Not given' END AS cwe FROM orders",
    "p14_p16_renamed": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'x' WHEN c_mktsegment = 'BUILDING' THEN 'b' WHEN c_mktsegment = 'MACHINERY' THEN 'm' ELSE c_mktsegment END AS label, c_name AS rest FROM customer",
    "r11_discussions": f"SELECT {_O} AS cve, string_agg(k || ':' || o_orderpriority, ';' ORDER BY o_orderkey) AS entries FROM (SELECT *, ['pull', 'commit', 'bulletin', 'advisory'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS k FROM orders) WHERE k IN ('pull', 'advisory') OR (k = 'bulletin' AND o_orderkey % 3 = 0) GROUP BY 1",
    "r12_roles": f"SELECT {_O} AS cve, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey % 3 <> 0), '') AS patches, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey % 3 = 0), '') AS exploits FROM orders GROUP BY 1",
    "w3_positions": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders",
    "a1_grouped_records": "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || o_orderstatus, ',' ORDER BY o_orderkey) AS records FROM orders GROUP BY 1",
    "t4_slice": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 400 OFFSET 100",
    "t7_sorted_distinct": "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1",
    "s12_windows": "SELECT s AS start, least(s + INTERVAL 120 DAY, TIMESTAMP '2021-01-01') AS \"end\" FROM (SELECT unnest(generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2021-01-01', INTERVAL 120 DAY)) AS s) WHERE s < TIMESTAMP '2021-01-01'",
    "s18_pages": "SELECT o AS \"offset\", least(100, 22395 - o) AS n FROM (SELECT unnest(range(0, 22395, 100)) AS o)",
}
