"""Queries of scalar text, commit and diff functions on made and given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions import code
from vulnlake.functions import text as tx
from vulnlake.plans.evaluation import cve_col, cve_sql
from vulnlake.session import table

_S = "CAST(o_orderkey AS VARCHAR)"


def _key():
    return F.col("o_orderkey").cast("string")


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders")


def c1_strip_case(spark, sf_dir):
    raw = F.concat(F.lit("  \t"), F.col("o_orderpriority"), F.lit(": \n"))
    t = tx.strip(raw)
    return _orders(spark, sf_dir).select("o_orderkey", t.alias("stripped"), F.lower(t).alias("low"), F.upper(t).alias("up"), F.regexp_replace(t, ":+$", "").alias("bare"))


def c2_collapse_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.collapse_space(F.col("text")).cast("binary")).alias("digest"))


def c3_same_as_nvd(spark, sf_dir):
    nvd = F.concat(F.lit("a flaw in "), _key())
    other = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("a  flaw\nin "), _key())).otherwise(F.concat(F.lit("another flaw "), _key()))
    return _orders(spark, sf_dir).select("o_orderkey", tx.same_as_or_self(other, nvd).alias("description"))


def c4_without_prefix(spark, sf_dir):
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Description:  "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    return _orders(spark, sf_dir).select("o_orderkey", tx.without_prefix(t, "Description:").alias("t"))


#: Lines of made commit messages.
_MESSAGE = ["net: fix {k}", "", "Signed-off-by: A <a@example.org>", "  body of {k}", "commit 0123456789012345678901234567890123456789", "Cc: b"]


def c5_commit_message(spark, sf_dir):
    picked = [F.when(F.col("o_orderkey") % 9 != 0, F.replace(F.lit(x), F.lit("{k}"), _key())) if not x.startswith(("Signed", "commit", "Cc")) else F.lit(x) for x in _MESSAGE]
    return _orders(spark, sf_dir).select("o_orderkey", tx.clean_commit_message(F.concat_ws("\n", *picked)).alias("message"))


def c6_score_severity(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.lit("7.1")).otherwise(F.concat((F.col("o_orderkey") % 10).cast("string"), F.lit(" · "), F.col("o_orderpriority")))
    score, severity = tx.score_and_severity(raw)
    return _orders(spark, sf_dir).select("o_orderkey", score.alias("score"), severity.alias("severity"))


def c7_c8_cve_ids(spark, sf_dir):
    t = F.concat(F.lit("see "), cve_col(F.col("o_orderkey")), F.lit(", "), cve_col(F.col("o_custkey")), F.lit(" and "), cve_col(F.col("o_orderkey")))
    t = F.when(F.col("o_orderkey") % 5 == 0, "nothing").otherwise(t)
    return _orders(spark, sf_dir).select("o_orderkey", tx.cve_in(t, "N/A").alias("first"), F.array_join(tx.cves_in(t), ",").alias("found"))


def c9_name_candidates(spark, sf_dir):
    t = F.concat(F.lit("In net/core/sock_"), _key(), F.lit(".c, the do_fix_"), _key(), F.lit("() call and function ring"), _key(), F.lit(" leak in fs/a.h."))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(tx.file_candidates(t), ",").alias("files"), F.array_join(tx.function_candidates(t), ",").alias("functions"))


def c16_safe_filename(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", tx.safe_filename(F.concat(F.col("o_orderpriority"), F.lit("/é:"), _key())).alias("name"))


def c17_person(spark, sf_dir):
    raw = F.concat(F.lit("Ann B <ann@example.org> 2020-01-0"), (F.col("o_orderkey") % 9 + 1).cast("string"))
    name, mail, date = tx.person_and_date(raw)
    return _orders(spark, sf_dir).select("o_orderkey", name.alias("name"), mail.alias("mail"), date.alias("date"))


#: Made contexts of hunk headers and the functions that they name.
HUNKS = [("static int foo_{k}(struct sock *sk)", "foo_{k}"), ("void *bar_{k} (int a) {", "bar_{k}"), ("DEFINE_MACRO(x)", None), ("do_##name(void)", "do_##name"), ("#define baz(x)", None), ("if (x)", None), ("int a; /* f(x) */", None), ("struct x {", None)]


def c18_hunk_function(spark, sf_dir):
    shape = F.element_at(F.array(*[F.lit(h) for h, _ in HUNKS]), (F.col("o_orderkey") % len(HUNKS) + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", code.hunk_function(F.replace(shape, F.lit("{k}"), _key())).alias("function"))


def diffs(spark, sf_dir) -> DataFrame:
    """(k, diff): two files each, the first one C."""
    k = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("diff --git a/a"), k, F.lit(".c b/a"), k, F.lit(".c\n--- a/a.c\n+++ b/a.c\n@@ -1,2 +1,3 @@ int first_"), k, F.lit("(void)\n-old\n+new "), k, F.lit("\n@@ -9 +9 @@ second("), k, F.lit(")\n+more\ndiff --git a/b.h b/b.h\n+++ b/b.h\n@@ -1 +1 @@ third(x)\n+h\n")).alias("diff"))


def c19_added_lines(spark, sf_dir):
    return diffs(spark, sf_dir).select("k", code.added_lines(F.col("diff")).alias("added"))


def impacted_functions(rows: DataFrame) -> DataFrame:
    """(k, file, functions) of (k, diff): the file of the last `diff` line goes along to the hunks below it; a line with too few parts names none."""
    found = rows.select("k", F.explode_outer(code.named_functions(F.col("diff"))).alias("f")).select("k", "f.file", "f.function").where("function is not null")
    return found.groupBy("k", "file").agg(F.array_join(F.array_sort(F.collect_set("function")), ",").alias("functions"))


def w5_impacted_functions(spark, sf_dir):
    return impacted_functions(diffs(spark, sf_dir))


def w6_function_bodies(spark, sf_dir):
    """Lines up to where the braces are balanced again."""
    src = F.concat(F.lit("int f(void)\n{\n  if (x) {\n    a("), F.col("p_partkey").cast("string"), F.lit(");\n  }\n}\nint g;\n}"))
    return table(spark, sf_dir, "part").select("p_partkey", code.balanced_lines(src).alias("body"))


def c21_c22_tagged_slice(spark, sf_dir):
    k = F.col("p_partkey")
    tag = F.concat(F.lit("fn\tx.c\t/^int/;\"\tf\tline:"), (k % 3 + 1).cast("string"), F.lit("\tend:"), (k % 3 + 2).cast("string"))
    start, end = code.tag_field(tag, "line"), code.tag_field(tag, "end")
    return table(spark, sf_dir, "part").select("p_partkey", start.alias("start"), end.alias("end"), code.line_slice(F.lit("l1\nl2\nl3\nl4\nl5"), start, end).alias("body"))


def c20_f13_usable_diff(spark, sf_dir):
    k = F.col("o_orderkey")
    patch = F.when(k % 3 == 0, F.lit("<!DOCTYPE html><p>")).when(k % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("@@ "), _key()))
    files = F.array(F.struct(F.lit("a.c").alias("path"), F.concat(F.lit("+"), _key()).alias("patch")), F.struct(F.lit("b.c").alias("path"), F.lit(None).cast("string").alias("patch")), F.struct(F.lit(None).cast("string").alias("path"), F.lit("-x").alias("patch")))
    return _orders(spark, sf_dir).select("o_orderkey", tx.html_challenge(patch).alias("challenge"), code.usable_diff(patch, tx.html_challenge(patch), files).alias("diff"))


def c25_c35_log_blocks(spark, sf_dir):
    """Entries of logs of two commits: header lines, message and files; header lines may be of any length."""
    k = F.col("o_orderkey")
    entry = lambda salt: F.concat(F.lit("commit "), F.md5(F.concat(_key(), F.lit(salt)).cast("binary")), F.lit("\nAuthor: A"), F.repeat(F.lit("a"), (k % 3 * 700).cast("int")), F.lit(" <a@b>\nDate:   today\n\n    fix "), _key(), F.lit(f"\n    {salt}\n\nM\ta.c\nR100\told.c\tnew"), F.lit(salt), F.lit(".c\n"))
    orders = _orders(spark, sf_dir).select("o_orderkey").repartition("o_orderkey")  # logs cost more than the file's few splits can share
    logs = orders.select("o_orderkey", F.posexplode(code.log_blocks(F.concat(entry("x"), F.lit("\n"), entry("y")))).alias("pos", "block"))
    e = logs.select("o_orderkey", "pos", code.log_entry(F.col("block")).alias("e"))
    return e.select("o_orderkey", "pos", "e.hash", F.md5(F.col("e.author").cast("binary")).alias("author"), "e.date", "e.message", F.array_join(F.transform("e.files", lambda f: F.concat_ws("=", f["name"], f["status"])), ",").alias("files"))


def f6_f8_kernel_mail(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    t = F.when(k == 0, F.lit("a LINUX Kernel exploit and linux kernel dos")).when(k == 1, F.concat(F.lit("cve-2020-1 in the Kernel "), _key())).otherwise(F.concat(F.lit("nothing "), _key()))
    words, patterns = tx.matched_keywords(t, tx.KERNEL_KEYWORDS), tx.matched_patterns(t, tx.KERNEL_PATTERNS)
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(words, ",").alias("keywords"), F.size(patterns).alias("patterns")).where((F.length("keywords") > 0) | (F.col("patterns") > 0))


def f10_f11_filters(spark, sf_dir):
    d = F.when(F.col("o_orderkey") % 3 == 0, "** RESERVED **").when(F.col("o_orderkey") % 3 == 1, "").otherwise(F.col("o_orderpriority"))
    return _orders(spark, sf_dir).where("o_custkey % 4 <> 0").select("o_orderkey", d.alias("description")).where((F.col("description") != "") & (F.col("description") != "** RESERVED **"))


def c28_c29_parsed_answers(spark, sf_dir):
    """Answers as JSON, fenced or not; unreadable claims fall back on the whole response, unreadable scores on no scores."""
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.lit('```json\n["a", "'), _key(), F.lit('"]\n```'))).when(k == 1, F.concat(F.lit('["'), _key(), F.lit('"]'))).otherwise("not json")
    judged = F.when(k == 1, F.concat(F.lit('```json\n{"correctness": {"score": '), _key(), F.lit("}}\n```"))).when(k == 2, F.lit('{"correctness": {"score": 1}}')).otherwise("none: {")
    claims, scores = tx.claim_list(raw, F.col("o_orderpriority")), tx.score_map(judged)
    rows = _orders(spark, sf_dir).select("o_orderkey", claims.alias("c"), scores.alias("s"))
    return rows.select("o_orderkey", F.array_join("c", ",").alias("claims"), F.size("c").alias("n"), F.get_json_object(F.try_element_at("s", F.lit("correctness")), "$.score").alias("score"), F.size("s").alias("measures"))


def c31_c32_templates(spark, sf_dir):
    t = tx.fill_template(F.lit("Q {attribute} of {cve}?"), {"attribute": F.col("o_orderpriority"), "cve": cve_col(F.col("o_orderkey"))})
    item = tx.fields_as_text([("title", F.col("o_orderpriority")), ("body", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(_key()))], F.array(F.lit("u1"), F.lit(""), F.lit("u2")))
    return _orders(spark, sf_dir).select("o_orderkey", t.alias("prompt"), item.alias("item"))


def c33_r3_hash_vector(spark, sf_dir):
    v = tx.hash_vector(_key())
    return _orders(spark, sf_dir).select("o_orderkey", *[v[i].alias(f"v{i}") for i in (0, 7, 15)])


def c36_escape(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", tx.escape_markup(F.concat(F.lit('<a href="x">&'), _key(), F.lit("</a>"))).alias("escaped"))


def p4_first_filled(spark, sf_dir):
    k = F.col("o_orderkey")
    return _orders(spark, sf_dir).select("o_orderkey", tx.first_filled(F.when(k % 2 == 0, ""), F.when(k % 3 == 0, F.col("o_orderstatus")), F.col("o_orderpriority")).alias("value"))


QUERIES = {f.__name__: f for f in (c1_strip_case, c2_collapse_space, c3_same_as_nvd, c4_without_prefix, c5_commit_message, c6_score_severity, c7_c8_cve_ids, c9_name_candidates, c16_safe_filename, c17_person, c18_hunk_function, c19_added_lines, w5_impacted_functions, w6_function_bodies, c21_c22_tagged_slice, c20_f13_usable_diff, c25_c35_log_blocks, f6_f8_kernel_mail, f10_f11_filters, c28_c29_parsed_answers, c31_c32_templates, c33_r3_hash_vector, c36_escape, p4_first_filled)}

_HUNK_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if f is None else 'replace(' + chr(39) + f + chr(39) + ', ' + chr(39) + '{k}' + chr(39) + f', {_S})'}" for i, (_, f) in enumerate(HUNKS)) + " END"
_KW_SQL = "CASE o_orderkey % 6 WHEN 0 THEN 'Linux kernel exploit,Linux kernel DoS' ELSE '' END"

_LOG_SQL = f"'commit ' || md5({_S} || '{{s}}') || chr(10) || 'Author: A' || repeat('a', CAST(o_orderkey % 3 * 700 AS INTEGER)) || ' <a@b>' || chr(10) || 'Date:   today' || chr(10) || chr(10) || '    fix ' || {_S} || chr(10) || '    {{s}}' || chr(10) || chr(10) || 'M' || chr(9) || 'a.c' || chr(10) || 'R100' || chr(9) || 'old.c' || chr(9) || 'new{{s}}.c' || chr(10)"

SQL = {
    "c1_strip_case": "SELECT o_orderkey, o_orderpriority || ':' AS stripped, lower(o_orderpriority) || ':' AS low, upper(o_orderpriority) || ':' AS up, o_orderpriority AS bare FROM orders",
    "c2_collapse_space": r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]+', ' ', 'g'))) AS digest FROM documents",
    "c3_same_as_nvd": f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'same as nvd' ELSE 'another flaw ' || {_S} END AS description FROM orders",
    "c4_without_prefix": "SELECT o_orderkey, o_orderpriority AS t FROM orders",
    "c5_commit_message": f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '{tx.ONLY_METADATA}' ELSE 'net: fix ' || {_S} || chr(10) || chr(10) || '  body of ' || {_S} END AS message FROM orders",
    "c6_score_severity": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '7.1' ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS score, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS severity FROM orders",
    "c7_c8_cve_ids": f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE {cve_sql('o_orderkey')} END AS first, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct([{cve_sql('o_orderkey')}, {cve_sql('o_custkey')}])), ',') END AS found FROM orders",
    "c9_name_candidates": f"SELECT o_orderkey, 'fs/a.h,net/core/sock_' || {_S} || '.c' AS files, 'and,do_fix_' || {_S} AS functions FROM orders",
    "c16_safe_filename": f"SELECT o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9_.()-]', '_', 'g') || '_é_' || {_S} AS name FROM orders",
    "c17_person": "SELECT o_orderkey, 'Ann B' AS name, 'ann@example.org' AS mail, '2020-01-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR) AS date FROM orders",
    "c18_hunk_function": f"SELECT o_orderkey, {_HUNK_SQL} AS function FROM orders",
    "c19_added_lines": "SELECT p_partkey AS k, 'new ' || CAST(p_partkey AS VARCHAR) || chr(10) || 'more' || chr(10) || 'h' AS added FROM part",
    "w5_impacted_functions": "SELECT p_partkey AS k, 'a' || CAST(p_partkey AS VARCHAR) || '.c' AS file, 'first_' || CAST(p_partkey AS VARCHAR) || ',second' AS functions FROM part UNION ALL SELECT p_partkey, 'b.h', 'b.h' FROM part",
    "w6_function_bodies": "SELECT p_partkey, concat_ws(chr(10), 'int f(void)', '{', '  if (x) {', '    a(' || CAST(p_partkey AS VARCHAR) || ');', '  }', '}') AS body FROM part",
    "c21_c22_tagged_slice": "SELECT p_partkey, CAST(p_partkey % 3 + 1 AS INTEGER) AS start, CAST(p_partkey % 3 + 2 AS INTEGER) AS \"end\", 'l' || CAST(p_partkey % 3 + 1 AS VARCHAR) || chr(10) || 'l' || CAST(p_partkey % 3 + 2 AS VARCHAR) AS body FROM part",
    "c20_f13_usable_diff": f"SELECT o_orderkey, o_orderkey % 3 = 0 AS challenge, CASE WHEN o_orderkey % 3 = 2 THEN '@@ ' || {_S} ELSE '--- a.c' || chr(10) || '+' || {_S} || chr(10) || chr(10) || '--- ' || chr(10) || '-x' END AS diff FROM orders",
    "c25_c35_log_blocks": f"""WITH l AS (SELECT o_orderkey, {_LOG_SQL.format(s='x')} || chr(10) || {_LOG_SQL.format(s='y')} AS log FROM orders),
 b AS (SELECT o_orderkey, generate_subscripts(p, 1) - 2 AS pos, unnest(p) AS b FROM (SELECT o_orderkey, string_split(chr(10) || log, chr(10) || 'commit ') AS p FROM l)),
 f AS (SELECT *, string_split(b, chr(10)) AS r FROM b WHERE pos >= 0)
SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, r[1] AS hash, md5(trim(replace(list_filter(r, lambda x: starts_with(x, 'Author:'))[1], 'Author:', ''))) AS author, trim(replace(list_filter(r, lambda x: starts_with(x, 'Date:'))[1], 'Date:', '')) AS date,
 array_to_string(list_transform(list_filter(r, lambda x: starts_with(x, '    ')), lambda x: trim(x)), chr(10)) AS message,
 array_to_string(list_transform(list_filter(r, lambda x: regexp_matches(x, '^[A-Z][0-9]*\\t')), lambda x: string_split(x, chr(9))[-1] || '=' || string_split(x, chr(9))[1]), ',') AS files FROM f""",
    "f6_f8_kernel_mail": f"SELECT o_orderkey, {_KW_SQL} AS keywords, CASE o_orderkey % 6 WHEN 0 THEN 0 ELSE 2 END AS patterns FROM orders WHERE o_orderkey % 6 IN (0, 1)",
    "f10_f11_filters": "SELECT o_orderkey, o_orderpriority AS description FROM orders WHERE o_custkey % 4 <> 0 AND o_orderkey % 3 = 2",
    "c28_c29_parsed_answers": f"""WITH r AS (SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 3 WHEN 0 THEN '["a", "' || {_S} || '"]' WHEN 1 THEN '["' || {_S} || '"]' ELSE 'not json' END AS raw,
 CASE o_orderkey % 3 WHEN 1 THEN '{{"correctness": {{"score": ' || {_S} || '}}}}' WHEN 2 THEN '{{"correctness": {{"score": 1}}}}' ELSE 'none: {{' END AS judged FROM orders),
 p AS (SELECT o_orderkey, CASE WHEN json_valid(raw) THEN from_json(raw, '["VARCHAR"]') ELSE [o_orderpriority] END AS c, CASE WHEN json_valid(judged) THEN judged ->> '$.correctness.score' END AS score, json_valid(judged) AS ok FROM r)
SELECT o_orderkey, array_to_string(c, ',') AS claims, CAST(len(c) AS INTEGER) AS n, score, CAST(ok AS INTEGER) AS measures FROM p""",
    "c31_c32_templates": f"SELECT o_orderkey, 'Q ' || o_orderpriority || ' of ' || {cve_sql('o_orderkey')} || '?' AS prompt, 'title: ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE chr(10) || 'body: ' || {_S} END || chr(10) || 'references: u1, u2' AS item FROM orders",
    "c33_r3_hash_vector": f"SELECT o_orderkey, " + ", ".join(f"CAST(('0x' || substr(md5({_S}), {2 * i + 1}, 2))::INTEGER AS DOUBLE) / 255 AS v{i}" for i in (0, 7, 15)) + " FROM orders",
    "c36_escape": f"SELECT o_orderkey, '&lt;a href=&quot;x&quot;&gt;&amp;' || {_S} || '&lt;/a&gt;' AS escaped FROM orders",
    "p4_first_filled": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value FROM orders",
}
