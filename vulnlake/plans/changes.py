"""Queries of code changes: hunks, applied patches, lexed function bodies; and of ragged lists."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.functions import code
from vulnlake.functions.ragged import flat_strings
from vulnlake.session import table


def c23_ragged_links(spark, sf_dir):
    """Links as strings, lists and deeper lists in one field."""
    p = table(spark, sf_dir, "pages").where("page_id is not null")
    quoted = lambda c: F.substr(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    n, url = (F.col("page_id") % 7).cast("int"), quoted(F.coalesce("url", F.lit("")))
    deep = F.concat(F.repeat(F.lit("["), n), url, F.lit(', "", "in ]["'), F.repeat(F.lit("]"), n))
    rows = p.select("page_id", F.concat(F.lit("["), url, F.lit(", "), deep, F.lit(', 5, null, {"a": ["no"]}, [[], ["last"]]]')).alias("links"))
    return flat_strings(rows, "links").select("page_id", F.size("flat").alias("n"), F.array_join("flat", "|").alias("flat"))


def _versions(spark, sf_dir):
    """(doc_id, w, n): a document's words, which stand for the lines of a file."""
    w = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", w.alias("w")).withColumn("n", F.size("w")).where("n > 0")


def _key(c):
    return F.col(c).cast("string")


def change_diffs(spark, sf_dir):
    """(doc_id, diff): long files get a line replaced and their last one split, which adds the missing end; short ones are new; all are renamed once."""
    v = _versions(spark, sf_dir)
    p, n, w = (F.col("doc_id") % 5 + 3).cast("int"), F.col("n"), lambda i: F.element_at("w", i)
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\n"))
    number = lambda c: c.cast("string")
    change = F.concat(
        line("diff --git a/main.c b/main.c"), line("index 1..2 100644"), line("--- a/main.c"), line("+++ b/main.c"),
        line("@@ -", number(p - 1), ",3 +", number(p - 1), ",3 @@ int f_", _key("doc_id"), "(void)"), line(" ", w(p - 1)), line("-", w(p)), line("+new ", _key("doc_id")), line(" ", w(p + 1)),
        line("@@ -", number(n - 1), ",2 +", number(n - 1), ",3 @@"), line(" ", w(n - 1)), line("-", w(n)), line("\\ No newline at end of file"), line("+", w(n), "!"), line("+tail"))
    added = F.concat(line("diff --git a/new.c b/new.c"), line("new file mode 100644"), line("--- /dev/null"), line("+++ b/new.c"), line("@@ -0,0 +1,", number(n), " @@"), F.array_join(F.transform("w", lambda x: F.concat(F.lit("+"), x, F.lit("\n"))), ""))
    renamed = F.concat(line("diff --git a/old.c b/moved.c"), line("similarity index 100%"), line("rename from old.c"), line("rename to moved.c"))
    return v.select("doc_id", F.concat(F.when(n >= 12, change).otherwise(added), renamed, F.lit("-- \n2.40\n")).alias("diff"))


def _files(spark, sf_dir):
    """(doc_id, path, before): main.c, without an end of its last line, and old.c, of two lines."""
    v = _versions(spark, sf_dir)
    main = v.where("n >= 12").select("doc_id", F.lit("main.c").alias("path"), F.array_join("w", "\n").alias("before"))
    return main.unionAll(v.select("doc_id", F.lit("old.c"), F.concat(F.element_at("w", 1), F.lit("\nend\n"))))


def s17_patch_apply(spark, sf_dir):
    """After texts from before texts and diffs, and before texts back again; files are met by key and path."""
    changes = change_diffs(spark, sf_dir).select("doc_id", F.explode(code.file_changes(F.col("diff"))).alias("f")).select("doc_id", "f.*")
    rows = changes.join(_files(spark, sf_dir).withColumnRenamed("path", "old_path"), ["doc_id", "old_path"], "left")
    rows = rows.withColumn("after", code.apply_hunks(F.col("before"), F.col("hunks")))
    rows = rows.withColumn("back", code.apply_hunks(F.col("after"), F.col("hunks"), reverse=True) == F.coalesce("before", F.lit("")))
    return rows.select("doc_id", "old_path", "new_path", "status", F.size("hunks").alias("hunks"), F.md5(F.col("after").cast("binary")).alias("after"), "back")


def s17_hunk_rows(spark, sf_dir):
    """One row a line of a hunk, with its numbers in the old and the new file."""
    files = change_diffs(spark, sf_dir).select("doc_id", F.explode(code.file_changes(F.col("diff"))).alias("f"))
    hunks = files.select("doc_id", F.coalesce("f.new_path", "f.old_path").alias("path"), F.posexplode("f.hunks").alias("hunk", "h"))
    rows = hunks.select("doc_id", "path", "hunk", code.hunk_function(F.col("h.section")).alias("function"), "h.old_start", "h.new_start", F.posexplode("h.lines").alias("pos", "row"))
    rows = rows.withColumn("sign", F.substring("row", 1, 1)).withColumn("line", F.substring("row", 2, 1 << 30))
    order = Window.partitionBy("doc_id", "path", "hunk").orderBy("pos")
    numbered = lambda start, signs: F.when(F.col("sign").isin(*signs), F.col(start) + F.sum(F.when(F.col("sign").isin(*signs), 1).otherwise(0)).over(order) - 1)
    return rows.select("doc_id", "path", "hunk", "pos", "function", "sign", numbered("old_start", (" ", "-")).alias("old_no"), numbered("new_start", (" ", "+")).alias("new_no"), F.md5(F.col("line").cast("binary")).alias("line"))


def c_sources(spark, sf_dir):
    """(p_partkey, source, start): functions with braces in strings, characters and comments; some never close."""
    k = F.col("p_partkey")
    odd = F.element_at(F.array(*[F.lit(x) for x in ODD_LINES]), (k % len(ODD_LINES) + 1).cast("int"))
    body = F.concat(F.lit("int g;\n\nint f(void) // {\n{ /* { */\n  if (x) {\n"), odd, F.lit("\n    a("), k.cast("string"), F.lit(");\n  }\n"), F.when(k % 7 == 0, "").otherwise("} /* end }\n */ int h;\nint i(void) { }\n"))
    return table(spark, sf_dir, "part").select("p_partkey", body.alias("source"), (k % 2 * 2 + 1).cast("int").alias("start"))


ODD_LINES = ["    a('}', 0);", '    s = "}{\\"}";', "    /* } \n } */ b();", "    // }}", "    c = '\\''; d = '{';", '    t = "\\\\"; }  { u();', "    v = a / b; w = 1 /* } */ / 2;"]


def w6_lexed_bodies(spark, sf_dir):
    """The function from a line on, up to the line that balances its braces."""
    return c_sources(spark, sf_dir).select("p_partkey", "start", code.function_body(F.col("source"), F.col("start")).alias("body"))


def w5_broken_heads(spark, sf_dir):
    """A head of too few parts ends the file before it; its hunks belong to none."""
    from vulnlake.plans.texts import impacted_functions

    k = F.col("o_orderkey")
    head = F.when(k % 3 == 0, F.lit("diff --git a/x.c")).when(k % 3 == 1, F.lit("diff --git a/x.c b/sub/x.c more")).otherwise("diff --git a/x.S x.S")
    diff = F.concat(F.lit("diff --git a/first.c b/first.c\n@@ -1 +1 @@ one(\n"), head, F.lit("\n@@ -1 +1 @@ int two_"), k.cast("string"), F.lit("(void)\n"))
    return impacted_functions(table(spark, sf_dir, "orders").select("o_orderkey").repartition("o_orderkey").select(k.alias("k"), diff.alias("diff")))


QUERIES = {f.__name__: f for f in (c23_ragged_links, s17_patch_apply, s17_hunk_rows, w6_lexed_bodies, w5_broken_heads)}

_NL = "chr(10)"
_WORDS = "v AS (SELECT doc_id, w, CAST(len(w) AS INT) AS n, CAST(doc_id % 5 + 3 AS INT) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL) WHERE len(w) > 0)"
_TEXT = lambda rows: f"array_to_string({rows}, {_NL})"
_DIFF = f"""array_to_string(CASE WHEN n >= 12 THEN ['diff --git a/main.c b/main.c', 'index 1..2 100644', '--- a/main.c', '+++ b/main.c', '@@ -' || (p - 1) || ',3 +' || (p - 1) || ',3 @@ int f_' || doc_id || '(void)', ' ' || w[p - 1], '-' || w[p], '+new ' || doc_id, ' ' || w[p + 1],
 '@@ -' || (n - 1) || ',2 +' || (n - 1) || ',3 @@', ' ' || w[n - 1], '-' || w[n], '\\ No newline at end of file', '+' || w[n] || '!', '+tail']
 ELSE list_concat(['diff --git a/new.c b/new.c', 'new file mode 100644', '--- /dev/null', '+++ b/new.c', '@@ -0,0 +1,' || n || ' @@'], list_transform(w, lambda x: '+' || x)) END, {_NL})"""
_ODD = "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in ODD_LINES) + "]"

SQL = {
    "c23_ragged_links": r"""WITH RECURSIVE q AS (SELECT page_id, CAST(page_id % 7 AS INT) AS n, CAST(to_json(coalesce(url, '')) AS VARCHAR) AS u FROM pages WHERE page_id IS NOT NULL),
 l AS (SELECT page_id, ('[' || u || ', ' || repeat('[', n) || u || ', "", "in ]["' || repeat(']', n) || ', 5, null, {"a": ["no"]}, [[], ["last"]]]')::JSON AS j FROM q),
 r AS (SELECT page_id, [CAST(i AS BIGINT)] AS path, j[i - 1] AS j FROM l, range(1, json_array_length(j)::BIGINT + 1) AS t(i)
   UNION ALL SELECT page_id, list_append(path, CAST(i AS BIGINT)), r.j[i - 1] FROM r, range(1, json_array_length(r.j)::BIGINT + 1) AS t(i) WHERE json_type(r.j) = 'ARRAY')
SELECT page_id, CAST(count(*) AS INT) AS n, string_agg(j ->> '$', '|' ORDER BY path) AS flat FROM r WHERE json_type(j) = 'VARCHAR' AND j ->> '$' <> '' GROUP BY page_id""",
    "s17_patch_apply": f"""WITH {_WORDS}
SELECT doc_id, 'main.c' AS old_path, 'main.c' AS new_path, 'M' AS status, 2 AS hunks, md5({_TEXT("list_concat(w[1:p - 1], ['new ' || doc_id], w[p + 1:n - 1], [w[n] || '!', 'tail', ''])")}) AS after, true AS back FROM v WHERE n >= 12
UNION ALL SELECT doc_id, NULL, 'new.c', 'A', 1, md5({_TEXT("list_append(w, '')")}), true FROM v WHERE n < 12
UNION ALL SELECT doc_id, 'old.c', 'moved.c', 'R', 0, md5(w[1] || {_NL} || 'end' || {_NL}), true FROM v""",
    "s17_hunk_rows": f"""WITH {_WORDS},
 l AS (SELECT doc_id, unnest(d) AS row, generate_subscripts(d, 1) AS i FROM (SELECT doc_id, string_split({_DIFF}, {_NL}) AS d FROM v)),
 h AS (SELECT *, sum(CASE WHEN starts_with(row, '@@ ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS hunk, last_value(CASE WHEN starts_with(row, '+++ ') THEN row[7:] END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS path,
   last_value(CASE WHEN starts_with(row, '@@ ') THEN row END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM l),
 r AS (SELECT *, row[1] AS sign, row_number() OVER (PARTITION BY doc_id, hunk ORDER BY i) - 1 AS pos FROM h WHERE hunk > 0 AND NOT starts_with(row, '@@ '))
SELECT doc_id, path, CAST(hunk - 1 AS INT) AS hunk, CAST(pos AS INT) AS pos, nullif(regexp_extract(head, 'int (f_[0-9]+)', 1), '') AS function, sign,
 CASE WHEN sign IN (' ', '-') THEN CAST(regexp_extract(head, '-([0-9]+)', 1)::INT + count(*) FILTER (sign IN (' ', '-')) OVER w - 1 AS BIGINT) END AS old_no,
 CASE WHEN sign IN (' ', '+') THEN CAST(regexp_extract(head, '[+]([0-9]+)', 1)::INT + count(*) FILTER (sign IN (' ', '+')) OVER w - 1 AS BIGINT) END AS new_no, md5(row[2:]) AS line
FROM r WINDOW w AS (PARTITION BY doc_id, hunk ORDER BY i)""",
    "w5_broken_heads": "SELECT o_orderkey AS k, 'first.c' AS file, 'one' AS functions FROM orders UNION ALL SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN 'sub/x.c' ELSE 'x.S' END, CASE o_orderkey % 3 WHEN 1 THEN 'two_' || o_orderkey ELSE 'x.S' END FROM orders WHERE o_orderkey % 3 <> 0",
    "w6_lexed_bodies": f"""WITH s AS (SELECT p_partkey, CAST(p_partkey % 2 * 2 + 1 AS INT) AS start, concat_ws({_NL}, 'int g;', '', 'int f(void) // {{', '{{ /* {{ */', '  if (x) {{', {_ODD}[p_partkey % {len(ODD_LINES)} + 1], '    a(' || p_partkey || ');', '  }}', '') || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat_ws({_NL}, '}} /* end }}', ' */ int h;', 'int i(void) {{ }}', '') END AS src FROM part),
 t AS (SELECT p_partkey, start, array_to_string(string_split(src, {_NL})[start:], {_NL}) AS src FROM s),
 f AS (SELECT *, list_reduce(string_split(src, ''), lambda s, c: CASE WHEN s.e > 0 THEN s ELSE {{
   'm': CASE s.m WHEN 'code' THEN CASE WHEN c = '"' THEN 'text' WHEN c = '''' THEN 'char' WHEN c = '/' AND s.q = '/' THEN 'line' WHEN c = '*' AND s.q = '/' THEN 'block' ELSE 'code' END
     WHEN 'text' THEN CASE WHEN c = '"' AND s.q <> '\\' THEN 'code' ELSE 'text' END WHEN 'char' THEN CASE WHEN c = '''' AND s.q <> '\\' THEN 'code' ELSE 'char' END
     WHEN 'line' THEN CASE WHEN c = {_NL} THEN 'code' ELSE 'line' END ELSE CASE WHEN c = '/' AND s.q = '*' THEN 'code' ELSE 'block' END END,
   'q': CASE WHEN s.q = '\\' AND s.m IN ('text', 'char') OR s.m = 'code' AND s.q = '/' AND c IN ('/', '*') OR s.m = 'block' AND s.q = '*' AND c = '/' OR s.m = 'line' AND c = {_NL} THEN '' ELSE c END,
   'd': s.d + CASE WHEN s.m = 'code' AND c = '{{' THEN 1 WHEN s.m = 'code' AND c = '}}' THEN -1 ELSE 0 END, 'o': s.o OR (s.m = 'code' AND c = '{{'),
   'i': s.i + 1, 'e': CASE WHEN c = {_NL} AND s.o AND s.d = 0 THEN s.i + 1 ELSE 0 END}} END, {{'m': 'code', 'q': '', 'd': 0, 'o': false, 'i': 0, 'e': 0}}) AS s FROM t)
SELECT p_partkey, start, CASE WHEN s.e > 0 THEN src[1:s.e - 1] WHEN s.o AND s.d = 0 THEN src END AS body FROM f""",
}
