"""Queries of documents, chunks, retrieval and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.operators import batches, chunking, html, neighbours, rag
from vulnlake.plans.evaluation import cve_col, cve_sql
from vulnlake.session import table


def r1_documents(spark, sf_dir):
    """One row a piece of evidence, tagged with where it is from."""
    o = table(spark, sf_dir, "orders")
    cve = cve_col(F.col("o_custkey")).alias("cve")
    parts = F.array(
        F.struct(F.lit("nvd").alias("source"), F.lit(0).alias("pos"), F.concat(F.lit("flaw "), F.col("o_orderpriority")).alias("text")),
        F.struct(F.lit("patch message").alias("source"), F.lit(1).alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("[PATCH MESSAGE] \n"), F.col("o_orderstatus"))).alias("text")),
        F.struct(F.lit("impact scores").alias("source"), F.lit(2).alias("pos"), (F.col("o_orderkey") % 10).cast("string").alias("text")),
    )
    return o.select(cve, "o_orderkey", F.explode(parts).alias("d")).where("d.text is not null").select("cve", "o_orderkey", "d.source", "d.pos", "d.text")


def r2_recursive_chunks(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_pos", "start_index", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def r2_fixed_chunks(spark, sf_dir):
    return chunking.fixed_chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_pos", "start_index", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def w1_running_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rag.running_documents(c, "conv_id", "turn", "text").select("conv_id", "turn", F.md5(F.col("document").cast("binary")).alias("digest"))


def w1_running_views(spark, sf_dir):
    """Running documents as views of texts that are stored once."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    stored, spans = chunking.running_spans(c, "conv_id", "turn", "text")
    return chunking.running_view(stored, spans, "conv_id").select("conv_id", "turn", F.md5(F.col("document").cast("binary")).alias("digest"))


def w1_final_documents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return rag.final_documents(c, "conv_id", "turn", "text").select("conv_id", F.md5(F.col("document").cast("binary")).alias("digest"))


def vocabulary_path() -> str:
    """A public vocabulary; any tokenizer file would do."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def w2_token_batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", rag.token_count(F.col("text")).alias("tokens"))
    return rag.token_batches(c, "conv_id", "turn", "tokens", 120)


def w2_long_batches(spark, sf_dir):
    """Few keys, each of them a long list over many tasks."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").cast("long").alias("tokens"))
    return batches.long_batches(li, "l_returnflag", "pos", "tokens", 3000)


def w2_bpe_batches(spark, sf_dir):
    """Batches by a vocabulary's own tokens."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", rag.bpe_token_count(vocabulary_path())("text").alias("tokens"))
    return rag.token_batches(c, "conv_id", "turn", "tokens", 300)


def c34_token_count(spark, sf_dir):
    """By white space, where no vocabulary is at hand."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rag.token_count(F.col("text")).alias("tokens"))


def c34_bpe_tokens(spark, sf_dir):
    """A vocabulary's tokens, and the text cut to the first 20 of them."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", rag.bpe_token_count(vocabulary_path())("text").alias("tokens"), rag.bpe_truncated(vocabulary_path(), 20)("text").alias("head"))


def c30_json_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_name", "c_nationkey")).alias("json"))


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), e.select("label", F.col("vec_id").alias("item_id"), "v")


def r4_j15_nearest(spark, sf_dir):
    """Exact nearest neighbours under one key."""
    return neighbours.nearest(*_vectors(spark, sf_dir), "label", 12).select("label", "query_id", "item_id", "d", F.col("rank").cast("long").alias("rank"))


def r4_pruned_nearest(spark, sf_dir):
    """The 5 items of the same kind that are nearest in size and price, for every item; most pairs are never compared."""
    v = F.array(F.col("size").cast("double"), F.col("price").cast("double"))
    e = table(spark, sf_dir, "items").where("size is not null and price is not null").select("kind", F.col("item_id").alias("item_id"), v.alias("v"))
    return neighbours.nearest(e.select("kind", F.col("item_id").alias("query_id"), F.col("v").alias("q")), e, "kind", 5, ring=50).select("kind", "query_id", "item_id", "d", F.col("rank").cast("long").alias("rank"))


def r5_mmr(spark, sf_dir):
    return rag.mmr(*_vectors(spark, sf_dir), "label")


def r6_contexts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), "role", "text")
    return rag.contexts(c, ["conv_id"], "rank", "role", "text").select("conv_id", F.md5(F.col("context").cast("binary")).alias("digest"))


def r8_ground_truth(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(cve_col(F.col("o_orderkey") % 900).alias("cve"), F.col("o_orderpriority").alias("attribute"), "o_orderkey")
    t = table(spark, sf_dir, "supplier").select(cve_col(F.col("s_suppkey")).alias("cve"), F.lit("1-URGENT").alias("attribute"), F.col("s_name").alias("truth"))
    return rag.with_ground_truth(a, t, ["cve", "attribute"]).select("o_orderkey", "truth")


def _messages(spark, sf_dir):
    """A message answers the one before it; every third one the first."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("id"), F.when(F.col("turn") == 0, None).when(F.col("turn") % 3 == 0, 0).otherwise(F.col("turn") - 1).alias("parent"))


def c24_thread_order(spark, sf_dir):
    """Each message's place in its thread, its depth and the ids above it."""
    place = F.row_number().over(Window.partitionBy("conv").orderBy("path"))
    return rag.thread_order(_messages(spark, sf_dir)).select("conv", "id", "depth", place.cast("long").alias("place"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def c24_long_threads(spark, sf_dir):
    """Suppliers in chains of 500 messages with seven-digit ids: threads may be of any depth."""
    k = F.col("s_suppkey").cast("long") + 1_000_000
    chain = table(spark, sf_dir, "supplier").select(F.floor(k / 500).alias("conv"), k.alias("id"), F.when(k % 500 != 0, k - 1).alias("parent"))
    return rag.thread_order(chain).select("conv", "id", "depth", F.element_at("path", 1).alias("first"))


def h_outline(spark, sf_dir):
    """The generic kernel over given pages."""
    o = table(spark, sf_dir, "pages").select("page_id", html.extract("outline", F.col("html")).alias("o"))
    return o.select("page_id", F.col("o.title").alias("title"), F.col("o.h1").alias("h1"), F.size("o.links").alias("n_links"), F.try_element_at("o.links", F.lit(1))["href"].alias("first_link"))


def h10_f12_pages(spark, sf_dir):
    found, mismatched = html.without_missing(table(spark, sf_dir, "pages"), "page_id", "html")
    pre = html.first_pre(F.concat(F.lit("<pre class=x>"), F.col("url"), F.lit("</pre>")))
    return found.join(mismatched.select("page_id", F.lit(True).alias("mismatch")), "page_id", "left").select("page_id", pre.alias("pre"), F.coalesce("mismatch", F.lit(False)).alias("mismatch"))


#: A made page of each source; {k} is a key.
SAMPLE_PAGES = {
    "redhat": '<h1>CVE-2020-{k}</h1><section id="cve-details-description"><div pfe-markdown-render><p>flaw {k}</p></div></section><div id="additional-info"><ul id="additional-info-list"><li><a href="https://bugzilla.redhat.com/{k}">Bugzilla {k}</a></ul></div><div id="stat-card-impact"><span class="severity-text">Low</span></div><section id="cve-cvss"><table id="cvss-table"><tr><th>AV</th><td>N</td><td>L</td></tr></table></section>',
    "bugzilla": '<span id="short_desc_nonedit_display">bug {k}</span><span id="static_bug_status">CLOSED</span><div class="bz_comment bz_first_comment" id="c0"><span class="bz_comment_number">Description</span><pre class="bz_comment_text">text {k}</pre></div>',
    "ubuntu": '<h1>CVE-{k}</h1><p>Ubuntu priority</p><p><strong>High</strong></p><h2>Cvss 3 Severity Score</h2><p>7.8 · High</p><div id="description"><p>flaw {k}</p></div>',
    "packet_storm": '<div class="fretrot"><table><tr><td>file {k}</td></tr></table></div><table><tr><td>CVE</td><td><a>CVE-1-{k}</a></td></tr></table><pre class="contentbox">body {k}</pre>',
    "exploit_db": '<h1 class="card-title">exploit {k}</h1><h4 class="info-title">CVE:</h4><h6 class="stats-title">2020-{k}</h6><div class="stats h5 text-center"><strong>EDB Verified:</strong><i class="mdi mdi-check"></i></div>',
    "lwn_alerts": '<table><tr><th>ID</th></tr><tr><td><a href="/A/{k}">A{k}</a></td><td>kernel</td><td>2020</td></tr></table>',
    "lwn_article": '<h1>article {k}</h1><table><tr><td>From:</td><td>&nbsp;</td><td>x{k}</td></tr></table><div class="ArticleText">text {k}</div>',
    "mail_threads": '<ul class="thread"><li><a href="{k}">root {k}</a> <em>A</em><ul><li><a href="1">re</a><em>B</em></ul></ul>',
    "mail_message": '<h1 class="m-title">about CVE-2020-{k}0000</h1><em>From</em>: A {k}<br><em>Date</em>: today<pre>body</pre>',
    "bulletin": '<h1>bulletin {k}</h1><h2>Summary</h2><p>sum {k}</p><h3>Fixes</h3><p>fixed in {k}</p><h2>References</h2>see https://example.org/{k}',
    "cgit_commit": '<table><tr><th>author</th><td>A {k} &lt;a@b&gt; 2020</td></tr></table><div class="commit-subject">fix {k}</div><div class="commit-msg">long {k}</div><table class="diffstat"><tr><td><a>f{k}.c</a></td></tr></table>',
}
#: One telling field of each source's record, and what it is for the made page.
SAMPLE_FIELDS = {
    "redhat": ("concat_ws('|', r.description, r.bugzilla_ids[0], r.impact, r.cvss['NVD']['AV'])", "flaw {k}|{k}|Low|L"),
    "bugzilla": ("concat_ws('|', r.summary, r.status, r.comments[0].text, string(r.comments[0].is_first))", "bug {k}|CLOSED|text {k}|true"),
    "ubuntu": ("concat_ws('|', r.cve_id, r.priority, r.score, r.severity, r.description)", "CVE-{k}|High|7.8|High|flaw {k}"),
    "packet_storm": ("concat_ws('|', r.title, r.cves[0], r.content)", "file {k}|CVE-1-{k}|body {k}"),
    "exploit_db": ("concat_ws('|', r.title, r.cve, string(r.verified))", "exploit {k}|2020-{k}|true"),
    "lwn_alerts": ("concat_ws('|', r.rows[0].id, r.rows[0].url, r.rows[0].package)", "A{k}|/A/{k}|kernel"),
    "lwn_article": ("concat_ws('|', r.title, r.meta['From'], r.content)", "article {k}|x{k}|text {k}"),
    "mail_threads": ("concat_ws('|', r.messages[0].title, r.messages[1].parent, string(r.messages[1].depth))", "root {k}|0|1"),
    "mail_message": ("concat_ws('|', r.cve, r.`from`, r.body)", None),
    "bulletin": ("concat_ws('|', r.title, r.summary, r.remediation, r.references[0])", "bulletin {k}|sum {k}|fixed in {k}|https://example.org/{k}"),
    "cgit_commit": ("concat_ws('|', r.author, r.author_email, r.subject, r.changed_files[0])", "A {k}|a@b|fix {k}|f{k}.c"),
}


def _page_query(kind: str, number: str):
    def query(spark, sf_dir):
        made = F.replace(F.lit(SAMPLE_PAGES[kind]), F.lit("{k}"), F.col("s_suppkey").cast("string"))
        return table(spark, sf_dir, "supplier").select("s_suppkey", html.extract(kind, made).alias("r")).select("s_suppkey", F.expr(SAMPLE_FIELDS[kind][0]).alias("fields"))

    query.__name__ = f"{number}_{kind}"
    return query


_PAGE_KINDS = [("redhat", "h1"), ("bugzilla", "h2"), ("ubuntu", "h3"), ("packet_storm", "h4"), ("exploit_db", "h5"), ("lwn_alerts", "h6"), ("lwn_article", "h6"), ("mail_threads", "h7"), ("mail_message", "h7"), ("bulletin", "h8"), ("cgit_commit", "h9")]

QUERIES = {f.__name__: f for f in (r1_documents, r2_recursive_chunks, r2_fixed_chunks, w1_running_documents, w1_running_views, w1_final_documents, w2_token_batches, w2_long_batches, w2_bpe_batches, c34_token_count, c34_bpe_tokens, c30_json_text, r4_j15_nearest, r4_pruned_nearest, r5_mmr, r6_contexts, r8_ground_truth, c24_thread_order, c24_long_threads, h_outline, h10_f12_pages, *[_page_query(k, n) for k, n in _PAGE_KINDS])}

_K = "CAST(s_suppkey AS VARCHAR)"
SQL = {
    "r1_documents": f"SELECT * FROM (SELECT {cve_sql('o_custkey')} AS cve, o_orderkey, 'nvd' AS source, 0 AS pos, 'flaw ' || o_orderpriority AS text FROM orders UNION ALL SELECT {cve_sql('o_custkey')}, o_orderkey, 'patch message', 1, '[PATCH MESSAGE] ' || chr(10) || o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT {cve_sql('o_custkey')}, o_orderkey, 'impact scores', 2, CAST(o_orderkey % 10 AS VARCHAR) FROM orders)",
    "r2_fixed_chunks": "WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 900)) AS i FROM documents) SELECT doc_id, CAST(i // 900 AS INTEGER) AS chunk_pos, CAST(i AS INTEGER) AS start_index, CAST(length(substr(text, i + 1, 1000)) AS INTEGER) AS n_chars, md5(substr(text, i + 1, 1000)) AS digest FROM s",
    "w1_running_documents": "SELECT conv_id, turn, md5(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)) AS digest FROM conversations",
    "w1_running_views": "SELECT conv_id, turn, md5(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)) AS digest FROM conversations",
    "w1_final_documents": "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "c34_token_count": r"SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS tokens FROM conversations",
    "w2_token_batches": r"""WITH RECURSIVE c AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 f AS (SELECT conv_id, turn, i, t AS used, 0 AS batch FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.turn, c.i, CASE WHEN f.used = 0 OR f.used + c.t <= 120 THEN f.used + c.t ELSE c.t END, CASE WHEN f.used = 0 OR f.used + c.t <= 120 THEN f.batch ELSE f.batch + 1 END FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
SELECT conv_id, turn, batch FROM f""",
    "w2_long_batches": """WITH RECURSIVE c AS MATERIALIZED (SELECT l_returnflag AS k, l_orderkey * 10 + l_linenumber AS pos, sum(CAST(l_quantity AS BIGINT)) OVER w AS e, sum(CAST(l_quantity AS BIGINT)) OVER w - CAST(l_quantity AS BIGINT) AS s FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT k, min(s) AS s, CAST(0 AS INT) AS batch FROM c GROUP BY k UNION ALL SELECT b.k, (SELECT min(c.s) FROM c WHERE c.k = b.k AND c.e > b.s + 3000), batch + 1 FROM b WHERE EXISTS (SELECT 1 FROM c WHERE c.k = b.k AND c.e > b.s + 3000))
SELECT c.k AS l_returnflag, c.pos, b.batch FROM c ASOF JOIN b ON c.k = b.k AND c.s >= b.s""",
    "r4_j15_nearest": "WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.label, q.vec_id AS query_id, c.vec_id AS item_id, round(list_distance(q.v, c.v), 6) AS d FROM e q JOIN e c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM d) SELECT * FROM r WHERE rank <= 12",
    "r6_contexts": "SELECT conv_id, md5(string_agg('Source: ' || role || chr(10) || ' ' || text || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "r8_ground_truth": f"SELECT o_orderkey, coalesce(s_name, 'Not Given') AS truth FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 900 AND o_orderpriority = '1-URGENT'",
    "c24_thread_order": "WITH RECURSIVE m AS (SELECT conv_id AS conv, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN 0 ELSE turn - 1 END AS parent FROM conversations), w AS (SELECT conv, id, 0 AS depth, [id] AS path FROM m WHERE parent IS NULL UNION ALL SELECT m.conv, m.id, w.depth + 1, list_append(w.path, m.id) FROM w JOIN m ON m.conv = w.conv AND m.parent = w.id) SELECT conv, id, depth, row_number() OVER (PARTITION BY conv ORDER BY path) AS place, array_to_string(path, '/') AS path FROM w",
    "c24_long_threads": "WITH RECURSIVE m AS (SELECT (s_suppkey + 1000000) // 500 AS conv, s_suppkey + 1000000 AS id FROM supplier), w AS (SELECT conv, id, 0 AS depth, id AS first FROM m WHERE id % 500 = 0 UNION ALL SELECT m.conv, m.id, depth + 1, first FROM w JOIN m ON m.id = w.id + 1 AND m.id % 500 <> 0) SELECT * FROM w",
    "c30_json_text": "SELECT c_custkey, CAST(to_json({'c_name': c_name, 'c_nationkey': c_nationkey}) AS VARCHAR) AS json FROM customer",
    "r4_pruned_nearest": "WITH e AS (SELECT kind, item_id, [CAST(size AS DOUBLE), CAST(price AS DOUBLE)] AS v FROM items WHERE kind IS NOT NULL AND item_id IS NOT NULL AND size IS NOT NULL AND price IS NOT NULL), d AS (SELECT q.kind, q.item_id AS query_id, c.item_id, round(list_distance(q.v, c.v), 6) AS d FROM e q JOIN e c ON q.kind = c.kind AND q.item_id <> c.item_id), r AS (SELECT *, row_number() OVER (PARTITION BY kind, query_id ORDER BY d, item_id) AS rank FROM d) SELECT * FROM r WHERE rank <= 5",
    "r5_mmr": """WITH RECURSIVE e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 d AS (SELECT q.label, q.vec_id AS query_id, q.v AS q, c.vec_id AS item_id, c.v, round(list_distance(q.v, c.v), 6) AS d FROM e q JOIN e c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM d QUALIFY rank <= 20),
 g AS (SELECT label, query_id, list(item_id ORDER BY rank) AS items, list(list_cosine_similarity(q, v) ORDER BY rank) AS near, list(v ORDER BY rank) AS vs FROM f GROUP BY label, query_id),
 n AS (SELECT label, query_id, items, near, list_transform(vs, lambda a: list_transform(vs, lambda b: list_cosine_similarity(a, b))) AS alike FROM g),
 p AS (SELECT label, query_id, items, near, alike, 1 AS place, [list_position(list_transform(near, lambda x: round(x, 9)), list_max(list_transform(near, lambda x: round(x, 9))))] AS chosen FROM n
  UNION ALL SELECT label, query_id, items, near, alike, place + 1, list_append(chosen, list_position(s, list_max(s))) FROM (
   SELECT *, list_transform(range(1, len(items) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -1e9 ELSE round(0.5 * near[i] - 0.5 * list_max(list_transform(chosen, lambda j: alike[i][j])), 9) END) AS s FROM p WHERE place < least(12, len(items))))
SELECT label, query_id, items[chosen[place]] AS item_id, place FROM p""",
    "h10_f12_pages": "SELECT page_id, url AS pre, NOT contains(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), CAST(page_id AS VARCHAR)) AS mismatch FROM pages WHERE regexp_matches(html, '(?i)<h1[\\s>]')",
    **{f"{n}_{k}": f"SELECT s_suppkey, replace('{SAMPLE_FIELDS[k][1]}', '{{k}}', {_K}) AS fields FROM supplier" for k, n in _PAGE_KINDS if SAMPLE_FIELDS[k][1]},
    "h7_mail_message": f"SELECT s_suppkey, 'CVE-2020-' || substr({_K} || '0000', 1, 7) || '|A ' || {_K} || '|body' AS fields FROM supplier",
}


def _leaves_sql(text: str, separators: list[str], depth: int = 0) -> str:
    """Parts of a text as a list, with '' where merging has to stop."""
    sep, finer = separators[0], separators[1:]
    if not sep:
        return f"string_split({text}, '')"
    lit, x = "(" + " || ".join(["chr(10)"] * len(sep)) + ")" if sep[0] == "\n" else "' '", f"x{depth}_{len(separators)}"
    inner = _leaves_sql(x, finer, depth + 1)
    cut = f"flatten(list_transform(list_filter(list_transform(string_split({text}, {lit}), lambda p{x}, i{x}: CASE WHEN i{x} = 1 THEN p{x} ELSE {lit} || p{x} END), lambda q{x}: q{x} <> ''), lambda {x}: CASE WHEN length({x}) < 1000 THEN [{x}] ELSE list_concat([''], {inner}, ['']) END))"
    return f"CASE WHEN contains({text}, {lit}) THEN {cut} ELSE {_leaves_sql(text, finer, depth + 1)} END"


_WHITE = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}\x{001C}-\x{001F}]+"
SQL["r2_recursive_chunks"] = f"""WITH p AS (SELECT doc_id, list_append({_leaves_sql('text', chunking.SEPARATORS)}, '') AS p FROM documents WHERE text IS NOT NULL),
 l AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM p),
 g AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER w AS g, sum(length(t)) OVER w AS e FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT doc_id, g, list(length(t) ORDER BY i) AS n, min(e - length(t)) AS begin_at FROM g WHERE t <> '' GROUP BY doc_id, g),
 f AS (SELECT doc_id, g, list_reduce(list_append(n, 100000), lambda s, m: CASE WHEN len(s.r) > 0 AND list_sum(s.r) + m > 1000 THEN
   {{'o': list_append(s.o, {{'s': s.p - list_sum(s.r)::BIGINT, 'n': list_sum(s.r)::BIGINT}}), 'p': s.p + m,
     'r': list_append(list_filter(s.r, lambda x, i: list_sum(s.r[i:]) <= least(100, 1000 - m)), m)}}
   ELSE {{'o': s.o, 'p': s.p + m, 'r': list_append(s.r, m)}} END, {{'o': []::STRUCT(s BIGINT, n BIGINT)[], 'p': begin_at::BIGINT, 'r': []::BIGINT[]}}).o AS o FROM s),
 c AS (SELECT doc_id, unnest(o).s AS s, unnest(o).n AS n FROM f),
 r AS (SELECT c.doc_id, c.s, c.n, substr(d.text, c.s + 1, c.n) AS raw FROM c JOIN documents d USING (doc_id)),
 b AS (SELECT doc_id, s + length(raw) - length(regexp_replace(raw, '^{_WHITE}', '')) AS start_index, regexp_replace(raw, '^{_WHITE}|{_WHITE}$', '', 'g') AS chunk, s, n FROM r)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, n) - 1 AS INTEGER) AS chunk_pos, CAST(start_index AS INTEGER) AS start_index, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS digest FROM b WHERE chunk <> ''"""
