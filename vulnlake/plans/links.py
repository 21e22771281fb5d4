"""Queries of the link pipeline: tags, de-duplication, routing, kinds, hashes.

The driver's tables hold no vulnerability links, so addresses are made from keys, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.functions import links as ln
from vulnlake.operators import portfolio as pf
from vulnlake.plans.evaluation import cve_col, cve_sql
from vulnlake.session import table

#: Made addresses; {k} is a key, {h} forty hexadecimal digits of it.
SHAPES = [
    "https://github.com/torvalds/linux/commit/{h}",
    "https://git.kernel.org/stable/c/{h}",
    "https://www.Example.org:8080/files/{k}?x=1",
    "https://github.com/acme/tool.git/pull/{k}",
    "https://github.com/acme/tool/security/advisories/GHSA-{k}",
    "https://github.com/acme/tool/releases/tag/v1/{k}",
    "https://lore.kernel.org/all/{k}",
    "https://git.kernel.org/pub/scm/linux/kernel/git/torvalds/linux.git/commit/?id={h}",
    "no-scheme/{k}",
    "https://github.com/acme",
    "https://github.com/acme/tool",
    "https://github.com/acme/tool/issues/{k}",
    "https://github.com/acme/tool/blob/main/a%20b/{k}.c",
    "https://github.com/acme/tool/compare/v1...v{k}",
    "https://bugzilla.example.net/node/{k}+a%ZZ",
    "https://cgit.kernel.org/x%3Bh={h}",
]


def _made(shape, k, h):
    return F.replace(F.replace(shape, F.lit("{k}"), k.cast("string")), F.lit("{h}"), h)


def links(spark, sf_dir) -> DataFrame:
    """(cve, seq, kind, url): four addresses an order, some of them repeated, with a role each."""
    k = F.col("o_orderkey")
    i = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    rows = table(spark, sf_dir, "orders").select(k, "o_custkey", i)
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), ((k + F.col("i") * F.col("o_custkey")) % len(SHAPES) + 1).cast("int"))
    key = k % 2000
    url = _made(shape, key, F.concat(F.md5(key.cast("string").cast("binary")), F.lit("00000000")))
    return rows.select(cve_col(k % 3000).alias("cve"), (k * 4 + F.col("i")).alias("seq"), F.when((k + F.col("i")) % 3 == 0, "Exploit").otherwise("Patch").alias("kind"), url.alias("url"))


_SHAPES_SQL = "[" + ", ".join(f"'{s}'" for s in SHAPES) + "]"
LINKS_SQL = f"""(SELECT {cve_sql('(o_orderkey % 3000)')} AS cve, o_orderkey * 4 + i AS seq, CASE WHEN (o_orderkey + i) % 3 = 0 THEN 'Exploit' ELSE 'Patch' END AS kind,
 replace(replace({_SHAPES_SQL}[CAST((o_orderkey + i * o_custkey) % {len(SHAPES)} AS INTEGER) + 1], '{{k}}', CAST(o_orderkey % 2000 AS VARCHAR)), '{{h}}', md5(CAST(o_orderkey % 2000 AS VARCHAR)) || '00000000') AS url
 FROM orders, (SELECT unnest([0, 1, 2, 3]) AS i))"""


def f1_f3_grouped_links(spark, sf_dir):
    """Distinct links a CVE, by role, kept if there is any."""
    flat = links(spark, sf_dir).select("cve", "kind", "url").dropDuplicates()
    grouped = flat.groupBy("cve").pivot("kind", ["Patch", "Exploit"]).agg(F.array_sort(F.collect_list("url")))
    kept = grouped.where((F.size("Patch") > 0) | (F.size("Exploit") > 0))
    return kept.select("cve", F.array_join("Patch", " ").alias("patch_links"), F.array_join("Exploit", " ").alias("exploit_links"))


def u2_distinct_links(spark, sf_dir):
    return links(spark, sf_dir).select("cve", "kind", "url").dropDuplicates()


def a3_first_seen_order(spark, sf_dir):
    """Distinct links a CVE in the order in which they are first seen."""
    first = links(spark, sf_dir).groupBy("cve", "url").agg(F.min("seq").alias("seq"))
    return first.groupBy("cve").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "url"))), lambda x: x["url"]), " ").alias("urls"))


def a4_counts_by_year(spark, sf_dir):
    """Distinct CVEs and links a year, and their running totals."""
    from pyspark.sql.window import Window

    year = F.substring("cve", 5, 4).alias("year")
    by = links(spark, sf_dir).groupBy(year).agg(F.count_distinct("cve").alias("cves"), F.count_distinct(F.when(F.col("kind") == "Patch", F.col("url"))).alias("patches"), F.count_distinct(F.when(F.col("kind") == "Exploit", F.col("url"))).alias("exploits"))
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # one row a year
    return by.select("year", "cves", "patches", "exploits", F.sum("cves").over(upto).alias("total_cves"))


def a21_union_distinct(spark, sf_dir):
    rows = links(spark, sf_dir)
    both = rows.where("kind = 'Patch'").select("cve").unionByName(rows.where(ln.is_kernel_git(F.col("url"))).select("cve"))
    return both.agg(F.count_distinct("cve").alias("cves"))


def f2_tagged_references(spark, sf_dir):
    """References whose tags hold Patch or Exploit; a missing tag list holds nothing."""
    k = F.col("o_orderkey")
    tags = F.when(k % 5 == 0, None).when(k % 5 == 1, F.array(F.lit("Patch"), F.lit("Vendor Advisory"))).when(k % 5 == 2, F.array(F.lit("Exploit"))).otherwise(F.array(F.lit("Mailing List")))
    rows = table(spark, sf_dir, "orders").select(k, tags.alias("tags"))
    has = lambda t: F.coalesce(F.array_contains("tags", t), F.lit(False))
    return rows.select("o_orderkey", has("Patch").alias("is_patch"), has("Exploit").alias("is_exploit")).where("is_patch or is_exploit")


def f4_any_criteria(spark, sf_dir):
    """CPE lists of which any names the kernel."""
    k = F.col("p_partkey")
    cpes = F.array(F.concat(F.lit("cpe:2.3:o:Linux:Linux_Kernel:"), k.cast("string")), F.concat(F.lit("cpe:2.3:a:acme:tool:"), k.cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, cpes).otherwise(F.slice(cpes, 2, 1)).alias("c"))
    return rows.where(F.exists("c", lambda x: F.contains(F.lower(x), F.lit("linux")))).select("p_partkey")


def f5_domain_links(spark, sf_dir):
    """Links of one host a CVE; the others never leave the scan."""
    own = links(spark, sf_dir).where(F.contains("url", F.lit("github.com")))
    return own.groupBy("cve").agg(F.array_join(F.array_sort(F.collect_set("url")), " ").alias("urls"))


def f1_s12_accepted(spark, sf_dir):
    """Records that are not rejected, by the window of 120 days that they were published in."""
    status = F.when(F.col("o_orderkey") % 5 == 0, "Rejected").when(F.col("o_orderkey") % 7 == 0, None).otherwise("Analyzed")
    rows = table(spark, sf_dir, "orders").select(status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("published"))
    first = "timestamp '1992-01-01'"
    window = F.expr(f"{first} + make_dt_interval(120 * floor(datediff(published, {first}) / 120))").alias("start")
    return pf.not_rejected(rows, "status").groupBy(window).agg(F.count("*").alias("n"))


def f9_numeric_ids(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(name.alias("id")).where(F.col("id").rlike("^[0-9]+$"))


def c10_commit_hashes(spark, sf_dir):
    return links(spark, sf_dir).select("seq", F.array_join(ln.commit_hashes(F.col("url")), ",").alias("hashes"))


def a19_hash_to_cves(spark, sf_dir):
    rows = links(spark, sf_dir).select("cve", F.explode(ln.commit_hashes(F.col("url"))).alias("hash"))
    return rows.groupBy("hash").agg(F.array_join(F.array_sort(F.collect_set("cve")), ",").alias("cves"))


def c11_kernel_links(spark, sf_dir):
    return links(spark, sf_dir).where(ln.is_kernel_git(F.col("url"))).select("cve", "seq", "url")


def a18_git_buckets(spark, sf_dir):
    return links(spark, sf_dir).groupBy(ln.git_bucket(F.col("url")).alias("bucket")).agg(F.count("*").alias("n"))


def c12_c13_domain_and_number(spark, sf_dir):
    u = F.col("url")
    return links(spark, sf_dir).select("seq", ln.domain(u).alias("domain"), F.coalesce(ln.number_in(u, "/files/"), ln.number_in(u, "/node/")).alias("number"), ln.file_extension(u).alias("extension"))


def c14_c15_repository_items(spark, sf_dir):
    rows = links(spark, sf_dir).where(ln.domain(F.col("url")) == "github.com").select("seq", "url", ln.repository_item(F.col("url")).alias("item"))
    return rows.select("seq", F.col("item.kind").alias("kind"), F.col("item.owner").alias("owner"), F.col("item.repo").alias("repo"), F.col("item.id").alias("id"), ln.api_address(F.col("item")).alias("api"), ln.patch_address(F.col("item")).alias("patch"), ln.cgit_patch_address(F.col("url")).alias("raw"))


def j4_j5_pending(spark, sf_dir):
    """CVEs of an id list that are not completed yet."""
    wanted = table(spark, sf_dir, "supplier").select(cve_col(F.col("s_suppkey")).alias("cve"))
    done = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(cve_col(F.col("s_suppkey")).alias("cve"))
    rows = links(spark, sf_dir).select("cve", "seq")
    return rows.join(wanted, "cve", "left_semi").join(done, "cve", "left_anti")


def j13_cross_roles(spark, sf_dir):
    """A link that another row lists under the other role has that role as well."""
    rows = links(spark, sf_dir).select("cve", "kind", "url").distinct()
    patch, exploit = rows.where("kind = 'Patch'"), rows.where("kind = 'Exploit'")
    more = patch.join(exploit.select("url").distinct(), "url", "left_semi").select("cve", F.lit("Exploit").alias("kind"), "url")
    back = exploit.join(patch.select("url").distinct(), "url", "left_semi").select("cve", F.lit("Patch").alias("kind"), "url")
    return rows.unionByName(more).unionByName(back).distinct()


def c23_flat_links(spark, sf_dir):
    """Nested lists flattened, empty strings dropped."""
    k = F.col("o_orderkey")
    nested = F.array(F.array(F.lit("a"), F.lit("")), F.array(F.concat(F.lit("b"), k.cast("string"))), F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.filter(F.flatten(nested), lambda x: x != ""), ",").alias("flat"))


def u1_union_all(spark, sf_dir):
    rows = links(spark, sf_dir)
    return rows.where("kind = 'Patch'").select("cve", "url").unionByName(rows.where("kind = 'Exploit'").select("cve", "url"))


def u3_right_wins(spark, sf_dir):
    """Two tables under one key; where both have it the right one's value counts."""
    a = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("l"))
    b = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("r-"), F.col("c_mktsegment")).alias("r"))
    return a.join(b, "c_custkey", "full").select("c_custkey", F.coalesce("r", "l").alias("value"))


def u5_except(spark, sf_dir):
    rows = links(spark, sf_dir)
    return rows.where("kind = 'Patch'").select("url").exceptAll(rows.where("kind = 'Exploit'").select("url")).distinct()


QUERIES = {f.__name__: f for f in (f1_f3_grouped_links, u2_distinct_links, a3_first_seen_order, a4_counts_by_year, a21_union_distinct, f2_tagged_references, f4_any_criteria, f5_domain_links, f1_s12_accepted, f9_numeric_ids, c10_commit_hashes, a19_hash_to_cves, c11_kernel_links, a18_git_buckets, c12_c13_domain_and_number, c14_c15_repository_items, j4_j5_pending, j13_cross_roles, c23_flat_links, u1_union_all, u3_right_wins, u5_except)}

_HASH_SQL = "list_sort(list_distinct(list_transform(flatten([" + ", ".join("regexp_extract_all(CASE WHEN url LIKE '%\\%ZZ%' ESCAPE '\\' THEN url ELSE url_decode(url) END, '(?i)" + p + "', 1)" for p in ln.COMMIT_HASH) + "]), lambda h: lower(h))))"
_GIT_SQL = " OR ".join("regexp_matches(url, '(?i)" + p.replace("'", "''") + "')" for p in ln.KERNEL_GIT)
_PARTS_SQL = r"list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')"
_DOMAIN_SQL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
_ITEM_SQL = f"""WITH p AS (SELECT seq, url, {_PARTS_SQL} AS p FROM {LINKS_SQL} WHERE {_DOMAIN_SQL} = 'github.com'), k AS (SELECT *, len(p) AS n,
 CASE WHEN len(p) < 2 THEN NULL WHEN len(p) = 2 THEN 'repo' WHEN p[3] = 'commit' AND len(p) >= 4 THEN 'commit' WHEN p[3] = 'pull' AND len(p) >= 4 THEN 'pull' WHEN p[3] = 'issues' AND len(p) >= 4 THEN 'issue'
 WHEN p[3] = 'security' AND len(p) >= 5 AND p[4] = 'advisories' THEN 'advisory' WHEN p[3] = 'releases' AND len(p) >= 5 AND p[4] = 'tag' THEN 'release' WHEN p[3] = 'blob' AND len(p) >= 5 THEN 'blob' WHEN p[3] = 'compare' AND len(p) >= 4 THEN 'compare' ELSE 'other' END AS kind FROM p),
 i AS (SELECT *, CASE WHEN n >= 2 THEN p[1] END AS owner, CASE WHEN n >= 2 THEN regexp_replace(p[2], '\\.git$', '') END AS repo,
 CASE WHEN kind IN ('commit', 'pull', 'issue') THEN p[4] WHEN kind = 'advisory' THEN p[5] WHEN kind = 'release' THEN array_to_string(p[5:], '/') WHEN kind IN ('blob', 'compare') THEN array_to_string(p[4:], '/') WHEN kind = 'other' THEN array_to_string(p[3:], '/') END AS id FROM k)
SELECT seq, kind, owner, repo, id, CASE kind WHEN 'repo' THEN '' WHEN 'commit' THEN '/commits/' || id WHEN 'pull' THEN '/pulls/' || id WHEN 'issue' THEN '/issues/' || id WHEN 'advisory' THEN '/security-advisories/' || id WHEN 'release' THEN '/releases/tags/' || id WHEN 'compare' THEN '/compare/' || id END AS tail FROM i"""

SQL = {
    "f1_f3_grouped_links": f"SELECT cve, coalesce(string_agg(url, ' ' ORDER BY url) FILTER (kind = 'Patch'), '') AS patch_links, coalesce(string_agg(url, ' ' ORDER BY url) FILTER (kind = 'Exploit'), '') AS exploit_links FROM (SELECT DISTINCT cve, kind, url FROM {LINKS_SQL}) GROUP BY cve",
    "u2_distinct_links": f"SELECT DISTINCT cve, kind, url FROM {LINKS_SQL}",
    "a3_first_seen_order": f"SELECT cve, string_agg(url, ' ' ORDER BY seq) AS urls FROM (SELECT cve, url, min(seq) AS seq FROM {LINKS_SQL} GROUP BY ALL) GROUP BY cve",
    "a4_counts_by_year": f"SELECT *, CAST(sum(cves) OVER (ORDER BY year) AS BIGINT) AS total_cves FROM (SELECT substr(cve, 5, 4) AS year, count(DISTINCT cve) AS cves, count(DISTINCT url) FILTER (kind = 'Patch') AS patches, count(DISTINCT url) FILTER (kind = 'Exploit') AS exploits FROM {LINKS_SQL} GROUP BY 1)",
    "a21_union_distinct": f"SELECT count(DISTINCT cve) AS cves FROM {LINKS_SQL} WHERE kind = 'Patch' OR {_GIT_SQL}",
    "f2_tagged_references": "SELECT o_orderkey, o_orderkey % 5 = 1 AS is_patch, o_orderkey % 5 = 2 AS is_exploit FROM orders WHERE o_orderkey % 5 IN (1, 2)",
    "f4_any_criteria": "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0",
    "f5_domain_links": f"SELECT cve, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls FROM {LINKS_SQL} WHERE contains(url, 'github.com') GROUP BY cve",
    "f1_s12_accepted": "SELECT TIMESTAMP '1992-01-01' + to_days(CAST(120 * (date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 120) AS INTEGER)) AS start, count(*) AS n FROM orders WHERE NOT o_orderkey % 5 = 0 GROUP BY 1",
    "f9_numeric_ids": "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 3 <> 0",
    "c10_commit_hashes": f"SELECT seq, array_to_string({_HASH_SQL}, ',') AS hashes FROM {LINKS_SQL}",
    "a19_hash_to_cves": f"SELECT hash, string_agg(DISTINCT cve, ',' ORDER BY cve) AS cves FROM (SELECT cve, unnest({_HASH_SQL}) AS hash FROM {LINKS_SQL}) GROUP BY hash",
    "c11_kernel_links": f"SELECT cve, seq, url FROM {LINKS_SQL} WHERE {_GIT_SQL}",
    "a18_git_buckets": "SELECT CASE " + " ".join(f"WHEN contains(url, '{b}') THEN '{b}'" for b in ln.GIT_BUCKETS) + f" ELSE 'other' END AS bucket, count(*) AS n FROM {LINKS_SQL} GROUP BY 1",
    "c12_c13_domain_and_number": f"SELECT seq, {_DOMAIN_SQL} AS domain, coalesce(nullif(regexp_extract(url, '/files/(\\d+)', 1), ''), nullif(regexp_extract(url, '/node/(\\d+)', 1), '')) AS number, coalesce(nullif(regexp_extract(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '(\\.[A-Za-z0-9]+)$', 1), ''), '.bin') AS extension FROM {LINKS_SQL}",
    "c14_c15_repository_items": f"SELECT i.seq, i.kind, owner, repo, id, 'https://api.github.com/repos/' || owner || '/' || repo || tail AS api, CASE WHEN i.kind = 'commit' THEN 'https://github.com/' || owner || '/' || repo || '/commit/' || id || '.patch' END AS patch, replace(l.url, '/commit', '/patch') AS raw FROM ({_ITEM_SQL}) i JOIN {LINKS_SQL} l ON i.seq = l.seq",
    "j4_j5_pending": f"SELECT cve, seq FROM {LINKS_SQL} WHERE cve IN (SELECT {cve_sql('s_suppkey')} FROM supplier) AND cve NOT IN (SELECT {cve_sql('s_suppkey')} FROM supplier WHERE s_acctbal > 5000)",
    "j13_cross_roles": f"WITH l AS (SELECT DISTINCT cve, kind, url FROM {LINKS_SQL}) SELECT cve, kind, url FROM l UNION SELECT cve, CASE kind WHEN 'Patch' THEN 'Exploit' ELSE 'Patch' END, url FROM l WHERE EXISTS (SELECT 1 FROM l o WHERE o.url = l.url AND o.kind <> l.kind)",
    "c23_flat_links": "SELECT o_orderkey, 'a,b' || CAST(o_orderkey AS VARCHAR) AS flat FROM orders",
    "u1_union_all": f"SELECT cve, url FROM {LINKS_SQL}",
    "u3_right_wins": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'r-' || c_mktsegment ELSE c_name END AS value FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0",
    "u5_except": f"SELECT url FROM {LINKS_SQL} GROUP BY url HAVING count(*) FILTER (kind = 'Patch') > count(*) FILTER (kind = 'Exploit')",
}
