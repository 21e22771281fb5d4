"""Queries of the evaluation side: scores, thresholds, metrics, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.functions import scoring
from vulnlake.operators import evaluation as ev
from vulnlake.session import table

_KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in ev.KEYS) + "]"
_KEY = f"{_KEYS_SQL}[CAST(l_partkey % 23 AS INTEGER) + 1]"
_CVE = "'CVE-' || CAST(2000 + {k} % 25 AS VARCHAR) || '-' || lpad(CAST({k} AS VARCHAR), 5, '0')"


def cve_col(k):
    return F.concat(F.lit("CVE-"), (F.lit(2000) + k % 25).cast("string"), F.lit("-"), F.lpad(k.cast("string"), 5, "0"))


def cve_sql(k: str) -> str:
    return _CVE.format(k=k)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged claims made from line items: scores are quarters, so sums are exact."""
    key = F.element_at(F.array(*map(F.lit, ev.KEYS)), (F.col("l_partkey") % 23 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(cve_col(F.col("l_orderkey") % 500).alias("cve"), key.alias("key"), ((F.col("l_quantity") % 5) / 4).alias("score"), "l_linenumber")


CLAIMS_SQL = f"SELECT {cve_sql('(l_orderkey % 500)')} AS cve, {_KEY} AS key, (l_quantity % 5) / 4 AS score, l_linenumber FROM lineitem"
LADDER_SQL = "CASE WHEN {m} > 0.9::DOUBLE THEN 5 WHEN {m} >= 0.7::DOUBLE AND {m} < 0.9::DOUBLE THEN 4 WHEN {m} >= 0.3::DOUBLE AND {m} < 0.7::DOUBLE THEN 3 WHEN {m} >= 0.1::DOUBLE AND {m} < 0.3::DOUBLE THEN 2 WHEN {m} < 0.1::DOUBLE THEN 1 END"


def _points(spark, sf_dir, parity: int) -> DataFrame:
    """Two scorers: claims of odd and of even line numbers."""
    return ev.claim_means(claims(spark, sf_dir).where(F.col("l_linenumber") % 2 == parity)).where("points is not null").select("cve", "key", F.col("points").alias("score"))


_POINTS_SQL = f"WITH c AS ({CLAIMS_SQL}), m AS (SELECT cve, key, l_linenumber % 2 AS p, avg(score) AS mean FROM c GROUP BY ALL), s AS (SELECT cve, key, p, {LADDER_SQL.format(m='mean')} AS score FROM m)"
_THRESHOLD_SQL = f"""{_POINTS_SQL}, d AS (SELECT key, CAST(abs(h.score - l.score) AS DOUBLE) AS d FROM (SELECT * FROM s WHERE p = 0 AND score IS NOT NULL) h JOIN (SELECT * FROM s WHERE p = 1 AND score IS NOT NULL) l USING (cve, key)),
 r AS (SELECT key, d, row_number() OVER (PARTITION BY key ORDER BY d) AS i, count(*) OVER (PARTITION BY key) AS n FROM d),
 q AS (SELECT key, n, CAST(greatest(1, least(n, ceil((n + 1) * (1.0::DOUBLE - 0.1::DOUBLE)))) AS INTEGER) AS k, d, i FROM r),
 t AS (SELECT key, n, k, round_even(d * 10000, 0) / 10000 AS q FROM q WHERE i = k)"""


def a7_c26_claim_ladder(spark, sf_dir):
    return ev.claim_means(claims(spark, sf_dir)).select("cve", F.col("key").alias("attribute_key"), "mean", "points")


def a7_map_mean(spark, sf_dir):
    """The same over maps of claim scores; an empty map has no mean."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("a"), (F.col("o_orderkey") % 5) / 4, F.lit("b"), (F.col("o_custkey") % 5) / 4)).alias("m"))
    return orders.select("o_orderkey", scoring.map_mean(F.col("m")).alias("mean"))


def p17_attribute_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scoring.attribute_key(F.col("p_type"), F.col("p_name")).alias("attribute_key"))


def a8_column_means(spark, sf_dir):
    return ev.column_means(ev.score_matrix(ev.claim_means(claims(spark, sf_dir))))


def a9_row_then_column_mean(spark, sf_dir):
    """Blank and unreadable cells do not count."""
    cells = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 6 == 0, "").when(F.col("o_orderkey") % 6 == 1, "n/a").otherwise((F.col("o_orderkey") % 5 + 1).cast("string")).alias("cell"))
    rows = cells.groupBy("o_custkey").agg(F.avg(F.expr("try_cast(nullif(trim(cell), '') as double)")).alias("row_mean"))
    return rows.select("o_custkey", "row_mean")


def a15_a16_conformal_thresholds(spark, sf_dir):
    return ev.conformal_thresholds(_points(spark, sf_dir, 0), _points(spark, sf_dir, 1)).select("key", F.col("n").cast("long"), F.col("k").cast("int").alias("k"), "q")


def a15_continuous_scores(spark, sf_dir):
    """Thresholds of scores that hardly ever repeat, under few keys."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.abs(F.col("l_extendedprice") / (F.col("l_orderkey") + 1) - F.col("l_discount") * F.col("l_partkey")).alias("d"))
    return ev.kth_smallest(li).select("key", F.col("n").cast("long"), F.col("k").cast("int").alias("k"), "q")


def evaluation_conformal_report(spark, sf_dir):
    means = ev.column_means(ev.score_matrix(ev.claim_means(claims(spark, sf_dir))))
    return ev.conformal_report(means, ev.conformal_thresholds(_points(spark, sf_dir, 0), _points(spark, sf_dir, 1)))


def _names_sql() -> str:
    rows = ", ".join(f"('{k}', '{'Exploit' if a == 'exploit_expl' else ev.CATEGORY_LABELS.get(c, c)}', '{n}', {i})" for i, (k, c, (a, n)) in enumerate(zip(ev.KEYS, ev.ATTRIBUTE_CATEGORIES, ev.ATTRIBUTE_NAMES.items(), strict=True)))
    return f"(VALUES {rows}) AS dim(key, category, attribute, ord)"


_REPORT_SQL = f"""{_THRESHOLD_SQL}, am AS (SELECT cve, key, avg(score) AS mean FROM c GROUP BY ALL),
 cm AS (SELECT key, round_even(avg(CAST({LADDER_SQL.format(m='mean')} AS DOUBLE)) * 100, 0) / 100 AS mean_score FROM am GROUP BY key)
SELECT category, attribute, mean_score, q AS threshold, n, greatest(mean_score - q, 0.0) AS low, least(mean_score + q, 5.0) AS high,
 CASE WHEN q = 0.0 THEN 's' ELSE '^' END AS marker, row_number() OVER (ORDER BY ord) - 1 AS y_pos FROM cm JOIN t USING (key) JOIN {_names_sql()} USING (key)"""


def c27_ordinal_set(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 + 1).alias("y"), (F.col("o_custkey") % 4).alias("q"))
    return rows.select("o_orderkey", F.array_join(scoring.ordinal_set(F.col("y"), F.col("q")), ",").alias("labels"))


def a1x_labels(spark, sf_dir) -> DataFrame:
    """Order status as truth, a rule on price and key as prediction."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("y"), F.when(F.col("o_orderkey") % 4 == 0, "F").when(F.col("o_totalprice") > 250000, "O").otherwise(F.col("o_orderstatus")).alias("yhat"))


_LABELS_SQL = "SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 4 = 0 THEN 'F' WHEN o_totalprice > 250000 THEN 'O' ELSE o_orderstatus END AS yhat FROM orders"
_CM_SQL = f"WITH r AS ({_LABELS_SQL}), l AS (SELECT y AS label FROM r UNION SELECT yhat FROM r), cm AS (SELECT a.label AS y, b.label AS yhat, (SELECT count(*) FROM r WHERE r.y = a.label AND r.yhat = b.label) AS n FROM l a, l b)"
_CLASS_SQL = f"""{_CM_SQL}, k AS (SELECT label, (SELECT sum(n) FROM cm WHERE y = label) AS support, (SELECT sum(n) FROM cm WHERE yhat = label) AS said, (SELECT sum(n) FROM cm WHERE y = label AND yhat = label) AS tp FROM l),
 pr AS (SELECT label, CAST(support AS BIGINT) AS support, tp / (said + 1e-10::DOUBLE) AS precision, tp / (support + 1e-10::DOUBLE) AS recall FROM k),
 f AS (SELECT *, 2 * (precision * recall) / (precision + recall + 1e-10::DOUBLE) AS f1 FROM pr)"""


def a10_confusion(spark, sf_dir):
    return ev.confusion(a1x_labels(spark, sf_dir))


def a12_class_metrics(spark, sf_dir):
    return ev.class_metrics(a10_confusion(spark, sf_dir))


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) for c in df.columns])


def a11_macro_metrics(spark, sf_dir):
    return _rounded(ev.macro_metrics(a12_class_metrics(spark, sf_dir)))


def a13_weighted_metrics(spark, sf_dir):
    return _rounded(ev.weighted_metrics(a12_class_metrics(spark, sf_dir)))


def a11_accuracy(spark, sf_dir):
    return a1x_labels(spark, sf_dir).agg(F.count("*").alias("n"), (F.count_if(F.col("y") == F.col("yhat")) / F.count("*")).alias("accuracy"))


def a5_a6_any_positive(spark, sf_dir):
    """Class of a CVE file: vulnerable if any file of it is; patched ones carry a prefix and are true negatives."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.when(F.col("l_quantity") > 45, 1).when(F.col("l_quantity") < 3, -1).otherwise(0)).alias("v"))
    name = F.concat(F.when(F.col("l_orderkey") % 3 == 0, "P").otherwise(""), cve_col(F.col("l_orderkey")))
    return li.groupBy("l_orderkey").agg(F.max((F.col("v") == 1).cast("int")).alias("predicted"), F.count_if(F.col("v") == -1).alias("unknown"), F.count("*").alias("files")).select(name.alias("cve_file"), F.when(name.startswith("P"), 0).otherwise(1).alias("truth"), "predicted", "unknown", "files")


def _ranked(spark, sf_dir) -> DataFrame:
    """Candidate lists of three; the truth stands at a place that depends on the key, or not at all."""
    k = F.col("o_orderkey")
    at = k % 5
    slot = lambda i: F.when(at == i, cve_col(k)).otherwise(cve_col(k + i + 1))
    lists = F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(slot(0), slot(1), slot(2)))
    return table(spark, sf_dir, "orders").select(cve_col(k).alias("cve"), lists.alias("candidates"))


_RANKED_SQL = f"SELECT {cve_sql('o_orderkey')} AS cve, CASE WHEN o_orderkey % 11 = 0 THEN [] ELSE [" + ", ".join(f"CASE WHEN o_orderkey % 5 = {i} THEN {cve_sql('o_orderkey')} ELSE {cve_sql(f'(o_orderkey + {i + 1})')} END" for i in range(3)) + "] END AS candidates FROM orders"


def a14_identification(spark, sf_dir):
    return ev.identification_accuracy(_ranked(spark, sf_dir))


def w4_truth_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("cve", F.array_position("candidates", F.col("cve")).cast("long").alias("place"))


def j9_a17_conflicts(spark, sf_dir):
    return _conflicts(spark, sf_dir).select("cve", "key", "a_m1", "b_m1", "a_m2", "b_m2")


def _annotator(spark, sf_dir, shift: int) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 300).alias("k"), F.element_at(F.array(*map(F.lit, ev.KEYS)), (F.col("l_partkey") % 23 + 1).cast("int")).alias("key")).agg(F.sum("l_linenumber").alias("s"))
    return li.select(cve_col(F.col("k")).alias("cve"), "key", ((F.col("s") + F.when(F.col("s") % 7 == 0, shift).otherwise(0)) % 5).alias("m1"), ((F.col("s") + F.when(F.col("s") % 11 == 0, shift).otherwise(0)) % 3).alias("m2"))


def _conflicts(spark, sf_dir) -> DataFrame:
    return ev.annotator_conflicts(_annotator(spark, sf_dir, 0), _annotator(spark, sf_dir, 1), ["m1", "m2"])


def _annotator_sql(shift: int) -> str:
    return f"SELECT {cve_sql('k')} AS cve, key, (s + CASE WHEN s % 7 = 0 THEN {shift} ELSE 0 END) % 5 AS m1, (s + CASE WHEN s % 11 = 0 THEN {shift} ELSE 0 END) % 3 AS m2 FROM (SELECT l_orderkey % 300 AS k, {_KEY} AS key, sum(l_linenumber) AS s FROM lineitem GROUP BY ALL)"


_CONFLICT_SQL = f"SELECT cve, key, CAST(a.m1 AS BIGINT) AS a_m1, CAST(b.m1 AS BIGINT) AS b_m1, CAST(a.m2 AS BIGINT) AS a_m2, CAST(b.m2 AS BIGINT) AS b_m2 FROM ({_annotator_sql(0)}) a JOIN ({_annotator_sql(1)}) b USING (cve, key) WHERE a.m1 <> b.m1 OR a.m2 <> b.m2"


def a17_conflict_counts(spark, sf_dir):
    return _conflicts(spark, sf_dir).agg(F.count("*").alias("conflicts"), F.count_distinct("cve").alias("cves"))


def p18_a20_token_usage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 900).alias("p"), (F.col("o_custkey") % 50).alias("c"), F.least(F.col("o_orderkey") % 900, F.col("o_custkey") % 400).alias("h"))
    return o.select("o_custkey", *scoring.token_usage(F.col("p"), F.col("c"), F.col("h")), scoring.billed_input(F.col("p"), F.col("h"), F.col("c")).alias("billed")).groupBy("o_custkey").agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens", "uncached_prompt_tokens", "billed")], F.max("cache_hit_rate").alias("best_rate"))


def j14_f14_questions(spark, sf_dir):
    """Attributes crossed with CVEs, without the excluded ones."""
    dim = ev.attribute_dim(spark).where(~((F.col("category") == "SCORES") & (F.col("attribute") != "score_explain")) & ~F.col("attribute").isin("Code_diff", "Patch_code", "Exploit_Code"))
    cves = table(spark, sf_dir, "supplier").select(cve_col(F.col("s_suppkey")).alias("cve"))
    return cves.join(F.broadcast(dim)).select("cve", "category", "attribute")  # 23 rows at most


def u4_nonconformity(spark, sf_dir):
    """Two scorers' tables of which only some columns agree."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    model = c.where(k % 3 != 0).select("c_custkey", (k % 5).alias("patch"), F.col("c_nationkey").alias("cwe"), k.alias("only_model"))
    human = c.where(k % 2 == 0).select(F.lit(1).alias("only_human"), (k * 7 % 11).alias("cwe"), (k * 3 % 5).alias("patch"), "c_custkey")
    return ev.nonconformity(model, human, "c_custkey")


def t1_t3_sorted_means(spark, sf_dir):
    means = a8_column_means(spark, sf_dir)
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_score"), "key")))


QUERIES = {f.__name__: f for f in (a7_c26_claim_ladder, a7_map_mean, p17_attribute_key, a8_column_means, a9_row_then_column_mean, a15_a16_conformal_thresholds, a15_continuous_scores, evaluation_conformal_report, c27_ordinal_set, a10_confusion, a12_class_metrics, a11_macro_metrics, a13_weighted_metrics, a11_accuracy, a5_a6_any_positive, a14_identification, w4_truth_rank, j9_a17_conflicts, a17_conflict_counts, p18_a20_token_usage, j14_f14_questions, u4_nonconformity, t1_t3_sorted_means)}

_COLUMN_MEANS_SQL = f"WITH c AS ({CLAIMS_SQL}), m AS (SELECT cve, key, avg(score) AS mean FROM c GROUP BY ALL) SELECT key, round_even(avg(CAST({LADDER_SQL.format(m='mean')} AS DOUBLE)) * 100, 0) / 100 AS mean_score FROM m GROUP BY key"

SQL = {
    "u4_nonconformity": "SELECT c_custkey, abs(c_custkey % 5 - c_custkey * 3 % 5) AS patch, abs(c_nationkey - c_custkey * 7 % 11) AS cwe FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0",
    "a7_c26_claim_ladder": f"WITH c AS ({CLAIMS_SQL}), m AS (SELECT cve, key AS attribute_key, avg(score) AS mean FROM c GROUP BY ALL) SELECT *, {LADDER_SQL.format(m='mean')} AS points FROM m",
    "a7_map_mean": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE ((o_orderkey % 5) / 4 + (o_custkey % 5) / 4) / 2 END AS mean FROM orders",
    "p17_attribute_key": "SELECT p_partkey, replace(p_type || '_' || p_name, ' ', '_') AS attribute_key FROM part",
    "a8_column_means": _COLUMN_MEANS_SQL,
    "a9_row_then_column_mean": "SELECT o_custkey, avg(TRY_CAST(CASE WHEN o_orderkey % 6 IN (0, 1) THEN NULL ELSE o_orderkey % 5 + 1 END AS DOUBLE)) AS row_mean FROM orders GROUP BY o_custkey",
    "a15_a16_conformal_thresholds": f"{_THRESHOLD_SQL} SELECT key, n, k, q FROM t",
    "a15_continuous_scores": """WITH d AS (SELECT l_returnflag AS key, abs(l_extendedprice / (l_orderkey + 1) - l_discount * l_partkey) AS d FROM lineitem),
 r AS (SELECT key, d, row_number() OVER (PARTITION BY key ORDER BY d) AS i, count(*) OVER (PARTITION BY key) AS n FROM d WHERE d IS NOT NULL)
SELECT key, n, CAST(i AS INTEGER) AS k, round_even(d * 10000, 0) / 10000 AS q FROM r WHERE i = CAST(greatest(1, least(n, ceil((n + 1) * (1.0::DOUBLE - 0.1::DOUBLE)))) AS BIGINT)""",
    "evaluation_conformal_report": _REPORT_SQL,
    "c27_ordinal_set": "SELECT o_orderkey, array_to_string(list_filter([1, 2, 3, 4, 5], lambda x: abs(x - (o_orderkey % 5 + 1)) <= o_custkey % 4), ',') AS labels FROM orders",
    "a10_confusion": f"{_CM_SQL} SELECT y, yhat, n FROM cm",
    "a12_class_metrics": f"{_CLASS_SQL} SELECT label, support, precision, recall, f1 FROM f",
    "a11_macro_metrics": f"{_CLASS_SQL} SELECT " + ", ".join(f"round(avg({c}), 9) AS macro_{c}" for c in ("precision", "recall", "f1")) + " FROM f",
    "a13_weighted_metrics": f"{_CLASS_SQL} SELECT " + ", ".join(f"round(sum({c} * support) / sum(support), 9) AS weighted_{c}" for c in ("precision", "recall", "f1")) + " FROM f",
    "a11_accuracy": f"SELECT count(*) AS n, count(*) FILTER (y = yhat) / count(*) AS accuracy FROM ({_LABELS_SQL})",
    "a5_a6_any_positive": f"WITH g AS (SELECT l_orderkey, max(CAST(l_quantity > 45 AS INTEGER)) AS predicted, count(*) FILTER (l_quantity < 3) AS unknown, count(*) AS files FROM lineitem GROUP BY l_orderkey) SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'P' ELSE '' END || {cve_sql('l_orderkey')} AS cve_file, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 END AS truth, predicted, unknown, files FROM g",
    "a14_identification": f"SELECT count(*) AS files, count(*) FILTER (candidates[1] = cve) / count(*) AS top1, count(*) FILTER (list_contains(candidates, cve)) / count(*) AS top_any FROM ({_RANKED_SQL})",
    "w4_truth_rank": f"SELECT cve, coalesce(list_position(candidates, cve), 0)::BIGINT AS place FROM ({_RANKED_SQL})",
    "j9_a17_conflicts": _CONFLICT_SQL,
    "a17_conflict_counts": f"SELECT count(*) AS conflicts, count(DISTINCT cve) AS cves FROM ({_CONFLICT_SQL})",
    "p18_a20_token_usage": "WITH u AS (SELECT o_custkey, o_orderkey % 900 AS p, o_custkey % 50 AS c, least(o_orderkey % 900, o_custkey % 400) AS h FROM orders) SELECT o_custkey, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens, CAST(sum(h) AS BIGINT) AS cached_tokens, CAST(sum(p - h) AS BIGINT) AS uncached_prompt_tokens, sum(p - h + 1.25::DOUBLE * c) AS billed, max(CASE WHEN p > 0 THEN round_even(h / p * 10000, 0) / 10000 ELSE 0.0 END) AS best_rate FROM u GROUP BY o_custkey",
    "j14_f14_questions": f"SELECT {cve_sql('s_suppkey')} AS cve, category, attribute FROM supplier, (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in zip(ev.ATTRIBUTE_CATEGORIES, ev.ATTRIBUTE_NAMES, strict=True) if a not in ("Code_diff", "Patch_code", "Exploit_Code")) + ") AS d(category, attribute)",
    "t1_t3_sorted_means": f"SELECT *, row_number() OVER (ORDER BY mean_score DESC, key) AS place FROM ({_COLUMN_MEANS_SQL})",
}
