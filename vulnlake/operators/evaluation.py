"""From judged claims to score matrix, conformal thresholds and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.functions import scoring
from vulnlake.session import materialise

#: Display name of each attribute, in display order.
ATTRIBUTE_NAMES = {
    "Function_name": "Func. Name",
    "File_name": "File Name",
    "Vulnerable_OS_component": "Vuln. OS Comp.",
    "Weakness_Type": "Weakness",
    "root_cause": "Root Cause",
    "secure_coding_violation": "Sec. Violation",
    "mitigation": "Mitigation",
    "cia_impact": "CIA Impact",
    "exploit_expl": "Exploit Expl.",
    "Exploit_Code": "Exploit Code",
    "exploited_versions": "Exploit Vers.",
    "abusable_interfaces": "Abusable Intfs.",
    "exploit_steps": "Exploit Steps",
    "privs_req": "Privs. Req.",
    "exploit_privs": "Exploit Privs.",
    "remote_exploitability": "Remote Exploit.",
    "crash_dump": "Crash Dump",
    "patch_expl": "Patch Expl.",
    "patch_date": "Patch Date",
    "patched_versions": "Patch Vers.",
    "Code_diff": "Code Diff",
    "Patch_code": "Patch Code",
    "score_explain": "Score Expl.",
}
#: Category of each attribute, in the same order.
ATTRIBUTE_CATEGORIES = ["Localization"] * 3 + ["CWE"] + ["Reasoning"] * 4 + ["Exploit"] * 9 + ["Patch"] * 5 + ["SCORES"]
#: Category labels and their order.
CATEGORY_LABELS = {"SCORES": "Impact", "CWE": "Primary", "Localization": "Primary", "Reasoning": "Primary"}
CATEGORY_ORDER = ["Primary", "Exploit", "Patch", "Impact"]

KEYS = [f"{c}_{a}" for c, a in zip(ATTRIBUTE_CATEGORIES, ATTRIBUTE_NAMES, strict=True)]


def attribute_dim(spark) -> DataFrame:
    """(key, category, attribute, ord): 23 rows."""
    rows = [(k, c, a, i) for i, (k, c, a) in enumerate(zip(KEYS, ATTRIBUTE_CATEGORIES, ATTRIBUTE_NAMES, strict=True))]
    return spark.createDataFrame(rows, "key string, category string, attribute string, ord int")


def claim_means(claims: DataFrame) -> DataFrame:
    """(cve, key, mean, points) of claim rows (cve, key, score)."""
    return claims.groupBy("cve", "key").agg(F.avg("score").alias("mean")).withColumn("points", scoring.five_point(F.col("mean")))


def score_matrix(means: DataFrame, value: str = "points") -> DataFrame:
    """One row a CVE, one column an attribute key; the keys are known, so the pivot needs no extra pass."""
    return means.groupBy("cve").pivot("key", KEYS).agg(F.first(value, ignorenulls=True))


def long_scores(matrix: DataFrame) -> DataFrame:
    """(cve, key, score) of a score matrix; empty cells are left out."""
    return matrix.unpivot("cve", KEYS, "key", "score").where(F.col("score").isNotNull())


def column_means(matrix: DataFrame) -> DataFrame:
    """(key, mean_score): one pass over the matrix; empty cells do not count."""
    one = matrix.agg(*[scoring.round_even(F.avg(F.nanvl(F.col(f"`{k}`").cast("double"), F.lit(None))), 2).alias(k) for k in KEYS])
    return one.unpivot([], KEYS, "key", "mean_score")


def conformal_thresholds(human: DataFrame, model: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(key, n, k, q): per attribute the k-th smallest difference between the two scorers, joined on the CVE."""
    diff = human.select("cve", "key", F.col("score").alias("h")).join(model.select("cve", "key", F.col("score").alias("m")), ["cve", "key"]).select("key", F.abs(F.col("h") - F.col("m")).cast("double").alias("d"))
    return kth_smallest(diff, alpha)


def kth_smallest(values: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(key, n, k, q) of (key, d): per key the k-th smallest value by the conformal rank, to 4 digits; nulls don't count.

    Equal values are counted first.  The distinct ones are dealt by ranges of (key, d); the counts of the ranges say which one holds
    a key's k-th, and only that one is sorted.  Where ranges are cut matters for their size, not for the result.
    """
    counts = values.where("d is not null").groupBy("key", "d").agg(F.count("*").alias("c"))
    parted = materialise(counts.repartitionByRange("key", "d").withColumn("part", F.spark_partition_id()), "selection")
    sums = parted.groupBy("key", "part").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("key")
    totals = sums.select("key", "part", "c", F.sum("c").over(w).alias("n"), F.sum("c").over(w.orderBy("part")).alias("upto")).withColumn("k", scoring.conformal_rank(F.col("n"), alpha))
    hit = totals.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k"))).select("key", "part", "n", "k", (F.col("upto") - F.col("c")).alias("before"))
    ranked = parted.join(hit, ["key", "part"]).withColumn("upto", F.col("before") + F.sum("c").over(w.orderBy("d")))
    return ranked.where(F.col("upto") >= F.col("k")).groupBy("key", "n", "k").agg(scoring.round_even(F.min("d"), 4).alias("q"))


def label_column(c: Column, labels: dict[str, str]) -> Column:
    """Rename values by a fixed list; others stay."""
    pairs = [x for kv in labels.items() for x in map(F.lit, kv)]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c)


def conformal_report(means: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The chart's data: names, order, marker and clamped band of every attribute that has both inputs."""
    both = means.join(thresholds, "key")
    parts = F.split("key", "_", 2)
    low, high = scoring.clamp_band(F.col("mean_score"), F.col("threshold"))
    raw = both.select(parts[0].alias("category"), parts[1].alias("attribute"), F.col("q").alias("threshold"), "mean_score", "n")
    named = raw.select(
        F.when(F.col("attribute") == "exploit_expl", "Exploit").otherwise(label_column(F.col("category"), CATEGORY_LABELS)).alias("category"),
        label_column(F.col("attribute"), ATTRIBUTE_NAMES).alias("attribute"),
        "mean_score", "threshold", "n", low.alias("low"), high.alias("high"),
        F.when(F.col("threshold") == 0.0, "s").otherwise("^").alias("marker"),
    )
    place = F.array_position(F.array(*map(F.lit, ATTRIBUTE_NAMES.values())), F.col("attribute"))
    # at most 23 rows reach this window
    return named.withColumn("y_pos", F.row_number().over(Window.orderBy(place)) - 1)


def confusion(rows: DataFrame) -> DataFrame:
    """(y, yhat, n) over all pairs of labels that occur, pairs that do not occur included."""
    found = rows.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    labels = found.select(F.explode(F.array("y", "yhat")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("y")).join(labels.select(F.col("label").alias("yhat")))
    return grid.join(found, ["y", "yhat"], "left").select("y", "yhat", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame, eps: float = 1e-10) -> DataFrame:
    """(label, support, precision, recall, f1) of a confusion matrix."""
    true = matrix.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("tp"))
    said = matrix.groupBy(F.col("yhat").alias("label")).agg(F.sum("n").alias("said"))
    p, r = F.col("tp") / (F.col("said") + eps), F.col("tp") / (F.col("support") + eps)
    return true.join(said, "label").select("label", "support", p.alias("precision"), r.alias("recall")).withColumn("f1", 2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + eps))


def macro_metrics(classes: DataFrame) -> DataFrame:
    return classes.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def weighted_metrics(classes: DataFrame) -> DataFrame:
    total = F.sum("support")
    return classes.agg(*[(F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def identification_accuracy(rows: DataFrame) -> DataFrame:
    """(files, top1, top_any) of (cve, candidates: array<string>); every file counts, the unparsable ones as misses."""
    first = F.try_element_at("candidates", F.lit(1)) == F.col("cve")
    anywhere = F.array_contains("candidates", F.col("cve"))
    return rows.agg(F.count("*").alias("files"), (F.count_if(F.coalesce(first, F.lit(False))) / F.count("*")).alias("top1"), (F.count_if(F.coalesce(anywhere, F.lit(False))) / F.count("*")).alias("top_any"))


def annotator_conflicts(a: DataFrame, b: DataFrame, measures: list[str]) -> DataFrame:
    """Rows (cve, key, measures of both) where two annotators differ in at least one measure."""
    both = a.alias("a").join(b.alias("b"), ["cve", "key"])
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}"))
    return both.where(differs).select("cve", "key", *[F.col(f"{s}.{m}").alias(f"{s}_{m}") for s in "ab" for m in measures])


def common_columns(a: DataFrame, b: DataFrame, key: str) -> list[str]:
    """Columns that both tables have besides the key, in a's order; a question to their schemas, no rows are read."""
    return [c for c in a.columns if c in b.columns and c != key]


def nonconformity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Absolute differences of the common columns, a row a key that both have."""
    both = a.alias("a").join(b.alias("b"), key)
    return both.select(key, *[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(c) for c in common_columns(a, b, key)])
