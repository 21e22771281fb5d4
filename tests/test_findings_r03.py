"""Faults that showed on larger or odder tables than the given ones, each on a small table that has them."""

import os

import duckdb
import pytest

from vulnlake.plans import registry

SF = "/root/testdata/sf0.001"
#: A CVE's text is cut after five digits: 10000 + 25 i and 100000 + 250 i have the same.
SAME = "CASE WHEN {k} % 2 = 0 THEN 10000 + {k} // 2 * 25 ELSE 100000 + {k} // 2 * 250 END"


def beside_sql(spark, path, name, **tables):
    """Rows of a query and of its SQL over the given tables, each the SQL of one over those of SF; also the tables' folder."""
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW base_{f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    for f in os.listdir(SF):
        own = f.removesuffix(".parquet")
        c.execute(f"COPY ({tables.get(own, f'FROM base_{own}')}) TO '{path}/{f}' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {own} AS SELECT * FROM '{path}/{f}'")
    df = registry.QUERIES[name](spark, str(path))
    plain = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[x]) for x in columns) for r in df.collect())
    found = c.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    return ours, sorted(tuple(plain(r[names.index(x)]) for x in columns) for r in found.fetchall())


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_files_of_colliding_names_meet_their_cve_once(spark, tmp_path):
    ours, theirs = beside_sql(spark, tmp_path, "j12_patched_prefix", customer=f"SELECT * REPLACE ({SAME.format(k='c_custkey')} AS c_custkey) FROM base_customer")
    assert ours == theirs and len(ours) > len(set((r[1], r[2]) for r in ours))


def test_functions_meet_the_orders_of_their_number(spark, tmp_path):
    ours, theirs = beside_sql(spark, tmp_path, "j7_j8_composite", orders=f"SELECT * REPLACE ({SAME.format(k='o_orderkey')} AS o_orderkey) FROM base_orders", lineitem=f"SELECT * REPLACE ({SAME.format(k='l_orderkey')} AS l_orderkey) FROM base_lineitem")
    assert ours == theirs and len(ours) > 0


def test_a_nested_record_is_parsed_once():
    from pyspark.sql import functions as F

    from vulnlake.operators import portfolio

    for use in (portfolio.product_list, portfolio.remediation_list, portfolio.reference_list):
        text = str(use(F.col("p")))
        assert text.count("map<string,string>") + text.count("MapType") + text.count("from_json") <= 6, text


def test_functions_of_a_diff_are_found_in_its_row(spark):
    from vulnlake.plans import changes, texts

    plan = changes.w5_broken_heads(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    diff = "@@ -1 @@ lost(\n" + "diff --git a/a.c b/a.c\n@@ -1 +1 @@ int one(void)\n@@ -1 +1 @@ if (x)\ndiff --git a/b.h b/b.h\n@@ -1 @@ two(\ndiff --git a/a.c b/a.c\r\n@@ -1 @@ three(\ndiff --git a/\n@@ -1 @@ four(\n"
    rows = spark.createDataFrame([(1, diff), (2, None), (3, ""), (4, "diff --git a/x.S b/x.S")], "k long, diff string")
    assert sorted(map(tuple, texts.impacted_functions(rows).collect())) == [(1, "a.c", "one,three"), (1, "b.h", "b.h"), (4, "x.S", "x.S")]


def test_the_selection_needs_no_sketch_of_its_values(spark):
    from pyspark.sql import functions as F

    from vulnlake.operators import evaluation

    df = spark.range(50_000).select(F.concat(F.lit("k"), (F.col("id") % 2).cast("string")).alias("key"), F.rand(3).alias("d"))
    found = evaluation.kth_smallest(df)
    path = found.inputFiles()[0].rsplit("/", 1)[0]
    parts = spark.read.parquet(path).groupBy("part").agg(F.min(F.struct("key", "d")).alias("a"), F.max(F.struct("key", "d")).alias("b")).orderBy("part").collect()
    assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:]))  # ranges in order, so counts alone say which one holds the k-th


def test_few_texts_are_encoded_at_a_time(monkeypatch):
    from vulnlake.operators import rag

    sizes = []

    class Coder:
        def encode_batch(self, texts, add_special_tokens):
            sizes.append(sum(map(len, texts)))
            return [len(t) for t in texts]

    monkeypatch.setitem(rag._CODERS, "fake", Coder())
    texts = ["x" * 5_000] * 1_000 + [None, ""]
    assert list(rag._encodings("fake", texts)) == [5_000] * 1_000 + [0, 0] and max(sizes) <= rag.TOGETHER + 5_000


def test_bugs_without_a_dated_comment_say_nothing(spark, tmp_path):
    sales = "SELECT * REPLACE (CASE WHEN sale_id % 3 = 0 THEN NULL ELSE sold_at END AS sold_at, CASE WHEN sale_id % 2 = 0 THEN 'held' ELSE status END AS status) FROM base_sales"
    ours, theirs = beside_sql(spark, tmp_path, "j1_j2_nested_portfolio", sales=sales)
    assert ours == theirs and len(ours) > 0


@pytest.mark.parametrize("name", ["j1_j2_nested_portfolio", "r1_advisory_documents", "r1_kernel_documents", "r8_truth_by_category"])
def test_records_of_one_cve_each_say_their_own(spark, tmp_path, name):
    tables = {t: f"SELECT * REPLACE ({SAME.format(k='client_id')} AS client_id) FROM base_{t}" for t in ("clients", "client_changes", "sales", "clicks")}
    ours, theirs = beside_sql(spark, tmp_path, name, **tables)
    assert ours == theirs and len(ours) > 0


def test_files_of_ids_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from vulnlake.plans import files

    monkeypatch.setattr(files, "FILES", 5, raising=False)
    path = str(tmp_path / "bodies")
    n = spark.read.parquet(f"{SF}/supplier.parquet").limit(120).count()
    spark.read.parquet(f"{SF}/supplier.parquet").limit(120).write.parquet(str(tmp_path / "supplier.parquet"))
    files._bodies(spark, str(tmp_path), path)
    found = [f for _, _, names in os.walk(path) for f in names if f.endswith(".txt")]
    assert len(found) == n and (n <= 5 or len({f.split("-")[1] for f in found}) > 1)


def test_every_record_of_a_cve_asks_for_its_context(spark, tmp_path):
    again = "SELECT * REPLACE (c_name || ' again' AS c_name) FROM base_customer WHERE c_custkey % 3 = 0"
    colliding = f"SELECT * REPLACE ({SAME.format(k='c_custkey')} AS c_custkey) FROM base_customer WHERE c_custkey % 4 < 2"
    ours, theirs = beside_sql(spark, tmp_path, "chain_links_to_contexts", customer=f"FROM base_customer UNION ALL {again} UNION ALL {colliding} UNION ALL FROM base_customer")
    assert ours == theirs and len(ours) > 0


def test_only_the_heads_of_stretches_are_followed(spark, monkeypatch):
    from vulnlake.operators import batches

    written, write = {}, batches.materialise

    def counted(df, label):
        out = write(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(batches, "materialise", counted)
    rows = spark.range(20_000).selectExpr("id % 2 AS k", "id", "1 + id % 7 AS n")
    assert batches.long_batches(rows, "k", "id", "n", 20, 50).count() == 20_000
    written.pop("batch-rows")
    assert max(written.values()) < 2_000, written  # all else grows with the stretches, not with the rows


def test_copies_of_a_vector_and_blocks_of_queries_add_no_groups(spark, monkeypatch):
    from pyspark.sql import functions as F

    from vulnlake.operators import neighbours

    kept, write = {}, neighbours.materialise

    def seen(df, label):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(neighbours, "materialise", seen)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    df = spark.range(3_000).select(F.lit("a").alias("key"), "id", F.array((F.col("id") % 100).cast("double"), F.lit(0.0)).alias("v"))
    found = neighbours.nearest(df.withColumnsRenamed({"id": "query_id", "v": "q"}), df.withColumnRenamed("id", "item_id"), "key", 2, ring=10).collect()
    mates = {(r["query_id"], r["item_id"], r["rank"]) for r in found}
    want = {(q, [x for x in range(q % 100, 3_000, 100) if x != q][rank - 1], rank) for q in range(3_000) for rank in (1, 2)}
    assert mates == want and kept["neighbour-items"].count() == 300
    asks = neighbours._dealt(kept["neighbour-visits"])
    rows, groups = asks.count(), asks.select("ring", "block").distinct().count()
    assert groups <= asks.select("ring").distinct().count() + rows / 50


def test_classes_of_ids_come_from_all_counts(spark):
    import numpy as np
    import public_tokenizers

    from vulnlake.llm import lm_score

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = lm_score.Subwords(f.read(), public_tokenizers.PATTERN)
    n, r = coder.end + 1, np.random.default_rng(7)
    flat = r.integers(0, 400, 60_000).tolist() + [777] * 5_000  # 777 is in no sample
    pairs = [(int(a) * n + int(b), 1) for a, b in zip([coder.end, *flat], [*flat, coder.end])]
    counted = spark.createDataFrame(pairs, "key long, n long").groupBy("key").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    kind = lm_score.classes_by_counts(counted, coder, lm_score.classes_of([np.array([1, 2, 3], np.int32)], coder))
    assert kind[777] < lm_score.SINGLES and (kind[:400] < lm_score.CLASSES - 2).all() and (kind[50_000:-1] >= lm_score.CLASSES - 2).all()
