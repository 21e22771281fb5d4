"""Exact neighbours beside brute force, on data that prunes and data that doesn't, and how much is compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.operators import neighbours


def tables(spark, rows):
    df = spark.createDataFrame(rows, "key string, id string, v array<double>").withColumn("block", F.lit("clash")).withColumn("ring", F.lit(1)).repartition(4)
    return df.where("crc32(id) % 5 = 0").withColumnsRenamed({"id": "query_id", "v": "q"}), df.withColumnRenamed("id", "item_id")


def by_hand(asked, items, n):
    out = []
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    held = [(r["key"], r["item_id"], r["v"]) for r in items.collect() if r["key"] is not None and r["item_id"] is not None and ok(r["v"])]
    for key, q, v in {(r["key"], r["query_id"], tuple(r["q"])) for r in asked.collect() if r["key"] is not None and r["query_id"] is not None and ok(r["q"])}:
        d = sorted((np.floor(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, x, strict=True))) * 1e6 + 0.5) / 1e6, i) for k, i, x in held if k == key and i != q and len(x) == len(v))
        out += [(key, q, i, x, rank) for rank, (x, i) in enumerate(d[:n], 1)]
    return sorted(out)


def clustered(seed, n=600):
    r = np.random.default_rng(seed)
    centres = r.uniform(-100, 100, (12, 3))
    return [("hot" if i % 3 else f"k{i % 7}", f"{i:04}", (centres[i % 12] + r.normal(0, 1, 3)).round(2).tolist()) for i in range(n)]


@pytest.mark.parametrize(("ring", "most"), [(20, 8), (1000, 256), (3, 1)])
def test_equal_to_brute_force_whatever_the_rings(spark, ring, most, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 70)
    rows = clustered(1) + [("hot", f"copy{i}", [1.0, 2.0, 3.0]) for i in range(90)]
    rows += [("hot", "n1", None), ("hot", "n2", [None, 1.0, 2.0]), ("hot", "n3", [float("nan"), 0.0, 0.0]), (None, "n4", [1.0, 1.0, 1.0]), ("hot", None, [1.0, 1.0, 1.0]), ("hot", "d2", [1.0, 1.0]), ("hot", "d2b", [1.0, 2.0]), ("k1", "0001", [0.0, 0.0, 0.0]), ("few", "f1", [1.0, 1.0, 1.0]), ("few", "f2", [1.0, 1.0, 2.0]), ("hot", "copy3", [1.0, 2.0, 3.0])]
    asked, items = tables(spark, rows)
    got = neighbours.nearest(asked, items, "key", 6, ring, most)
    want = by_hand(asked, items, 6)
    assert [x[:2] + x[3:] for x in sorted(tuple(r) for r in got.select("key", "query_id", "item_id", "d", "rank").collect())] == [x[:2] + x[3:] for x in want]
    assert {tuple(r) for r in got.select("key", "query_id", "item_id", "d").collect()} == {x[:4] for x in want}


def test_little_is_compared_where_items_lie_in_groups(spark):
    asked, items = tables(spark, clustered(2, 3000))
    rings, heads = neighbours.index(items, "key", ring=20)
    queries = neighbours.prepared(asked, "key")
    first = neighbours.visits(queries, rings, heads, 5)
    best = neighbours.nearest(asked, items, "key", 5, ring=20).groupBy(F.col("key").alias("k"), F.col("query_id").alias("id")).agg(F.max("d").alias("reach"))
    second = neighbours.visits(queries.join(best, ["k", "id"]), rings, heads, 5, True)
    compared = first.unionAll(second).join(rings.select("ring", "n"), "ring").agg(F.sum("n")).first()[0]
    pairs = asked.groupBy("key").count().join(items.groupBy("key").agg(F.count("*").alias("m")), "key").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    assert compared < 0.2 * pairs, (compared, pairs)
    assert rings.agg(F.max("n")).first()[0] <= 20 and rings.agg(F.sum("n")).first()[0] == 3000


def test_nothing_to_ask_or_to_find(spark):
    asked, items = tables(spark, clustered(3, 60))
    assert neighbours.nearest(asked.limit(0), items, "key", 3).count() == 0
    assert neighbours.nearest(asked, items.limit(0), "key", 3).count() == 0
