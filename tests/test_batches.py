"""Greedy batches of long lists beside a plain loop."""

import random

import pytest

from vulnlake.operators import batches, rag


def by_hand(rows, budget):
    out, used, number = [], {}, {}
    for k, pos, tokens in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or 0)):
        size = tokens or 0
        if used.get(k) and used[k] + size > budget:
            used[k], number[k] = 0, number[k] + 1
        used[k], number[k] = used.get(k, 0) + size, number.get(k, 0)
        out.append((k, pos, number[k]))
    return sorted(out)


@pytest.mark.parametrize(("budget", "hops", "high"), [(100, 2, 30), (100, 64, 260), (7, 1, 9), (1, 3, 2), (10_000, 4, 5)])
def test_equal_to_a_loop(spark, budget, hops, high):
    r = random.Random(budget + high)
    rows = [("long", i, r.choice([0, None, r.randint(0, high), r.randint(0, high)])) for i in range(900)] + [(f"k{i % 9}", i, r.randint(0, high)) for i in range(120)] + [("zeros", i, 0) for i in range(5)] + [("late", 0, 0), ("late", 1, 5 * high), ("late", 2, 0), ("late", 3, 1), ("one", 4, 10**7)]
    df = spark.createDataFrame(rows, "name string, place long, n long").repartition(5)
    want = by_hand(rows, budget)
    assert sorted(tuple(x) for x in batches.long_batches(df, "name", "place", "n", budget, hops).collect()) == want
    assert sorted(tuple(x) for x in rag.token_batches(df, "name", "place", "n", budget).collect()) == want


def test_nothing(spark):
    df = spark.createDataFrame([], "name string, place long, n long")
    assert batches.long_batches(df, "name", "place", "n", 5).count() == 0
