"""Threads, batches, tokens, chunks and nearest items beside plain Python."""

import random

import numpy as np
import pytest
from plain_split import split_text
from pyspark.sql import functions as F

from vulnlake.operators import rag


def test_threads_of_any_depth_order_and_faults(spark):
    chain = [(1, 1_000_000 + i, 1_000_000 + i - 1 if i else None) for i in range(500)]
    odd = [(2, 10, None), (2, 9, 10), (2, 11, 10), (2, 100, 9), (2, 5, 77), (2, 6, 5), (2, 20, 21), (2, 21, 20), (2, 22, 21), (2, 30, 30)]
    df = spark.createDataFrame(chain + odd, "conv long, id long, parent long")
    out = rag.thread_order(df).collect()
    assert [(r["id"], r["depth"]) for r in sorted(out, key=lambda r: r["path"]) if r["conv"] == 1] == [(1_000_000 + i, i) for i in range(500)]
    assert [r["id"] for r in sorted(out, key=lambda r: r["path"]) if r["conv"] == 2] == [10, 9, 100, 11]
    assert rag.thread_order(df.limit(0)).count() == 0


def test_two_thread_orders_do_not_meet(spark):
    a = rag.thread_order(spark.createDataFrame([(1, 1, None)], "conv long, id long, parent long"))
    b = rag.thread_order(spark.createDataFrame([(1, 2, None), (1, 3, 2)], "conv long, id long, parent long"))
    assert (a.count(), b.count()) == (1, 2)


def test_batches_equal_a_plain_loop(spark):
    r = random.Random(4)
    rows = [(k, i, r.choice([0, 1, 5, 30, 90, 150, None])) for k in (None, "a", "b", "c") for i in range(300)]
    got = {(x["k"], x["i"]): x["batch"] for x in rag.token_batches(spark.createDataFrame(rows, "k string, i int, t int"), "k", "i", "t", 100).collect()}
    want = {}
    for k in (None, "a", "b", "c"):
        used = batch = 0
        for _, i, t in [x for x in rows if x[0] == k]:
            if used and used + (t or 0) > 100:
                used, batch = 0, batch + 1
            used += t or 0
            want[(k, i)] = batch
    assert got == want


def test_vocabulary_tokens_and_truncation(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    texts = [None, "", "one two  three", "naïve 日本語 text, and more of it " * 5, "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", rag.bpe_token_count(path)("t").alias("n"), rag.bpe_truncated(path, 7)("t").alias("head")).collect():
        ids = library.encode(r["t"] or "", add_special_tokens=False).ids
        assert r["n"] == len(ids)
        assert r["head"] is None if r["t"] is None else r["t"].startswith(r["head"])
        if r["t"] is not None:
            assert r["head"] == r["t"] if len(ids) <= 7 else library.decode(ids[:7]).rstrip("�") in (r["head"], r["head"][:-1])


def test_recursive_pieces_cover_the_text_within_their_limits():
    r = random.Random(9)
    for case in range(60):
        size, overlap = r.choice([(40, 10), (100, 0), (60, 25)])
        word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        text = "".join(r.choice([word(5) + " ", word(11) + " ", "\n", "\n\n", word(r.randint(9, 130)), " "]) for _ in range(r.randint(0, 60)))
        pieces = [p for _, p in split_text(text, size, overlap)]
        at, reached = 0, 0
        for p in pieces:
            assert p and p == p.strip() and len(p) <= size
            start = text.index(p, at)
            assert text[reached:start].strip() == "" or start < reached  # nothing but white space is left out
            assert reached - start <= size
            at, reached = start, max(reached, start + len(p))
        assert text[reached:].strip() == ""


@pytest.mark.parametrize("block", [7, 20_000])
def test_nearest_in_blocks_equals_brute_force(spark, block):
    x = np.round(np.random.default_rng(2).standard_normal((120, 4)), 2)
    x[40:60] = x[0]
    df = spark.createDataFrame([("k", i, v.tolist()) for i, v in enumerate(x)], "key string, id long, v array<double>")
    asked, items = df.where("id % 10 = 0").select("key", F.col("id").alias("query_id"), F.col("v").alias("q")), df.select("key", F.col("id").alias("item_id"), "v")
    got = {}
    for r in sorted(rag.nearest(asked, items, "key", 6, ring=block).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["item_id"])
    for q in range(0, 120, 10):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(axis=1)), 6)
        assert got[q] == [i for i in np.lexsort((np.arange(120), d)).tolist() if i != q][:6]
