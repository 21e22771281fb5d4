"""Chunks beside plain Python, running documents beside their text."""

import random

from plain_split import split_text
from pyspark.sql import functions as F

from vulnlake.operators import chunking, rag


def test_chunks_equal_the_plain_split(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdéñ日😀x") for _ in range(n))
    texts = ["".join(r.choice([word(5) + " ", word(11) + " ", "\n", "\n\n", "\n\n\n", word(r.randint(9, 130)), " ", "\t", " "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    texts += ["", " \n\n ", "x" * 40, "x" * 39, "x" * 41 + " y", "a b " * 100, "\n\n" * 50]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, text string").withColumn("c", F.lit("clash"))
    for size, overlap in [(40, 10), (100, 0), (60, 25)]:
        got = {}
        for x in chunking.chunks(df, "text", size, overlap).orderBy("i", "chunk_pos").collect():
            got.setdefault(x["i"], []).append((x["start_index"], x["chunk"]))
        for i, t in enumerate(texts):
            assert got.get(i, []) == split_text(t, size, overlap), (t, size, overlap)
            assert all(t[s : s + len(c)] == c for s, c in got.get(i, []))
        assert -1 not in got


def test_running_documents_are_views(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", 3, "yy"), ("b", 1, None), ("b", 2, "z"), ("c", 5, "é日"), ("d", 1, None)]
    df = spark.createDataFrame(rows, "k string, p int, t string")
    stored, spans = chunking.running_spans(df, "k", "p", "t", ", ")
    view = {(x["k"], x["p"]): x["document"] for x in chunking.running_view(stored, spans, "k").collect()}
    whole = {(x["k"], x["p"]): x["document"] for x in rag.running_documents(df, "k", "p", "t", ", ").collect()}
    assert view == whole == {("a", 1): "x", ("a", 2): "x", ("a", 3): "x, yy", ("b", 1): "", ("b", 2): "z", ("c", 5): "é日", ("d", 1): ""}
    assert stored.count() == 4
