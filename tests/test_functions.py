"""Functions and operators against plain Python statements of their rules."""

import math
import random
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.functions import code, links, scoring
from vulnlake.functions import text as tx
from vulnlake.operators import evaluation as ev
from vulnlake.operators import chunking, html, rag


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("mean, points", [(0.9, None), (0.95, 5), (0.7, 4), (0.3, 3), (0.1, 2), (0.0, 1), (None, None)])
def test_ladder(spark, mean, points):
    df = spark.createDataFrame([(mean,)], "m double")
    assert df.select(scoring.five_point(F.col("m"))).first()[0] == points


def test_rounding_is_half_even(spark):
    grid = [i / 1000 for i in range(5001)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in grid], "x double").select(scoring.round_even(F.col("x"), 2)).collect()]
    assert got == [float(np.round(x, 2)) for x in grid]


@pytest.mark.parametrize("n", [1, 7, 9, 10, 100])
def test_conformal_threshold(spark, n):
    rng = random.Random(n)
    h, m = [rng.randint(1, 5) for _ in range(n)], [rng.randint(1, 5) for _ in range(n)]
    rows = lambda v: spark.createDataFrame([(str(i), "k", x) for i, x in enumerate(v)], "cve string, key string, score int")
    got = ev.conformal_thresholds(rows(h), rows(m)).first()
    k = min(n, max(1, math.ceil((n + 1) * (1 - 0.1))))
    assert (got["n"], got["k"], got["q"]) == (n, k, sorted(abs(a - b) for a, b in zip(h, m, strict=True))[k - 1])


def test_one_class_confusion(spark):
    cm = ev.confusion(spark.createDataFrame([("a", "a")] * 3, "y string, yhat string"))
    assert [tuple(r) for r in cm.collect()] == [("a", "a", 3)]
    assert round(ev.macro_metrics(ev.class_metrics(cm)).first()["macro_f1"], 6) == 1


def test_identification_counts_every_file(spark):
    rows = spark.createDataFrame([("a", ["a", "b"]), ("b", ["a", "b"]), ("c", []), ("d", None), ("e", list("vwxyze"))], "cve string, candidates array<string>")
    got = ev.identification_accuracy(rows).first()
    assert (got["files"], got["top1"], got["top_any"]) == (5, 0.2, 0.6)


@pytest.mark.parametrize("raw", ["a b\x1cc  d\n", " x ", "", " \x85y", "no"])
def test_collapse_space(spark, raw):
    assert one(spark, raw, tx.collapse_space) == " ".join(raw.split())


@pytest.mark.parametrize("raw", ["a\nb\n", "a\r\nb", "\n", "a b\x0bc", "x y", "a\n\nb"])
def test_lines(spark, raw):
    assert one(spark, raw, tx.lines) == raw.splitlines()


def test_commit_message(spark):
    assert one(spark, "Cc: a\ncommit " + "a" * 40 + "\n", tx.clean_commit_message) == tx.ONLY_METADATA
    assert one(spark, "fix\n\n  Acked-by: b\n  body\n", tx.clean_commit_message) == "fix\n\n  body"


@pytest.mark.parametrize("url, host", [("https://www.Ex.org:80/a", "ex.org:80"), ("http://u@ex.org?x", "u@ex.org"), ("ex.org/a", ""), ("https://a b/c", "a b")])
def test_domain(spark, url, host):
    assert one(spark, url, links.domain) == host


@pytest.mark.parametrize("url", ["a+b", "a%20b", "%E9", "plain", "a%3Bh=x"])
def test_decoding(spark, url):
    want = urllib.parse.unquote(url)
    assert one(spark, url, links.decoded) in (want, url)


def test_commit_hash_forms(spark):
    h = "0123456789abcdef0123456789abcdef01234567"
    for url in (f"https://git.kernel.org/linus/{h[:12].upper()}", f"https://x/commit/?id={h}", f"https://x/y%3Bh={h}", f"https://x/{h}/"):
        got = one(spark, url, links.commit_hashes)
        assert got and all(h.startswith(g) for g in got)
    assert one(spark, "https://x/nothing", links.commit_hashes) == []


@pytest.mark.parametrize("context, name", [("static int foo(struct x *y)", "foo"), ("do_##name(a)", "do_##name"), ("SOME_MACRO(x)", None), ("#define f(x)", None), ("if (x)", None), ("/* g( */ int h(void) {", "h"), ("", None)])
def test_hunk_function(spark, context, name):
    assert one(spark, context, code.hunk_function) == name


def test_added_lines(spark):
    assert one(spark, "+++ b/x\n+a\n-b\n+\n c", code.added_lines) == "a\n"


def test_chunks_cover_the_text(spark):
    split = lambda t, size, overlap: [c["text"] for c in one(spark, t, lambda c: chunking.chunk_list(c, size, overlap))]
    rng = random.Random(1)
    text = "".join(rng.choice([f"w{i} ", f"longerword{i} ", "\n", "\n\n", f"{i}" + "x" * 30 + " "]) for i in range(2000))
    pieces = split(text, 200, 40)
    assert all(0 < len(p) <= 200 for p in pieces)
    at = 0
    for p in pieces:
        start = text.find(p, max(0, at - 80))
        assert start >= 0 and not text[at:start].strip()
        at = start + len(p)
    assert not text[at:].strip() and split("y" * 450, 200, 40)[0] == "y" * 200 and split("", 10, 2) == []


def test_token_batches(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 150)) for k in range(5) for i in range(40)]
    got = {(r["k"], r["p"]): r["batch"] for r in rag.token_batches(spark.createDataFrame(rows, "k int, p int, t int"), "k", "p", "t", 120).collect()}
    for k in range(5):
        used = batch = 0
        for _, i, t in (r for r in rows if r[0] == k):
            if used and used + t > 120:
                batch, used = batch + 1, 0
            used += t
            assert got[k, i] == batch


def test_mmr_prefers_unlike_items():
    items = np.array([[1.0, 0.0], [0.999, 0.01], [0.6, 0.8]])
    assert rag.mmr_order(np.array([1.0, 0.1]), items, 2)[1] == 2
    assert rag.mmr_order(np.array([1.0, 0.0]), items, 9, weight=1.0) == [0, 1, 2]


def test_open_tags_and_links():
    page = html.parse("<ul><li>a<li><a href=x>b</a></ul><p>one<p>two<script>var t='</p>'</script>")
    assert [li.text() for li in page.all("li")] == ["a", "b"] and [p.text() for p in page.all("p")] == ["one", "two"]
    assert html.outline(page)["links"] == [{"href": "x", "text": "b"}]
    assert html.outline(html.parse(None)) == {"title": None, "h1": None, "links": []}


@pytest.mark.parametrize("kind", sorted(html.EXTRACTORS))
def test_extractors_bear_any_page(kind):
    for page in (None, "", "<p>", "<table><tr><td>x", "<h1></h1><h2>Summary</h2>", "text"):
        assert isinstance(html.EXTRACTORS[kind](html.parse(page)), dict)
