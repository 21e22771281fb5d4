"""Token counts beside the public library, cohort cells and ranked search beside brute force, and their edge cases."""

import datetime
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vulnlake.llm import cohorts, lexical_search, token_counts

DOC = "doc_id long, text string, key long, token string, freq long, n long, id long, terms string, item string"
PIECES = "aá日본ñz éxyz  \n\t▁<s>0-'é́😀\x00"


def odd_text(r, n):
    return "".join(r.choice(PIECES) for _ in range(r.randint(0, n)))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    plain = ["".join(r.choice(["the ", "and", "ation ", "12", "日本語", " x", "\n", "Straße "]) for _ in range(r.randint(0, 200))) for _ in range(300)]
    return [None, "", " ", "  ", "a" * 3000, " " * 500, "<s>hi</s>", "the " * 2000] + [odd_text(r, 60) for _ in range(300)] + plain + plain[:20]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 1, "x", 2, 3, 4, "y", "z") for i, t in enumerate(texts)] + [(None, "lost id", 1, "x", 2, 3, 4, "y", "z"), (5, texts[5], 1, "x", 2, 3, 4, "y", "z")]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.mark.parametrize("most_common", [token_counts.MOST_COMMON, 50, 0])
def test_token_counts_are_the_library_s(docs, most_common):
    """Whatever is looked up and whatever is joined."""
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    key = lambda r: (r[0] is None, r)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 100) for r in docs.collect()), key=key)
    got = token_counts.count_tokens(docs, path, limit=100, most_common=most_common)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_token_counts_of_nothing_and_of_long_texts(spark, docs, monkeypatch):
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    pieces = token_counts.Pieces(token_counts.load_pieces(path))
    text = "some words  and 日本 " * 300
    whole = [w for words in pieces.words(text) for w in words]
    assert "".join(whole) == "▁" + text.replace(" ", "▁") and [w for words in pieces.words("a b\nc") for w in words] == ["▁a", "▁b\nc"]
    monkeypatch.setattr(token_counts, "LONG_TEXT", 10)
    monkeypatch.setattr(token_counts, "BATCH", 7)
    assert [w for words in pieces.words(text) for w in words] == whole
    with pytest.raises(ValueError):
        token_counts.Pieces({"a▁b": -1.0})


def crc(x):
    return zlib.crc32(str(x).encode())


def cells_by_hand(clicks, clients, until):
    week = datetime.timedelta(days=7)
    rows = {r for r in clicks if r[1] is not None and r[3] is not None}
    source = {}
    for c, s in clients:
        source[c] = min([x for x in (s, source.get(c)) if x is not None], default=None)
    starts, known = [{}, {}], [[], []]
    for r in rows:
        arrival = r[2]
        if arrival is not None and r[0] is not None and crc(r[0]) % 3 == 0:
            arrival += datetime.timedelta(days=crc(r[0]) % 100)
        for state in (0, 1):
            if state or (arrival is not None and arrival < until):
                known[state].append(r)
                if r[4] == "error":
                    starts[state][r[3]] = min(r[1], starts[state].get(r[3], r[1]))
    cohort = lambda t: (t - datetime.datetime(1970, 1, 1)).days // 7
    users, cents = defaultdict(set), Counter()
    for state in (0, 1):
        for r in known[state]:
            s = starts[state].get(r[3])
            if s is not None and r[1] >= s:
                cell = (state, source.get(r[3]) or "", cohort(s), (r[1] - s) // week)
                users[cell].add(r[3])
                cents[cell] += math.floor(100 * r[5] + 0.5) if r[5] is not None and math.isfinite(r[5]) else 0
    moved = {c for c in starts[0] if c in starts[1] and cohort(starts[0][c]) != cohort(starts[1][c])}
    return sorted((*cell, len(u), sum(map(crc, u)), len(u & moved), cents[cell]) for cell, u in users.items())


CLICK = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, state int, segment string"


@pytest.mark.parametrize("bits", [3, 12])
def test_cohort_cells_equal_brute_force(spark, bits, monkeypatch):
    """A hot client, repeated and broken rows, late arrivals, starts on the microsecond of a week; flushes in between."""
    monkeypatch.setattr(cohorts, "HELD", 50)
    r, day = random.Random(2), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        ts = day + datetime.timedelta(days=r.randint(0, 60), microseconds=r.choice([0, 0, 1, 86_399_999_999]))
        rows.append((i, None if r.random() < 0.02 else ts, None if r.random() < 0.02 else ts + datetime.timedelta(hours=r.randint(0, 30)), r.choice([7, 7, None if r.random() < 0.1 else r.randint(0, 60)]), r.choice(["error", "view", None]), r.choice([None, 1.005, -3.335, 2.0, float("nan"), float("inf"), 7.125]), 9, "clash"))
    rows += rows[:40] + [(None, day, day, 3, "error", 1.0, 9, "clash")]
    people = [(i, r.choice(["web", "crm", None])) for i in range(50)] + [(4, "abc"), (None, "web")]
    clicks = spark.createDataFrame(rows, CLICK).repartition(4)
    clients = spark.createDataFrame(people, "client_id long, source string").withColumn("id", F.lit("clash"))
    got = cohorts.retention(clicks, clients, bits=bits)
    until = datetime.datetime(2024, 2, 1)
    want = cells_by_hand([x if x[5] is None or math.isfinite(x[5]) else (*x[:5], None, *x[6:]) for x in rows], people, until)
    assert sorted(tuple(x) for x in got.select("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents").collect()) == want
    assert any(w[6] for w in want) and any(w[0] == 0 for w in want)
    assert cohorts.retention(clicks.limit(0), clients).count() == 0
    assert all(x["segment"] == "" for x in cohorts.retention(clicks, clients.limit(0)).collect())


def test_packed_bitmaps_merge():
    r = np.random.default_rng(1)
    row, want = np.zeros(512, np.uint8), set()
    for n in (0, 1, 5, 255, 256, 3000):
        lows = np.sort(r.choice(4096, n, replace=False))
        packed = cohorts.pack(lows, 12)
        assert len(packed) <= 513
        cohorts.merge_into(row, packed)
        want |= set(lows.tolist())
    assert set(np.flatnonzero(np.unpackbits(row, bitorder="little")).tolist()) == want


def ranking_by_hand(docs, items, k):
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(of(t))) for i, t in docs if of(t)]
    n, length = len(counted), sum(c.total() for _, c in counted)
    out = []
    for item, text in items:
        found = []
        for i, c in counted:
            m, score = 25 + (75 * c.total() * n) // length, 0
            for t in of(text):
                if t in c:
                    df = sum(t in x for _, x in counted)
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=lambda x: (x[0], x[1]))


@pytest.fixture(scope="module")
def library(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x-y", "A1", "_"]
    rows = [(i, " ".join(r.choice(words[: r.choice([10, 65])]) for _ in range(r.choice([0, 3, 30, 400])))) for i in range(400)]
    rows += [(i, rows[7][1] or "w1 w2 w3") for i in range(400, 700)] + [(None, "w1 w50 w51"), (3, rows[3][1]), (9, None), (10, " - \n")]
    items = [(1, "w1 w2 W3 w3 日本"), (2, rows[7][1] or "w1 w2 w3"), (2, "w50 w51"), (3, None), (4, "--"), (5, "never seen"), (6, " ".join(words)), (7, "w59"), (7, "w59")]
    return spark.createDataFrame([(*x, 1, "t", 2, 3, 4, "u", "v") for x in rows], DOC).repartition(3), rows, items


@pytest.mark.parametrize("size", [4_000_000, 600])
def test_ranked_search_equals_brute_force(spark, library, size, monkeypatch):
    """Ties among many copies; blocks of items and of documents; ranges walked in small groups."""
    docs, rows, items = library
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 90)
    monkeypatch.setattr(lexical_search, "CELLS", 200)
    got = lexical_search.rank_documents(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)), 10, item_bytes=size)
    want = ranking_by_hand(rows, [x for x in dict.fromkeys(items) if x[1] is not None], 10)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=lambda x: (x[0], x[1], x[3])) == sorted(want, key=lambda x: (x[0], x[1], x[3]))
    assert lexical_search.rank_documents(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical_search.rank_documents(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_treaps_are_ordered_and_prune():
    """Heap by impact, search tree by document, every posting reached once; few documents are scored where few can win."""
    r = np.random.default_rng(3)
    n = 5000
    impacts = r.integers(1, 50, 3 * n)
    t = lexical_search.Treaps(np.repeat([4, 7, 9], n), np.tile(np.arange(n), 3), impacts)
    for term, root in t.roots.items():
        stack, docs = [(root, -1, n, 10**9, 1)], []
        while stack:
            x, low, high, above, depth = stack.pop()
            if x:
                assert low < t.doc[x] < high and t.impact[x] <= above and depth < 120, term
                docs.append(t.doc[x])
                stack += [(t.left[x], low, t.doc[x], t.impact[x], depth + 1), (t.right[x], t.doc[x], high, t.impact[x], depth + 1)]
        assert sorted(docs) == list(range(n))
    terms, weights = np.array([4, 7, 9, 11]), np.array([3, 2, 1, 5])
    doc, score, seen = t.search(terms, weights, n, 10)
    whole = impacts.reshape(3, n).T @ weights[:3]
    best = np.lexsort((np.arange(n), -whole))[:10]
    assert doc.tolist() == best.tolist() and score.tolist() == whole[best].tolist() and seen < n / 4


def test_preferences_differ_in_the_last_reply(spark):
    """Shared prefixes of every length, other replies that are missing or equal, negative and very large ids."""
    from vulnlake.llm import chat_format

    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (0, 3, "assistant", "b"), (1, 0, "user", "z"), (1, 1, "assistant", "c"), (2, 0, "user", "only"), (3, 0, "assistant", "d"), (4, 0, "user", "alone"), (6, 0, "user", "x"), (6, 1, "assistant", "same"), (7, 0, "user", "y"), (7, 1, "assistant", "same"), (None, 0, "user", "lost"), (-2, 0, None, None), (-1, 0, "assistant", "neg"), (2**60, 0, "user", "u"), (2**60 + 1, 0, "assistant", "v")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("last", F.lit("clash"))
    out = {r["pair_id"]: r for r in chat_format.format_preferences(*chat_format.pair_other_replies(df)).collect()}
    said = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(out) == {0, 1, 2, 3, 4, 6, 7, -2, -1, 2**60, 2**60 + 1}
    assert out[0]["prompt_turns"] == 3 and out[0]["prompt"] == said("user", "q") + said("assistant", "a") + said("user", "more")
    assert out[0]["chosen"] == said("assistant", "b") and out[0]["rejected"] == said("assistant", "c")
    assert out[1]["prompt"] == said("user", "z") and out[1]["rejected"] == said("assistant", "b")
    assert out[2]["prompt"] == said("user", "only") and out[2]["chosen"] == "" and out[2]["rejected"] == said("assistant", "d")
    assert out[3]["rejected"] is None and out[4]["rejected"] is None and out[4]["chosen"] == said("user", "alone") and out[-1]["rejected"] is None
    assert out[6]["chosen"] == out[6]["rejected"] == "" and out[6]["prompt_turns"] == 2
    assert out[-2]["rejected"] == said("assistant", "neg") and out[2**60]["rejected"] == said("assistant", "v")
    assert chat_format.format_preferences(*chat_format.pair_other_replies(df.limit(0))).count() == 0


def test_paraphrases_of_short_items_are_found(spark):
    """Items of 5 to 12 words, planted with each word replaced at a chance of 20 %: those that the checks would confirm are found."""
    from vulnlake.llm import decontaminate

    r = random.Random(12)
    lexicon = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(700)]
    word = lambda: lexicon[min(int(r.paretovariate(0.6)) - 1, 699)]
    items = [(i, " ".join(word() for _ in range(r.randint(5, 12)))) for i in range(400)]
    texts, sure = [], []
    for i, t in items:
        words = t.split()
        kept = [r.random() >= 0.2 for _ in words]
        said = [w if k else f"new{r.randint(0, 99)}" for w, k in zip(words, kept, strict=True)]
        body = " ".join([*(word() for _ in range(r.randint(0, 60))), *said, *(word() for _ in range(r.randint(0, 60)))])
        texts.append((1000 + i, body))
        answer = kept[-max(1, len(words) // 4) :]
        share = sum(kept) / len(words)
        if share >= 0.8 or (share >= 0.6 and 3 * sum(answer) >= 2 * len(answer)):
            sure.append((1000 + i, i))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, decontaminate.fit_space(docs, bench)).collect()}
    assert len(sure) > 250 and len(found & set(sure)) >= 0.97 * len(sure)


def test_the_attention_is_improved_on_all_learning_texts(spark):
    """Averages over tasks lower the loss, move the ids that each task met, and weigh tasks by what they read."""
    from vulnlake.llm import lm_score

    r = np.random.default_rng(4)
    n, kinds = 60, lm_score.CLASSES
    kind = (np.arange(n + 1) % kinds).astype(np.int64)
    table = np.zeros((n + 1, kinds), np.float32)
    texts = [np.repeat(r.integers(0, n // 2, 30), 2).astype(np.int32) + (n // 2 if i % 2 else 0) for i in range(60)]  # ids come in pairs: what was last comes again
    rows = [(i, t.astype(lm_score._number(n)).tobytes(), i % 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "rid long, ids binary, part int").repartitionByRange(2, "part").select("rid", "ids")
    f = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
    p = {"e": f(n + 1, lm_score.WIDTH), "q": f(lm_score.WIDTH, lm_score.HEAD), "k": f(lm_score.WIDTH, lm_score.HEAD), "v": f(lm_score.WIDTH, lm_score.HEAD), "o": f(lm_score.HEAD, kinds), "b": np.zeros(lm_score.KEYS, np.float32)}
    x, y, first, valid, _ = lm_score.blocks(texts, n)
    seen = np.concatenate([x[np.maximum(np.arange(len(x)) - 1, 0), lm_score.STRIDE - lm_score.PAST :], x], axis=1)
    loss = lambda p: lm_score.gradients(p, x, seen, kind[y], first, valid, table)[0]
    losses, now = [loss(p)], p
    for turn in range(6):
        now = lm_score._improve(df, now, kind, table, n, turn, share=1)
        losses.append(loss(now))
    assert all(b < a for a, b in zip(losses, losses[1:], strict=False)), losses
    assert (np.abs(now["e"] - p["e"]).max(axis=1) > 0).all() and set(now) == set(p)
    again = lm_score._improve(df, p, kind, table, n, 0, share=1)
    assert all(np.allclose(again[name], lm_score._improve(df, p, kind, table, n, 0, share=1)[name]) for name in p)
    same = lm_score._improve(df.limit(0), p, kind, table, n, 0)
    assert all((same[name] == p[name]).all() for name in p)
    assert lm_score._unpack([texts[0].astype("<u2").tobytes(), b""], n)[0].tolist() == texts[0].tolist() and lm_score._number(70_000) == np.dtype("<i4")
