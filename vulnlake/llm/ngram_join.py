"""N-gram Jaccard self-join by prefix trees, with connected components.

1. Every text becomes the set of its word 5-grams (64-bit hashes).  Hashes go, in compact blocks, to the bucket of their
   leading bits, where those that only one text holds are found and left behind: they are in no intersection.  A hash
   that many texts of one block hold is known to be shared; it sends only a count, so a very common hash does not gather
   in one bucket.  The global order is (number of texts up to CAP, hash).
2. A text of which less than 75 % of the set is shared has no links.  The others keep their shared hashes in the global
   order.  Texts with the same, wholly shared set become one node.
3. Two linked nodes have a hash in common among the first n - ceil(0.75 n) + 1 of each.  Under each such hash the nodes
   are compared with two centres; what these exact links join is joined for good, at a cost linear in the list's length.
4. Hashes whose nodes are by then all in one component need no more work.  Nodes that the other hashes connect form
   clusters; inside a cluster (split into blocks, so that no task holds more than two of them) all links between different
   components are found by walking a prefix tree.
5. Components of all links, and the smallest id in each.

The tree holds the sets of a group, most common hash first.  A walk for one set carries the overlap so far down the
tree, so sets that begin alike share that work, and leaves a subtree as soon as the overlap plus what can still come
(the shorter of both remainders) is below what the smallest set in the subtree needs, or when all of the subtree is in
the walker's component.

No pair is dropped: the order, the centres and the clusters only decide which comparisons are already settled.

Defined cases: null and empty texts (and those of white space) have an empty set, size 0, and are linked with nothing; a
text with fewer than five words has one shingle, its whole sequence; repeated rows are rows of their own and link with
each other; rows with a null id take part, but a component's id is its smallest id that is not null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import materialise, partitions, release, slices, words_of

N, CAP, BLOCK = 5, 16, 1024
#: Hot keys are broadcast if there are at most so many; and linked sets' sizes are in the same class or in neighbouring ones.
BROADCAST, SIZE_STEP = 200_000, 1.3334
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL[0]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams."""
    split = [words_of(t) for t in texts]
    digest = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*split)}
    out = []
    for words in split:
        h = np.fromiter(map(digest.__getitem__, words), np.uint64, len(words))
        if not len(h):
            out.append(h)
            continue
        k = min(n, len(h))
        code = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            code = _mix((code + h[i : len(h) - k + 1 + i]) * _MUL[i % 5])
        out.append(np.unique(code))
    return out


def needed(a: int, b: int) -> int:
    """Smallest intersection with which sets of these sizes link: 100 i >= 75 (a + b - i)."""
    return -(-3 * (a + b) // 7)


def _pack(rid: np.ndarray, token: np.ndarray) -> bytes:
    """Rows sorted by rid; the token's top byte follows from its bucket and is left out."""
    gap = np.diff(rid, prepend=rid[:1])
    kind = np.uint16 if gap.max() < 1 << 16 else np.uint32 if gap.max() < 1 << 32 else np.int64
    head = np.array([rid[0], len(rid), np.dtype(kind).itemsize], np.int64).tobytes()
    return head + gap.astype(kind).tobytes() + np.ascontiguousarray(token.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack(blob: bytes, top: int) -> tuple[np.ndarray, np.ndarray]:
    first, n, width = np.frombuffer(blob, np.int64, 3)
    kind = {2: np.uint16, 4: np.uint32, 8: np.int64}[int(width)]
    rid = first + np.cumsum(np.frombuffer(blob, kind, n, 24).astype(np.int64))
    token = np.zeros((n, 8), np.uint8)
    token[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, 24 + int(width) * n).reshape(-1, 7)
    token[:, 7] = top
    return rid, token.view(np.uint64).ravel()


#: What a text keeps: its row, set size, and (order, hash) of a shared n-gram; order 0 stands for the row alone.
KEPT = np.dtype([("rid", np.int64), ("n", np.uint32), ("order", np.uint8), ("token", np.uint64)])


def _shared_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, n, kept): kept has the shared hashes in the global order, or is null where they are too few."""
    spark = docs.sparkSession
    width = partitions(spark)
    bits = max(11, int(np.ceil(np.log2(8 * width))))
    homes = max(256, 2 * width)
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "load"])

    def spread(batches):
        for batch in batches:
            all_rids = batch.column(0).to_numpy()
            for start, texts in slices(batch.column(2), 4_000_000):
                sets = shingle_sets(texts)
                rids = all_rids[start : start + len(texts)]
                sizes = np.array([len(s) for s in sets])
                ids = batch.column(1).slice(start, len(texts))
                rows = [(int(xxhash.xxh3_64_intdigest(rids[0].tobytes()) % (1 << bits)), 3, np.rec.fromarrays([rids, sizes.astype(np.uint32), np.asarray(ids.is_valid()), ids.fill_null(0).to_numpy(zero_copy_only=False)], dtype=ROW).tobytes())]
                token = np.concatenate(sets)
                if len(token):
                    rid, size = np.repeat(rids, sizes), np.repeat(sizes, sizes).astype(np.uint32)
                    distinct, at, count = np.unique(token, return_inverse=True, return_counts=True)
                    often = count >= CAP
                    hot = often[at]
                    if hot.any():
                        shared = np.rec.fromarrays([rid[hot], size[hot], np.full(hot.sum(), CAP, np.uint8), token[hot]], dtype=KEPT)
                        rows.append((rows[0][0], 1, shared.tobytes()))
                        for t in distinct[often]:
                            rows.append((int(t >> np.uint64(64 - bits)), 2, t.tobytes()))
                    token, rid = token[~hot], rid[~hot]
                    bucket = (token >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                    turn = np.argsort(bucket, kind="stable")
                    bucket, token, rid = bucket[turn], token[turn], rid[turn]
                    ends = [*(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)] if len(bucket) else []
                    a = 0
                    for b in ends:
                        rows.append((int(bucket[a]), 0, _pack(rid[a:b], token[a:b])))
                        a = b
                for i in range(0, len(rows), 2048):
                    yield frame(rows[i : i + 2048])

    def share(key, table):
        bucket = key[0].as_py()
        kinds, loads = table.column("kind").to_pylist(), table.column("load").to_pylist()
        found = [np.frombuffer(x, KEPT) for k, x in zip(kinds, loads, strict=True) if k == 1]
        rows = [np.frombuffer(x, ROW) for k, x in zip(kinds, loads, strict=True) if k == 3]
        parts = [_unpack(x, bucket >> (bits - 8)) for k, x in zip(kinds, loads, strict=True) if k == 0]
        if parts:
            rid, token = (np.concatenate(x) for x in zip(*parts, strict=True))
            often = np.unique(np.frombuffer(b"".join(x for k, x in zip(kinds, loads, strict=True) if k == 2), np.uint64))
            _, at, count = np.unique(token, return_inverse=True, return_counts=True)
            order = np.minimum(count, CAP)[at]
            if len(often):
                order[np.isin(token, often)] = CAP
            keep = order >= 2
            found.append(np.rec.fromarrays([rid[keep], np.zeros(keep.sum(), np.uint32), order[keep].astype(np.uint8), token[keep]], dtype=KEPT))
        out = []
        for kind, tables in ((0, found), (1, rows)):
            if tables:
                whole = np.concatenate(tables)
                home = (whole["rid"] ^ (whole["rid"] >> 33)) % homes
                turn = np.argsort(home, kind="stable")
                whole, home = whole[turn], home[turn]
                cuts = np.flatnonzero(np.diff(home)) + 1
                out += [(int(h[0]), kind, w.tobytes()) for w, h in zip(np.split(whole, cuts), np.split(home, cuts), strict=True) if len(w)]
        return pa.table({"home": pa.array([x[0] for x in out], pa.int32()), "kind": pa.array([x[1] for x in out], pa.int8()), "load": pa.array([x[2] for x in out], pa.binary())})

    def gather(key, table):
        kinds, loads = table.column("kind").to_pylist(), table.column("load").to_pylist()
        rows = np.concatenate([np.frombuffer(x, ROW) for k, x in zip(kinds, loads, strict=True) if k == 1] or [np.empty(0, ROW)])
        rows = rows[np.argsort(rows["rid"])]
        had = np.concatenate([np.frombuffer(x, KEPT) for k, x in zip(kinds, loads, strict=True) if k == 0] or [np.empty(0, KEPT)])
        had = had[np.lexsort((had["token"], had["order"], had["rid"]))]
        lo, hi = np.searchsorted(had["rid"], rows["rid"], "left"), np.searchsorted(had["rid"], rows["rid"], "right")
        fit = (hi > lo) & (100 * (hi - lo) >= 75 * rows["n"].astype(np.int64))
        kept = [had["token"][a:b].tobytes() if f else None for a, b, f in zip(lo, hi, fit, strict=True)]
        return pa.table({"rid": pa.array(rows["rid"]), "id": pa.array(rows["id"], mask=~rows["known"]), "n": pa.array(rows["n"].astype(np.int64)), "kept": pa.array(kept, pa.binary())})

    blocks = source.mapInArrow(spread, "bucket int, kind byte, load binary")
    homes_ = blocks.groupBy("bucket").applyInArrow(share, "home int, kind byte, load binary")
    return homes_.groupBy("home").applyInArrow(gather, "rid long, id long, n long, kept binary")


ROW = np.dtype([("rid", np.int64), ("n", np.uint32), ("known", np.bool_), ("id", np.int64)])


class Trie:
    """Prefix tree over ordered sets; equal runs of hashes are one edge."""

    __slots__ = ("edge", "kids", "ends", "least", "most", "parts")

    def __init__(self, sets: list[tuple], lo: int, hi: int, depth: int):
        """The root over sets[lo:hi], sorted, which agree on their first `depth` hashes; each is (hashes, member, size, component)."""
        made, waiting = [], [(self, lo, hi, depth)]
        while waiting:  # no recursion: sets may nest to any depth
            node, lo, hi, depth = waiting.pop()
            made.append(node)
            first, last = sets[lo][0], sets[hi - 1][0]
            end, stop = depth, min(len(first), len(last))
            while end < stop and first[end] == last[end]:
                end += 1
            node.edge = first[depth:end]
            node.ends, node.kids = [], []
            at = lo
            while at < hi and len(sets[at][0]) == end:
                node.ends.append(sets[at][1:])
                at += 1
            while at < hi:
                head, to = sets[at][0][end], at + 1
                while to < hi and sets[to][0][end] == head:
                    to += 1
                kid = Trie.__new__(Trie)
                node.kids.append(kid)
                waiting.append((kid, at, to, end))
                at = to
        for node in reversed(made):  # kids come after their parents
            node.least = min([s for _, s, _ in node.ends] + [k.least for k in node.kids])
            node.most = len(node.edge) + max([k.most for k in node.kids] or [0])
            parts = {c for _, _, c in node.ends}.union(*[k.parts or (None, 0) for k in node.kids])
            node.parts = parts if len(parts) == 1 and None not in parts else None

    def walk(self, hashes: set, rank: dict, size: int, component, same, found) -> None:
        """found(member, component) for every set that links with the walker's; same(a, b): already one component."""
        total = len(hashes)
        stack = [(self, 0, 0)]
        while stack:
            node, overlap, used = stack.pop()
            if node.parts is not None and component is not None and same(next(iter(node.parts)), component):
                continue
            need = needed(size, node.least)
            for h in node.edge:
                r = rank.get(h)
                if r is not None:
                    overlap += 1
                    used = r + 1  # the walker's hashes before this one can't come again
            rest = node.most - len(node.edge)
            for member, n, c in node.ends:
                if overlap >= needed(size, n):
                    found(member, c)
            if node.kids and overlap + min(rest, total - used) >= need:
                stack.extend((k, overlap, used) for k in node.kids)


def _ordered(kept: bytes) -> tuple:
    """Most common hash first."""
    return tuple(np.frombuffer(kept, np.uint64)[::-1].tolist())


def trie_of(rows: list[tuple]) -> Trie | None:
    """rows: (kept, member, size, component)."""
    sets = sorted(((_ordered(k), m, n, c) for k, m, n, c in rows), key=lambda x: x[0])
    return Trie(sets, 0, len(sets), 0) if sets else None


def _walk(trie: Trie, kept: bytes, size: int, component, same, found) -> None:
    own = _ordered(kept)
    trie.walk(own, {h: i for i, h in enumerate(own)}, size, component, same, found)


def _hot(keys: DataFrame) -> DataFrame | None:
    """The keys (of which there is at most one to BLOCK rows), if there are any and few enough to be broadcast."""
    return keys if 0 < keys.limit(BROADCAST + 1).count() <= BROADCAST else None


def _spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join with right, which has one row a key.  Rows of hot keys get theirs by broadcast and stay where they are.

    Without hot keys, or with too many, it is a plain join, which adaptive execution may split.
    """
    if hot is None:
        return left.join(right, key)
    few = F.broadcast(right.join(F.broadcast(hot), key))
    return left.join(F.broadcast(hot), key, "left_anti").join(right, key).unionByName(left.join(few, key))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex that it is connected with.

    Each round takes the smallest label among a vertex and its neighbours, then the label's own label.  Vertices with more
    than BLOCK neighbours, and labels that more than BLOCK vertices bear, are hot keys of these joins.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    now = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c"), F.lit(True).alias("moved"), F.count("*").alias("degree")), f"{label}-labels")
    hubs = now.where(F.col("degree") > BLOCK).select(F.col("v").alias("b"))
    while now.where("moved").limit(1).count():
        heard = _spread_join(both, now.select(F.col("v").alias("b"), "c"), "b", _hot(hubs)).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        step = now.join(heard, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"), "degree")
        jump = now.select(F.col("v").alias("c"), F.col("c").alias("far"))
        common = now.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 4).select("c")
        moved = _spread_join(step, jump, "c", _hot(common)).select("v", F.least("c", "far").alias("c"), "old", "degree")
        new = materialise(moved.select("v", "c", (F.col("c") != F.col("old")).alias("moved"), "degree"), f"{label}-labels")
        release(now)
        now = new
        hubs = now.where(F.col("degree") > BLOCK).select(F.col("v").alias("b"))
    release(both)
    return now.select("v", "c")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(t, node, n): the hashes one of which any two linked nodes share."""

    def run(batches):
        for batch in batches:
            t, who, size = [], [], []
            for node, n, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(kept, np.int64)
                lone = n - len(own)
                first = own[: max(0, n - -(-75 * n // 100) + 1 - lone)]
                t.append(first), who.append(np.full(len(first), node)), size.append(np.full(len(first), n))
            if t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t)), pa.array(np.concatenate(who)), pa.array(np.concatenate(size))], ["t", "node", "n"])

    return nodes.select("node", "n", "kept").mapInArrow(run, "t long, node long, n long")


def _star_links(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Exact links (a, b) between nodes and the centres of the lists they are in."""
    centres = materialise(prefixes.groupBy("t").agg(F.min(F.struct("n", "node")).alias("lo"), F.max(F.struct("n", "node")).alias("hi"), F.count("*").alias("many")).where("lo != hi"), "jaccard-centres")
    near = lambda c: (F.col("node") != F.col(f"{c}.node")) & (100 * F.least("n", f"{c}.n") >= 75 * F.greatest("n", f"{c}.n"))
    met = _spread_join(prefixes, centres.drop("many"), "t", _hot(centres.where(F.col("many") > BLOCK).select("t")))
    pairs = materialise(met.select("node", F.explode(F.array_compact(F.array(F.when(near("lo"), F.col("lo.node")), F.when(near("hi"), F.col("hi.node"))))).alias("centre")).distinct(), "jaccard-pairs")
    many = pairs.groupBy("centre").agg(F.ceil(F.count("*") / (BLOCK // 4)).alias("blocks")).where("blocks > 1")
    blocks = _hot(many)
    if blocks is None:  # none, or too many to be broadcast
        salted = pairs.join(many, "centre", "left")
    else:
        salted = pairs.join(F.broadcast(blocks), "centre", "left")
    salted = salted.select("centre", "node", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).alias("salt"))
    member = nodes.select("node", "n", "kept")
    centre = nodes.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("kept").alias("own"))
    # the centre's set goes along once in each block, as a row of its own
    rows = salted.join(member, "node").select("centre", "salt", "node", "n", "kept")
    heads = salted.select("centre", "salt").distinct().join(centre, "centre").select("centre", "salt", F.col("centre").alias("node"), F.col("m").alias("n"), F.col("own").alias("kept"))

    def links(key, table):
        hub, out = key[0].as_py(), []
        rows = list(zip(*(table.column(x).to_pylist() for x in ("kept", "node", "n")), strict=True))
        trie = trie_of([(k, v, n, v) for k, v, n in rows if v != hub])
        for k, v, n in rows:
            if v == hub and trie is not None:
                _walk(trie, k, n, None, None, lambda m, c: out.append(m))
        return pa.table({"a": pa.array([hub] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    stars = materialise(rows.union(heads).groupBy("centre", "salt").applyInArrow(links, "a long, b long"), "jaccard-stars")
    release(centres)
    release(pairs)
    return stars


def _rest_links(nodes: DataFrame, prefixes: DataFrame, joined: DataFrame) -> DataFrame:
    """Links (a, b) that connect different components of `joined` (v, c); enough of them to connect all that are linked."""
    known = materialise(prefixes.join(joined.select(F.col("v").alias("node"), "c"), "node", "left").select("t", "node", F.coalesce("c", "node").alias("c")), "jaccard-known")
    mixed = materialise(known.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("node").alias("first"), F.count("*").alias("many")).where("lo != hi"), "jaccard-mixed")
    hot = _hot(mixed.where(F.col("many") > BLOCK).select("t"))
    ties = materialise(_spread_join(known.select("t", "node"), mixed.select("t", "first"), "t", hot).where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "jaccard-ties")
    release(known)
    release(mixed)
    cluster = components(ties, "jaccard-clusters")
    release(ties)
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(SIZE_STEP)))).cast("int").alias("size")
    inside = nodes.join(cluster.select(F.col("v").alias("node"), F.col("c").alias("cluster")), "node").join(joined.select(F.col("v").alias("node"), "c"), "node", "left")
    inside = materialise(inside.select("cluster", size, "node", "n", "kept", F.coalesce("c", "node").alias("c")), "jaccard-inside")
    # Most clusters are one block.  Large ones are split by the sets' sizes and into blocks of BLOCK nodes; each pair of
    # blocks of the same or neighbouring sizes is one task.
    large = inside.groupBy("cluster").agg(F.count("*").alias("many")).where(F.col("many") > BLOCK).select("cluster")
    if (n := large.limit(BROADCAST + 1).count()) > 0:
        large = F.broadcast(large) if n <= BROADCAST else large
        spot = lambda s, b: F.col(s) * (1 << 24) + F.col(b)
        parts = materialise(inside.join(large, "cluster", "left_semi").groupBy("cluster", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "jaccard-blocks")
        codes = parts.select("cluster", F.col("size").alias("s"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).select("cluster", "s", spot("s", "b").alias("code"))
        partners = parts.join(codes, "cluster").where(F.abs(F.col("size") - F.col("s")) <= 1).groupBy("cluster", "size", "blocks").agg(F.collect_list("code").alias("others"))
        few = parts.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0] <= BROADCAST
        placed = inside.join(F.broadcast(partners) if few else partners, ["cluster", "size"], "left").withColumn("b", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
        own = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(spot("size", "b")).alias("block")
        copies = placed.select("cluster", own, F.explode(F.coalesce("others", F.array(F.lit(0)))).alias("other"), "node", "n", "kept", "c")
    else:
        copies = inside.select("cluster", F.lit(0).alias("block"), F.lit(0).alias("other"), "node", "n", "kept", "c")
    copies = copies.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "kept", "c")

    def links(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        rows = list(zip(*(table.column(x).to_pylist() for x in ("kept", "node", "n", "c", "block")), strict=True))
        trie = trie_of([r[:4] for r in rows if r[4] == j])
        parent: dict = {}

        def find(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = parent[x]
            return x

        out = []
        for kept, node, n, c, block in rows:
            if block != i or trie is None:
                continue

            def found(member, other, node=node, c=c):
                a, b = find(c), find(other)
                if a != b:
                    parent[a] = b
                    out.append((node, member))

            _walk(trie, kept, n, c, lambda x, y: find(x) == find(y), found)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rest = materialise(copies.groupBy("cluster", "i", "j").applyInArrow(links, "a long, b long"), "jaccard-rest")
    release(inside)
    return rest


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: list | None = None) -> DataFrame:
    """(rid, id, n_shingles, component_id) for every row of docs."""
    rows = materialise(_shared_sets(docs, id_col, text_col), "jaccard-sets")
    fit = rows.where(F.col("kept").isNotNull())
    whole = F.octet_length("kept") == 8 * F.col("n")
    fit = fit.withColumn("node", F.when(whole, F.xxhash64(F.lit(1), "kept")).otherwise(F.xxhash64(F.lit(2), "rid")))
    nodes = materialise(fit.groupBy("node").agg(F.first("n").alias("n"), F.first("kept").alias("kept"), F.min("id").alias("low"), F.count("*").alias("rows")), "jaccard-nodes")
    slim = materialise(fit.select("rid", "id", "n", "node").union(rows.where(F.col("kept").isNull()).select("rid", "id", "n", F.lit(None).cast("long"))), "jaccard-rows")
    release(rows)  # the nodes have the sets now
    prefixes = materialise(_prefixes(nodes), "jaccard-prefixes")
    stars = _star_links(nodes, prefixes)
    joined = components(stars, "jaccard-stars")
    rest = _rest_links(nodes, prefixes, joined)
    release(prefixes)
    release(joined)
    final = components(stars.union(rest), "jaccard-final")
    release(stars)
    release(rest)
    labels = nodes.select("node", "low", "rows").join(final.select(F.col("v").alias("node"), "c"), "node", "left")
    labels = materialise(labels.select("node", "low", "rows", F.coalesce("c", "node").alias("c")), "jaccard-components")
    release(final)
    release(nodes)
    if held is not None:
        held += [labels, slim]
    first = labels.groupBy("c").agg(F.min("low").alias("component_id"), F.count("*").alias("many"))
    own = _spread_join(labels.select("node", "c"), first.drop("many"), "c", _hot(first.where(F.col("many") > BLOCK).select("c"))).select("node", "component_id")
    linked = _spread_join(slim.where(F.col("node").isNotNull()), own, "node", _hot(labels.where(F.col("rows") > BLOCK).select("node"))).select("rid", "id", "n", "component_id")
    alone = slim.where(F.col("node").isNull()).select("rid", "id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("rid"), F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: list | None = None) -> DataFrame:
    """The rows of docs, all their columns, one of each component: the first row that has the component's smallest id.

    Rows without a shingle are all kept; so is a component of which no row has an id.  The rows are read twice and have to
    come in the same order, as they do from files; what is no plain scan of files is written to such first.
    held: gets the tables that the result reads, for the caller to release once it is written.
    """
    if docs._jdf.queryExecution().optimizedPlan().nodeName() != "LogicalRelation":
        docs = materialise(docs, "jaccard-rows")
        if held is not None:
            held.append(docs)
    ranked = near_duplicates(docs, id_col, text_col, held)
    keep = ranked.where((F.col("n_shingles") == 0) | F.col("component_id").isNull() | (F.col(id_col) == F.col("component_id")))
    group = F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.col("rid")).otherwise(F.xxhash64("component_id"))
    chosen = keep.groupBy(group.alias("g")).agg(F.min("rid").alias("rid")).select("rid")
    # the row's number goes beside a struct of the row, so no column's name can clash with it
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return numbered.join(chosen, "rid", "left_semi").select("row.*")
