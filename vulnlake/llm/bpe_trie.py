"""Byte-level BPE by a trie over distinct words.

For BPE the tokens of a prefix follow from its last token alone: the prefix before that token is encoded as if it stood
by itself.  So the distinct words of a slice of texts go into a trie (held as sorted words and shared prefix lengths), and
one depth-first walk gives every node its last token: of the vocabulary's entries that end there, the one that BPE leaves beside the last token of the node where
the entry begins.  What words share at their start is worked out once.  Encodings are then read back token by token,
and kept in a bounded table (words that fall out of it are worked out again, never dropped).

Special tokens that stand in a text become their ids, as the public library has it.

Defined cases: null and empty texts have no tokens; a text of any length is encoded whole; repeated rows are encoded
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import slices

#: White space next to a space, where cutting at spaces would be wrong.
LONG_GAP = regex.compile(r" \s|\s ")
ONE = [bytes([b]) for b in range(256)]
#: The split of byte-level BPE and the bytes that stand for themselves in its vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of_char() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Recent(dict):
    """A bounded table in two generations: what the last `size` admissions used stays, the rest goes."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def admit(self, keys: set) -> list:
        """Keys that are not held; those that are held, and the ones returned (once the caller sets them), stay for now."""
        missing = [k for k in keys if k not in self]
        if len(self) + len(missing) > self.size:
            self.old = dict(self)
            self.clear()
            missing = list(keys)
        old, rest = self.old, []
        for k in missing:
            found = old.get(k)
            if found is None:
                rest.append(k)
            else:
                self[k] = found
        return rest


class TrieBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, spec: str, cache_words: int = 300_000):
        conf = json.loads(spec)
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        self.vocab = {raw(t): i for t, i in conf["model"]["vocab"].items() if all(c in byte for c in t)}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        # rank: the order in which tokens come to be; single bytes before all merges
        self.rank = {i: 0 for t, i in self.vocab.items() if len(t) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(conf["model"]["merges"], 1):
            left, right = (self.vocab[raw(x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            token = self.vocab[self.bytes_of[left] + self.bytes_of[right]]
            self.merged.setdefault((left, right), n)
            if token not in self.rank:
                self.rank[token], self.parts[token] = n, (left, right)
        self.longest = max(map(len, self.vocab))
        self.special = {x["content"]: x["id"] for x in conf.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.splitter = regex.compile(SPLIT)
        # what every special token begins with: a cheap test that most texts fail
        self.special_mark = os.path.commonprefix(list(self.special))
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in conf.get("added_tokens", [])):
            raise ValueError("special tokens that strip blanks, stand as single words or are normalised are not supported")
        self.special_splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache, self.words = Recent(cache_words), Recent(cache_words * 2 // 3)
        self.beside: dict[tuple[int, int], bool] = {}

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side.

        The pair is taken apart again, later merge first; at every step the two pieces that touch must not have a merge
        that BPE would have made before one of the two pieces was itself merged into what surrounds it.
        """
        known = self.beside.get((left, right))
        if known is not None:
            return known
        a, b, rank, parts = left, right, self.rank, self.parts
        until_a = until_b = float("inf")  # when the piece at hand is used up by its own token
        ok = True
        while True:
            n = self.merged.get((a, b))
            # a goes first on equal ranks: merges of one rank are made from the left
            if n is not None and (n < until_a) and (n <= until_b if until_b != float("inf") else True):
                ok = False
                break
            if rank[a] == 0 and rank[b] == 0:
                break
            if rank[a] >= rank[b] and rank[a] > 0:
                until_a, a = rank[a], parts[a][1]
            else:
                until_b, b = rank[b], parts[b][0]
        if len(self.beside) > 400_000:
            self.beside.clear()
        self.beside[left, right] = ok
        return ok

    def encode_words(self, words) -> dict[str, list[int]]:
        """Ids of distinct words, by one walk over their trie.

        Sorted words, each with the length of the prefix that it shares with the one before, are the trie in preorder: the
        bytes after that prefix are the nodes that the word inserts.  The walk keeps the states of the path it is on, so
        what words share is computed once, and no node needs an object of its own.
        """
        out: dict[str, list[int]] = {}
        vocab, beside, longest, stays, whole = self.vocab.get, self.beside.get, self.longest, self.stays, self.whole
        last, size = [0], [0]  # for the path's first d bytes: their last token and its length
        path = b""
        for data, word in sorted((w.encode(), w) for w in words):
            n, depth = len(data), 0
            if path[:1] == data[:1]:
                most = min(len(path), n)
                while depth < most and path[depth] == data[depth]:
                    depth += 1
            del last[depth + 1 :], size[depth + 1 :]
            path = data
            while depth < n:
                depth += 1
                for start in range(depth - 1, max(0, depth - longest) - 1, -1):
                    token = vocab(data[start:depth])
                    if token is None:
                        continue
                    if start == 0:
                        if depth == 1 or whole(token):
                            break
                        continue
                    known = beside((last[start], token))
                    if stays(last[start], token) if known is None else known:
                        break
                last.append(token)
                size.append(depth - start)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[word] = ids
        return out

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to the token."""
        return self.rank.get(token, 0) == 0 or self.stays(*self.parts[token]) is False

    def chunks(self, text: str | None) -> list:
        """Parts of a text that can be split into words one by one; special tokens come as tuples.

        A single space always begins a word, so a text without longer runs of white space is cut there.
        """
        if not text:
            return []
        if self.special_splitter is not None and self.special_mark in text and any(s in text for s in self.special):
            parts = self.special_splitter.split(text)
            return [c for i, p in enumerate(parts) for c in ([("", p)] if i % 2 else self.chunks(p))]
        if "\0" in text or LONG_GAP.search(text):
            return self.splitter.findall(text)
        return text.replace(" ", "\0 ").split("\0") if text[0] != " " else text.replace(" ", "\0 ")[1:].split("\0")

    def encode_texts(self, texts: list[str | None]) -> list[list[tuple[int, str, bytes]]]:
        """For each text its chunks as (number of ids, ids joined by commas, decoded bytes)."""
        chunked = [self.chunks(t) for t in texts]
        cache, known = self.cache, self.words
        missing = cache.admit(set().union(*chunked))
        split = self.splitter.findall
        # a run of ASCII letters, a blank before it or not, is one word by the rule
        pieces = {c: [] if c.__class__ is not str else [c] if c.isascii() and (c[1:] if c[:1] == " " else c).isalpha() else split(c) for c in missing}
        text, bytes_of = self.text_of, self.bytes_of
        for word, ids in self.encode_words(known.admit({w for p in pieces.values() for w in p})).items():
            known[word] = (1, text[ids[0]], bytes_of[ids[0]]) if len(ids) == 1 else (len(ids), ",".join([text[i] for i in ids]), b"".join([bytes_of[i] for i in ids]))
        for c, own in pieces.items():
            if len(own) == 1:
                cache[c] = known[own[0]]
            elif c.__class__ is str:
                found = [known[w] for w in own]
                cache[c] = (sum([f[0] for f in found]), ",".join([f[1] for f in found]), b"".join([f[2] for f in found]))
            else:
                cache[c] = (1, str(self.special[c[1]]), self.bytes_of[self.special[c[1]]])
        return [list(map(cache.__getitem__, p)) for p in chunked]

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for n, ids, _ in self.encode_texts([text])[0] for x in ids.split(",")]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_OPEN: dict[str, TrieBpe] = {}


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row; vocabulary: path of the file.

    The driver reads the file (about 2 MB, fixed by the vocabulary) and broadcasts it, so executors need no copy.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = ", ids array<int>, decoded string" if with_ids else ""
    schema = f"id {dict(source.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"

    def run(batches):
        if vocabulary not in _OPEN:  # kept for the next tasks of this worker
            _OPEN[vocabulary] = TrieBpe(spec.value)
        coder = _OPEN[vocabulary]
        gc.disable()  # nothing here refers to itself in a circle; the tables' many tuples would be gone over again and again
        try:
            for batch in batches:
                for start, texts in slices(batch.column(1)):
                    count, ids_hash, text_hash, ids, decoded = [], [], [], [], []
                    for words in coder.encode_texts(texts):
                        joined = ",".join([w[1] for w in words])
                        raw = b"".join([w[2] for w in words]).decode("utf-8", "replace")
                        count.append(sum([w[0] for w in words]))
                        ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                        text_hash.append(hashlib.sha256(raw.encode()).hexdigest())
                        if with_ids:
                            ids.append([int(x) for x in joined.split(",")] if joined else [])
                            decoded.append(raw)
                    columns = [batch.column(0).slice(start, len(texts)), pa.array(count, pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
                    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                        names += ["ids", "decoded"]
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:
            gc.enable()

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
