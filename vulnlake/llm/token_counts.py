"""Token counts of documents from piece counts of distinct pre-tokens; ids are never made.

No piece of the vocabulary holds a word-start mark behind another character, so no merge crosses the gap before one: a text is
cut there, and around characters that occur in no piece of several characters.  The parts are the pre-tokens.  They are
counted over the corpus (summed in the map first), every distinct one is merged once, and the number of its pieces is joined
to the documents' own pre-token frequencies and summed.  The join has two ways: pre-tokens that are frequent and short, of which there
are at most MOST_COMMON of COMMON_CHARS characters, are looked up where the document is read; the others are joined in a shuffle,
where none of them can be a hot key unless it is longer than that (adaptive execution splits those).

Merging is that of a scored-pair BPE with byte fallback: of all neighbouring pairs that form a piece the best-scored, leftmost one is
merged, and a character that is no piece counts its UTF-8 bytes.

Defined cases: null and empty texts have no tokens; a text of any length is counted whole; repeated rows are counted each; a
null id stays null; strings of special tokens are ordinary text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import materialise, slices

#: The mark that stands for a blank.
MARK = "▁"
#: Bound of what is broadcast: this many pre-tokens of this many characters.
MOST_COMMON, COMMON_CHARS = 250_000, 32
#: Distinct pre-tokens that a task holds, and of one document those that one row carries on.
HELD, ROW_HOLDS = 300_000, 50_000
#: Pre-tokens of more characters are merged by a queue.
SHORT = 40
#: Texts above this length are cut in batches.
LONG_TEXT, BATCH = 2_000_000, 100_000
#: A run of marks with what follows, or what precedes any mark.
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """Pieces and scores of a vocabulary: cuts texts into pre-tokens and counts a pre-token's pieces."""

    def __init__(self, scores: dict[str, float]):
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece holds a word start behind another character; texts can't be cut there")
        self.scores = scores
        joined = sorted({c for p in scores if len(p) > 1 for c in p} - {MARK})
        inside = re.escape("".join(joined))
        self.cutter = re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]" if joined else f"{MARK}+|[^{MARK}]", re.DOTALL)

    def words(self, text: str):
        """Lists of the words of a text with the marks before them, in order.

        Where every blank stands alone behind a word a split at blanks finds them; longer runs of blanks stay with the word behind them.
        """
        if not text:
            return
        if len(text) >= LONG_TEXT or text[0] == " " or "  " in text or MARK in text or "\0" in text:
            marked = MARK + text.replace(" ", MARK)
            if len(marked) < LONG_TEXT:
                yield MARKED_WORD.findall(marked)
            else:
                yield from batched((m.group() for m in MARKED_WORD.finditer(marked)), BATCH)
        else:
            yield (MARK + text.replace(" ", "\0" + MARK)).split("\0")

    def cut(self, word: str) -> list[str]:
        """The pre-tokens of a word."""
        return self.cutter.findall(word)

    def count(self, token: str) -> int:
        """Pieces of one pre-token."""
        score = self.scores.get
        if len(token) == 1:
            return 1 if token in self.scores else len(token.encode())
        parts: list[str] = list(token)
        if len(parts) > SHORT:
            return self._count_long(parts)
        none = float("-inf")
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)  # the leftmost one
            parts[i] += parts.pop(i + 1)
            scores.pop(i)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
        return sum([1 if p in self.scores else len(p.encode()) for p in parts])

    def _count_long(self, parts: list[str]) -> int:
        """The same by a queue of pairs; entries whose pair has changed are passed over."""
        score = self.scores.get
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-s, i, 2) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (s := score(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (s := score(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, size + len(parts[k])))
            if (h := before[i]) >= 0 and (s := score(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (-s, h, len(parts[h]) + size))
        return sum([1 if p in self.scores else len(p.encode()) for p in parts if p])


def load_pieces(path: str) -> dict[str, float]:
    """Normal pieces and scores of a sentencepiece BPE model with byte fallback and no normalisation but the leading mark."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    train, norm, kinds = model.trainer_spec, model.normalizer_spec, {p.type for p in model.pieces}
    if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not kinds <= {1, 2, 3, 6}:
        raise ValueError("only BPE models with byte fallback, a leading mark and texts as they are can be counted")
    sp = SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}


_OPEN: dict[int, Pieces] = {}
_COMMON: dict[int, dict[str, int]] = {}


def _pieces(shared) -> Pieces:
    if shared.value[0] not in _OPEN:  # kept for the next tasks of this worker
        _OPEN.clear()
        _OPEN[shared.value[0]] = Pieces(shared.value[1])
    return _OPEN[shared.value[0]]


def _share(spark: SparkSession, path: str):
    scores = load_pieces(path)
    return spark.sparkContext.broadcast((hash(frozenset(scores.items())), scores))


def pretoken_pieces(docs: DataFrame, shared, text_col: str = "text") -> DataFrame:
    """(token, freq, pieces): every distinct pre-token of the texts, how often it occurs and how many pieces it has."""

    def tally(batches):
        pieces, found = _pieces(shared), Counter()

        def out():
            cut = Counter()
            for word, n in found.items():
                for token in pieces.cut(word):
                    cut[token] += n
            for part in batched(cut.items(), 50_000):
                tokens, counts = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["token", "freq"])
            found.clear()

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                for text in texts:
                    for words in pieces.words(text):
                        found.update(words)
                        if len(found) > HELD:
                            yield from out()
        yield from out()

    def count(batches):
        pieces = _pieces(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pieces.count(t) for t in batch.column(0).to_pylist()], pa.int64())], ["token", "freq", "pieces"])

    freq = docs.select(text_col).mapInArrow(tally, "token string, freq long").groupBy("token").agg(F.sum("freq").alias("freq"))
    return freq.mapInArrow(count, "token string, freq long, pieces long")


def common_pretokens(table: DataFrame, most: int = MOST_COMMON, chars: int = COMMON_CHARS) -> dict[str, int]:
    """Pieces of the most frequent short pre-tokens, `most` at most: all whose frequency reaches a step that so many reach."""
    short = table.where(F.length("token") <= chars).withColumn("step", F.floor(F.log2("freq") * 4))
    total, least = 0, None
    for row in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # four steps a doubling: a few hundred rows
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    if least is None:
        return {}
    found = short.where(F.col("step") >= least).select("token", "pieces").toArrow()
    return dict(zip(found.column("token").to_pylist(), found.column("pieces").to_pylist(), strict=True))


def _lookup(shared, common):
    """Per document (key, id, n_bytes, pieces of common pre-tokens) and its other pre-tokens with their frequencies."""
    rest_type = pa.list_(pa.struct([("token", pa.string()), ("freq", pa.int64())]))

    def run(batches):
        pieces = _pieces(shared)
        if common.value[0] not in _COMMON:
            _COMMON.clear()
            _COMMON[common.value[0]] = common.value[1]
        known, cache = _COMMON[common.value[0]], {}

        def looked_up(word):
            """Pieces of a word's common pre-tokens, and its others."""
            tokens = pieces.cut(word)
            return sum([known.get(t, 0) for t in tokens]), [t for t in tokens if t not in known]

        for batch in batches:
            for start, texts in slices(batch.column("text")):
                at, sums, rests = [], [], []
                for i, text in enumerate(texts):
                    own = Counter()
                    for words in pieces.words(text):
                        own.update(words)
                    total, others = 0, Counter()
                    for word, n in own.items():
                        c = known.get(word)
                        if c is None:
                            found = cache.get(word)
                            if found is None:
                                if len(cache) > HELD:
                                    cache.clear()
                                found = cache[word] = looked_up(word)
                            total += found[0] * n
                            for t in found[1]:
                                others[t] += n
                        else:
                            total += c * n
                    rest = list(others.items())
                    for part in batched(rest, ROW_HOLDS) if rest else [()]:
                        at.append(i)
                        sums.append(total)
                        rests.append([{"token": t, "freq": n} for t, n in part])
                        total = 0
                rows = batch.slice(start, len(texts)).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("id"), rows.column("n_bytes"), pa.array(sums, pa.int64()), pa.array(rests, rest_type)], ["key", "id", "n_bytes", "n", "rest"])

    return run


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", most_common: int = MOST_COMMON) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; model: path of the vocabulary file, which the driver reads and broadcasts."""
    spark = docs.sparkSession
    shared = _share(spark, model)
    table = materialise(pretoken_pieces(docs, shared, text_col), "pretokens")
    found = common_pretokens(table, most_common)
    common = spark.sparkContext.broadcast((hash(frozenset(found.items())), found))
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    id_type = dict(source.dtypes)["id"]
    looked_up = materialise(source.mapInArrow(_lookup(shared, common), f"key long, id {id_type}, n_bytes long, n long, rest array<struct<token: string, freq: long>>"), "token-rows")
    rest = looked_up.select("key", F.explode("rest").alias("r")).select("key", "r.token", "r.freq").join(table.select("token", "pieces"), "token")
    rest = rest.select("key", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("freq") * F.col("pieces")).alias("n"))
    sums = looked_up.drop("rest").unionByName(rest).groupBy("key").agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return sums.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
