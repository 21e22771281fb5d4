"""Evidence documents, chunks, retrieval and context."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.operators.neighbours import nearest
from vulnlake.session import materialise, release

def running_documents(items: DataFrame, key: str, pos: str, text: str, sep: str = "\n") -> DataFrame:
    """items with `document`: all texts of the key up to and with this one."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("document", F.array_join(F.collect_list(text).over(w), sep))


def final_documents(items: DataFrame, key: str, pos: str, text: str, sep: str = "\n") -> DataFrame:
    """(key, document): all texts of a key in order; what the last of running_documents holds, in one pass and without the others."""
    grouped = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("a"))
    return grouped.select(key, F.array_join(F.transform("a", lambda x: x["t"]), sep).alias("document"))


def token_batches(rows: DataFrame, key: str, pos: str, tokens: str, budget: int = 300_000) -> DataFrame:
    """(key, pos, batch): texts in order, a new batch where the next would go over the budget.

    A single text over the budget is a batch of its own; no batch is empty; a null count is 0.  Keys are brought together
    and sorted, and each row is read once in its order: what is held is the batch so far, never a key's rows.
    """
    ordered = rows.select(key, pos, F.coalesce(F.col(tokens).cast("long"), F.lit(0)).alias("tokens")).repartition(key).sortWithinPartitions(key, pos)
    kinds = dict(rows.dtypes)

    def run(batches):
        last, used, number = (), 0, 0
        for batch in batches:
            out = []
            for own, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (own,) != last:
                    last, used, number = (own,), 0, 0
                elif used and used + size > budget:
                    used, number = 0, number + 1
                used += size
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], [key, pos, "batch"])

    return ordered.mapInArrow(run, f"{key} {kinds[key]}, {pos} {kinds[pos]}, batch int")


def token_count(c: Column) -> Column:
    """Tokens by white space: a stand-in where no vocabulary is at hand."""
    bare = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


_CODERS: dict = {}


def _coder(path: str):
    """A vocabulary's encoder, opened once a worker."""
    if path not in _CODERS:
        from tokenizers import Tokenizer

        _CODERS[path] = Tokenizer.from_file(path)
    return _CODERS[path]


#: Characters of texts that are encoded together.
TOGETHER = 200_000


def _encodings(path: str, texts: pd.Series):
    """The encodings of texts in order; an encoding is many times its text, so those of few texts are held at a time."""
    coder, held, size = _coder(path), [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1]) + 1
        if size >= TOGETHER:
            yield from coder.encode_batch(held, add_special_tokens=False)
            held, size = [], 0
    yield from coder.encode_batch(held, add_special_tokens=False)


def bpe_token_count(path: str):
    """A column function that counts a vocabulary file's tokens, in Arrow batches; a null text has none."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e.ids) for e in _encodings(path, texts)], dtype="int32")

    return count


def bpe_truncated(path: str, most: int):
    """A column function that keeps a text's first `most` tokens; shorter texts stay as they are, null stays null.

    The cut is where the last token kept ends in the text, so no character is changed or split.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or len(e.ids) <= most else t[: e.offsets[most - 1][1] if most > 0 else 0] for t, e in zip(texts, _encodings(path, texts), strict=True)], dtype=object)

    return cut


def mmr_order(query: np.ndarray, items: np.ndarray, k: int, weight: float = 0.5) -> list[int]:
    """Positions of k items by maximal marginal relevance; scores to 9 digits, ties by position."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    near = unit(items) @ unit(query)
    alike = unit(items) @ unit(items).T
    chosen: list[int] = []
    while len(chosen) < min(k, len(items)):
        most = alike[:, chosen].max(axis=1) if chosen else np.zeros(len(items))
        score = np.round(weight * near - (1 - weight) * most if chosen else near, 9)
        score[chosen] = -np.inf
        chosen.append(int(score.argmax()))
    return chosen


def mmr(queries: DataFrame, corpus: DataFrame, key: str, k: int = 12, fetch: int = 20, weight: float = 0.5) -> DataFrame:
    """(key, query_id, item_id, place): k of the `fetch` nearest items, near the query and unlike each other."""
    found = nearest(queries, corpus, key, fetch).join(queries, [key, "query_id"]).join(corpus, [key, "item_id"])
    kind = dict(queries.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        order = mmr_order(np.array(pdf["q"].iloc[0]), np.array(pdf["v"].tolist()), k, weight)
        out = pdf.iloc[order]
        return pd.DataFrame({key: out[key], "query_id": out["query_id"], "item_id": out["item_id"], "place": range(1, len(out) + 1)})

    return found.groupBy(key, "query_id").applyInPandas(pick, f"{key} {kind[key]}, query_id {kind['query_id']}, item_id {dict(corpus.dtypes)['item_id']}, place int")


def contexts(found: DataFrame, keys: list[str], rank: str, source: str, text: str) -> DataFrame:
    """(keys, context): `Source: s`, text, in the order of retrieval."""
    line = lambda x: F.concat(F.lit("Source: "), x[source], F.lit("\n "), x[text], F.lit("\n"))
    grouped = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(rank, source, text))).alias("a"))
    return grouped.select(*keys, F.array_join(F.transform("a", line), "").alias("context"))


def with_ground_truth(answers: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """answers with the known value, or the sentinel."""
    return answers.join(truth, keys, "left").withColumn("truth", F.coalesce("truth", F.lit("Not Given")))


def thread_order(messages: DataFrame) -> DataFrame:
    """(conv, id, depth, path) of (conv, id, parent): sorted by path, parents come before children, children in id order.

    path is the array of ids from the thread's first message down.  Every round doubles how far up a message has looked,
    so a chain of n messages takes log2(n) rounds, each written before the next.  A message whose parents are missing or
    go in a circle is in no thread and is left out.
    """
    now = materialise(messages.select("conv", "id", F.col("parent").alias("up"), F.array("id").alias("path")), "threads")
    while now.where("up is not null").limit(1).count():
        above = now.select("conv", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        longer = now.where("up is not null").join(above, ["conv", "up"]).select("conv", "id", F.col("next").alias("up"), F.concat("before", "path").alias("path"))
        step = materialise(now.where("up is null").unionByName(longer.where(F.size(F.array_distinct("path")) == F.size("path"))), "threads")
        release(now)
        now = step
    return now.select("conv", "id", (F.size("path") - 1).alias("depth"), "path")
