"""Recursive character splitting as one native expression, fixed strides, and running documents that are views of a stored text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.functions.links import once
from vulnlake.functions.text import EDGES

#: Chunk size and overlap in characters, separators from the coarsest on.
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 100
SEPARATORS = ["\n\n", "\n", " ", ""]


def leaf_parts(text: Column, size: int, separators: list[str]) -> Column:
    """The parts of a text that are merged into chunks, in order, with nulls where merging has to stop.

    A text is cut at the coarsest separator that it holds, which goes with what it begins.  A part of `size` characters or more is
    cut by the finer ones in its turn, and nothing of it is merged with what stands beside it.
    """
    sep, finer = separators[0], separators[1:]
    if not sep:
        return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    parts = F.transform(F.split(text, sep), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(sep), x)))
    stop = F.array(F.lit(None).cast("string"))
    cut = F.flatten(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.when(F.length(x) < size, F.array(x)).otherwise(F.concat(stop, leaf_parts(x, size, finer), stop)) if finer else F.array(x)))
    return F.when(F.contains(text, F.lit(sep)), cut).otherwise(leaf_parts(text, size, finer)) if finer else cut


def merged(parts: Column, size: int, overlap: int) -> Column:
    """array(struct(first, n, start)): which runs of parts are chunks, and at which character they begin.

    A run is closed where the next part would make it longer than `size`; the next one begins with the last parts of it that
    hold no more than `overlap` characters and leave room.
    """

    def step(s: Column, part: Column) -> Column:
        stop, long = part.isNull(), F.coalesce(F.length(part), F.lit(0))
        full = ~stop & (s["len"] > 0) & (s["len"] + long > size)
        room = F.least(F.lit(overlap), size - long)
        run = F.reverse(F.slice(parts, s["first"] + 1, s["i"] - s["first"]))
        fits = lambda k, p: F.struct((k["n"] + F.when(k["go"] & (k["len"] + F.length(p) <= room), 1).otherwise(0)).alias("n"), (k["len"] + F.when(k["go"] & (k["len"] + F.length(p) <= room), F.length(p)).otherwise(0)).alias("len"), (k["go"] & (k["len"] + F.length(p) <= room)).alias("go"))
        kept = F.when(full, F.aggregate(run, F.struct(F.lit(0).alias("n"), F.lit(0).alias("len"), F.lit(True).alias("go")), fits))
        out = F.when((s["len"] > 0) & (stop | full), F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), (s["i"] - s["first"]).alias("n"), (s["pos"] - s["len"]).alias("start"))))).otherwise(s["out"])
        i = s["i"] + 1
        return once(kept, lambda k: F.struct(out.alias("out"), F.when(stop, i).when(full, s["i"] - k["n"]).otherwise(s["first"]).alias("first"), i.alias("i"), F.when(stop, 0).when(full, k["len"] + long).otherwise(s["len"] + long).alias("len"), (s["pos"] + long).alias("pos")))

    start = F.struct(F.array().cast("array<struct<first:int,n:int,start:int>>").alias("out"), *[F.lit(0).alias(x) for x in ("first", "i", "len", "pos")])
    return F.aggregate(F.concat(parts, F.array(F.lit(None).cast("string"))), start, step, lambda s: s["out"])


def chunk_list(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] | None = None) -> Column:
    """array(struct(start, text)): the chunks of a text without white space at their ends; start counts characters of the text."""

    def build(parts: Column) -> Column:
        raw = F.transform(merged(parts, size, overlap), lambda c: F.struct(c["start"].alias("at"), F.array_join(F.slice(parts, c["first"] + 1, c["n"]), "").alias("raw")))
        bare = F.transform(raw, lambda c: F.struct((c["at"] + F.length(c["raw"]) - F.length(F.regexp_replace(c["raw"], EDGES.split("|")[0], ""))).alias("start"), F.regexp_replace(c["raw"], EDGES, "").alias("text")))
        return F.filter(bare, lambda c: c["text"] != "")

    return once(leaf_parts(F.coalesce(text, F.lit("")), size, SEPARATORS if separators is None else separators), build)


def chunks(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """docs with (chunk_pos, start_index, chunk) for each piece of the text; null and blank texts have none."""
    cut = docs.select(*docs.columns, F.posexplode(chunk_list(F.col(text_col), size, overlap)).alias("chunk_pos", "__chunk"))
    return cut.select(*docs.columns, "chunk_pos", F.col("__chunk.start").alias("start_index"), F.col("__chunk.text").alias("chunk"))


def fixed_chunks(docs: DataFrame, text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Pieces of fixed length at fixed strides."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(size - overlap))
    rows = docs.select(*docs.columns, F.posexplode(starts).alias("chunk_pos", "start_index"))
    return rows.withColumn("chunk", F.substr(F.col(text_col), F.col("start_index") + 1, F.lit(size)))


def running_spans(items: DataFrame, key: str, pos: str, text: str, sep: str = "\n") -> tuple[DataFrame, DataFrame]:
    """(stored, spans): each key's whole text once, (key, document); and for every row where its running document ends, (key, pos, end).

    What is written grows with the texts, not with their square.  Null texts add nothing; equal positions are ordered by their texts.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))))
    stored = items.groupBy(key).agg(ordered.alias("a")).select(key, F.array_join(F.transform("a", lambda x: x["t"]), sep).alias("document"))
    w = Window.partitionBy(key).orderBy(pos, F.asc_nulls_first(text)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.coalesce(F.sum(F.length(text)).over(w) + (F.count(text).over(w) - 1) * len(sep), F.lit(0))
    return stored, items.select(key, pos, end.alias("end"))


def running_view(stored: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """spans with `document`, the part of the stored text that each row's running document is."""
    return spans.join(stored, key).withColumn("document", F.left("document", F.col("end").cast("int")))
