"""Preference formatting (native): one prompt from the longest common turn prefix, two masked completions.

Turns are rendered `<|im_start|>role\\ntext<|im_end|>\\n`.  A completion is what follows the common prefix; its mask is
the list of character spans [start, end) that a loss should count: text and end mark of the assistant's turns.

Defined cases: null roles render as `user`, null texts as empty; turns sort by (turn, role, text), nulls first, so ties
have one order; repeated rows are turns of their own; rows without a conversation id are left out; a pair of which one
side is missing has that side's completion null; two equal conversations give two empty completions; an empty table
gives an empty result.  A rendered example is one row, so one conversation has to fit a row; the number of
conversations, and how many of them share a first turn, do not matter: nothing is grouped by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"


def conversations_as_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns: array of struct(turn, role, text) in order), one row per conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit("\n"), t["text"], F.lit(TAIL))), "")


def _mask(turns: Column) -> Column:
    """Spans start-end of the assistant's text and end mark, joined by commas."""

    def step(acc, t):
        start = acc["at"] + F.length(t["role"]) + len(HEAD) + 1
        end = start + F.length(t["text"]) + len(TAIL)
        span = F.array(F.concat(start.cast("string"), F.lit("-"), (end - 1).cast("string")))
        return F.struct(end.cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, empty, step)["spans"], ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns of a and b that have the same role and text."""
    most = F.least(F.size(a), F.size(b))
    same = lambda n, i: F.when((n == i - 1) & (F.element_at(a, i)["role"] == F.element_at(b, i)["role"]) & (F.element_at(a, i)["text"] == F.element_at(b, i)["text"]), i).otherwise(n)
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), same)).otherwise(0)


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """chosen and rejected: (pair id, turns) with one row per pair.  One training example per pair id of either side."""
    both = chosen.select(pair_col, F.col("turns").alias("c")).join(rejected.select(pair_col, F.col("turns").alias("r")), pair_col, "full")
    c, r = F.coalesce("c", F.expr("slice(r, 1, 0)")), F.coalesce("r", F.expr("slice(c, 1, 0)"))
    both = both.withColumns({"cc": c, "rr": r}).withColumn("n", F.when(F.col("c").isNull() | F.col("r").isNull(), 0).otherwise(common_prefix(F.col("cc"), F.col("rr"))))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    side = lambda name, value: F.when(F.col(name).isNotNull(), value)
    return both.select(
        pair_col,
        F.col("n").cast("long").alias("prompt_turns"),
        _render(F.slice("cc", 1, F.col("n"))).alias("prompt"),
        side("c", _render(rest("cc"))).alias("chosen"),
        side("c", _mask(rest("cc"))).alias("chosen_mask"),
        side("r", _render(rest("rr"))).alias("rejected"),
        side("r", _mask(rest("rr"))).alias("rejected_mask"),
    )


def pair_neighbours(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations 2k (chosen) and 2k+1 (rejected) make pair k."""
    whole = conversations_as_turns(turns)
    pair = F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id")  # exact for every long
    odd = F.pmod(F.col("conv_id"), F.lit(2)) == 1
    return whole.where(~odd).select(pair, "turns"), whole.where(odd).select(pair, "turns")


def pair_other_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation (chosen) and itself with another's last reply in the place of its own (rejected); the other is 2k+1 for 2k and 2k for 2k+1.

    So both share all turns before the last reply.  A conversation without a reply gets the other's behind its turns; where the
    other has none, or isn't there, the pair has no rejected side.
    """
    whole = conversations_as_turns(turns)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    whole = whole.select(F.col("conv_id").cast("long").alias("pair_id"), "turns", last.alias("last"))
    replies = whole.where(F.col("last").isNotNull()).select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.element_at("turns", F.col("last")).alias("other"))
    kept = F.slice("turns", 1, F.coalesce(F.col("last") - 1, F.size("turns")))
    rejected = whole.join(replies, "pair_id").select("pair_id", F.concat(kept, F.array("other")).alias("turns"))
    return whole.select("pair_id", "turns"), rejected
