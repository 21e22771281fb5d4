"""Column builders for JSON lists of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_depth(json: Column) -> Column:
    """How deep the lists of a JSON text are nested; brackets inside strings don't count."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]]", "")
    step = lambda s, c: F.struct((s["now"] + F.when(c == "[", 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c == "[", 1).otherwise(-1)).alias("most"))
    chars = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def unnested(items: Column) -> Column:
    """An array of variants with one level of lists resolved, in order."""
    return F.flatten(F.transform(items, lambda x: F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")).otherwise(F.array(x))))


def flat_strings(df: DataFrame, json: str, out: str = "flat") -> DataFrame:
    """df with the non-empty strings of a JSON text that holds strings and lists of any depth, in order.

    Numbers, objects and nulls among them are left out; a text that isn't a list, or isn't JSON, has none.  How often a
    level has to be resolved is read off the table first, in one pass; then all is one narrow projection.
    """
    deepest = df.select(F.max(list_depth(F.col(json)))).first()[0] or 0
    items = F.coalesce(F.try_variant_get(F.try_parse_json(json), "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = df.withColumn(out, items)
    for _ in range(deepest - 1):
        rows = rows.withColumn(out, unnested(F.col(out)))
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string"))
    return rows.withColumn(out, F.filter(F.transform(out, text), lambda t: F.length(t) > 0))
