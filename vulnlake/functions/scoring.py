"""Column builders for judged scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def five_point(mean: Column) -> Column:
    """Ladder of a mean claim score; exactly 0.9 falls between two rungs and has no value."""
    return F.when(mean > 0.9, 5).when((mean >= 0.7) & (mean < 0.9), 4).when((mean >= 0.3) & (mean < 0.7), 3).when((mean >= 0.1) & (mean < 0.3), 2).when(mean < 0.1, 1)


def round_even(x: Column, digits: int) -> Column:
    """Round half to even on the scaled value, as numpy does."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def attribute_key(category: Column, attribute: Column) -> Column:
    return F.replace(F.concat_ws("_", category, attribute), F.lit(" "), F.lit("_"))


def conformal_rank(n: Column, alpha: float) -> Column:
    """Which order statistic of n nonconformity scores covers 1 - alpha."""
    return F.greatest(F.lit(1), F.least(n, F.ceil((n + 1) * F.lit(1.0 - alpha)))).cast("long")


def ordinal_set(y: Column, q: Column, low: int = 1, high: int = 5) -> Column:
    """Labels within q of the prediction."""
    return F.filter(F.sequence(F.lit(low), F.lit(high)), lambda label: F.abs(label - y) <= q)


def clamp_band(s: Column, t: Column, low: float = 0.0, high: float = 5.0) -> tuple[Column, Column]:
    return F.greatest(s - t, F.lit(low)), F.least(s + t, F.lit(high))


def map_mean(m: Column) -> Column:
    """Mean of a map's values; null for an empty map."""
    values = F.map_values(m)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def token_usage(prompt: Column, completion: Column, cached: Column) -> list[Column]:
    rate = F.when(prompt > 0, round_even(cached / prompt, 4)).otherwise(F.lit(0.0))
    return [prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"), cached.alias("cached_tokens"), (prompt - cached).alias("uncached_prompt_tokens"), rate.alias("cache_hit_rate")]


def billed_input(plain: Column, read: Column, created: Column) -> Column:
    """Input tokens of a provider that bills cache writes at five quarters."""
    return plain - read + F.lit(1.25) * created
