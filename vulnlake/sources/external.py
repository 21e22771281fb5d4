"""Interfaces to what the engine does not do itself: fetching pages and asking models.

Both take a plain function of a batch, so tests and dry runs give canned answers.  Results come back as columns.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_retries(call: Callable[[str], str], tries: int = 5, first_wait: float = 1.0, most_wait: float = 600.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """call, tried again after doubling waits; an error with a `retry_after` attribute says how long to wait itself.

    None after the last failure.
    """

    def run(key: str) -> str | None:
        wait = first_wait
        for left in range(tries - 1, -1, -1):
            try:
                return call(key)
            except Exception as e:  # noqa: BLE001
                if not left:
                    return None
                sleep(min(getattr(e, "retry_after", None) or wait, most_wait))
                wait *= 2
        return None

    return run


def fetch(keys: DataFrame, key_col: str, call: Callable[[str], str | None], out: str = "content") -> DataFrame:
    """keys with what call gives for each; a failed key has null and can be asked for again."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(call)

    return keys.withColumn(out, run(F.col(key_col)))


def ask(prompts: DataFrame, prompt_col: str, model: Callable[[list[str]], list[str]], out: str = "answer") -> DataFrame:
    """prompts with a model's answers, asked for in batches."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(model(column.fillna("").tolist()))

    return prompts.withColumn(out, run(F.col(prompt_col)))
