"""Bounded labelled samples and logistic calibration for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import is_held_out

#: Learning texts of each class without which no classifier is fitted.
LEAST = 5


def too_few(counts: dict[int, int]) -> bool:
    return min(counts.get(0, 0), counts.get(1, 0)) < LEAST


def sample_labels(labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", held_out_of: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """(id, label) of about max_rows / 2 rows of each class at most, and the classes' counts over all learning rows.

    Rows whose id is held out, and rows with a null id or label, are left out.  Which rows are taken depends on the
    ids' hashes alone.  The result has a bound that does not grow with the input, so it may be broadcast.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~is_held_out(F.col(id_col), held_out_of)).select(id_col, F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, F.lit(max_rows / 2 / n)).otherwise(rate)
    point = F.pmod(F.xxhash64(id_col, F.lit("labelled")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return usable.where(point < rate), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients (last: intercept) of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(y))])
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
