"""Similarities and distances."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def sequence_bound(a: Column, b: Column) -> Column:
    """A native upper bound of ``sequence_ratio``: twice the shorter length over both."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; not symmetric. Spark has no such function: filter by ``sequence_bound`` first where a threshold allows it."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays; null where one is null or their sizes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        out = out + (x - y) * (x - y)
    return out


def cell_max_all(thumbs: np.ndarray, one: np.ndarray, grid: tuple[int, int] = (12, 3)) -> np.ndarray:
    """For each of ``thumbs`` (n, height, width), the largest mean absolute difference to ``one`` over a grid of cells (columns, rows)."""
    n, h, w = thumbs.shape
    cols, rows = grid
    return np.abs(thumbs - one).reshape(n, rows, h // rows, cols, w // cols).mean(axis=(2, 4)).max(axis=(1, 2))
