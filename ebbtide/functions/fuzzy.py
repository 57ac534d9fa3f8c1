"""Jaro and Jaro-Winkler similarity, which Spark has no function for (levenshtein it has).

Half the transpositions count, unrounded, and the prefix bonus holds at every similarity. Nulls give null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = [True] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            mine.append(c)
    if not mine:
        return 0.0
    theirs = [c for c, unused in zip(b, free, strict=True) if not unused]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True))
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    near = jaro(a, b)
    return near + same * scale * (1 - near)


def similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler of two columns."""

    @F.pandas_udf("double")
    def scored(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return scored(a, b)
