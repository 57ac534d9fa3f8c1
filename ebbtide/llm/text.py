"""Helpers for Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pieces(texts: pd.Series, limit: int) -> Iterator[list[str]]:
    """The batch's texts in order, nulls as empty strings, in lists of about `limit` characters (one text at least)."""
    held, size = [], 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
