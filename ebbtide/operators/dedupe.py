"""Rows that overlapping captures show twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.core import fresh

KEY = ("source", "normalized_label", "amount_cents", "date", "direction")


def first_captures(rows: DataFrame, key: tuple[str, ...] = KEY, scope: str = "import_id") -> DataFrame:
    """rows with `is_first`: whether a row's capture is the first (by pos) that shows its key; nulls are equal.

    The first capture is aggregated before the shuffle and joined back, so a key that holds a great share of all rows is
    neither gathered in a window nor a skewed task (Spark splits such a join's partitions). Only keys that more than one capture
    shows come back, and the join sorts by one number, a hash, before it compares keys (structs are equal where their nulls are).
    """
    columns = (scope, *key)
    hashed, held, first = (fresh(rows, c) for c in ("_hash", "_held", "_first"))
    shown = rows.groupBy(*columns).agg(F.min_by("capture_index", "pos").alias("_first"), F.min("capture_index").alias("_least"), F.max("capture_index").alias("_most"), F.count("capture_index").alias("_known"), F.count("*").alias("_n"))
    one = F.col("_least").eqNullSafe(F.col("_first")) & F.col("_most").eqNullSafe(F.col("_first")) & F.col("_known").isin(F.lit(0), F.col("_n"))
    several = shown.where(~one).select(F.xxhash64(*columns).alias(hashed), F.struct(*columns).alias(held), F.col("_first").alias(first))
    found = rows.join(several, (F.xxhash64(*columns) == F.col(hashed)) & (F.struct(*columns) == F.col(held)), "left")
    return found.withColumn("is_first", F.col(hashed).isNull() | F.col("capture_index").eqNullSafe(F.col(first))).select(*rows.columns, "is_first")


def dedupe(rows: DataFrame, key: tuple[str, ...] = KEY, scope: str = "import_id") -> DataFrame:
    """Rows of the first capture of their key. Repeats inside that capture stay: they can be two real payments."""
    return first_captures(rows, key, scope).where("is_first").drop("is_first")
