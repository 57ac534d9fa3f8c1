"""Regular payments: same period between all payment days of a group, amounts that stay stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.money import is_stable

# The gaps in days that count as each period (inclusive).
GAPS = (("weekly", 5, 9), ("monthly", 26, 35), ("quarterly", 84, 98), ("yearly", 350, 380))


def period_of_gap(days: Column) -> Column:
    chain = F
    for name, least, most in GAPS:
        chain = chain.when(days.between(least, most), F.lit(name))
    return chain


def regular_groups(rows: DataFrame, keys: list[str], date: str = "date", cents: str = "amount_cents") -> DataFrame:
    """(keys, period, occurrences) of the groups of rows whose payments are regular.

    Days are made distinct before the window, so a group's window holds a calendar's days at most, however many rows
    the group has. Undated rows and null amounts don't count; a group without two days is not regular.
    """
    days = rows.where(F.col(date).isNotNull()).groupBy(*keys, F.col(date).alias("_day")).agg(F.min(cents).alias("_least"), F.max(cents).alias("_most"))
    gap = F.datediff("_day", F.lag("_day").over(Window.partitionBy(*keys).orderBy("_day")))
    gaps = days.withColumn("_gap", gap).withColumn("_period", period_of_gap(F.col("_gap")))
    found = gaps.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count("_gap").alias("_gaps"), F.count("_period").alias("_fit"), F.min("_period").alias("_a"), F.max("_period").alias("_z"), F.min("_least").alias("_least"), F.max("_most").alias("_most")
    )
    regular = (F.col("_n") >= 2) & (F.col("_gaps") == F.col("_fit")) & (F.col("_a") == F.col("_z")) & is_stable(F.col("_least"), F.col("_most"))
    return found.where(regular).select(*keys, F.col("_a").alias("period"), F.col("_n").alias("occurrences"))


def periodicity(rows: DataFrame, keys: list[str], date: str = "date", cents: str = "amount_cents") -> DataFrame:
    """(keys, period, occurrences) of every group of rows; both null where payments are not regular."""
    told = regular_groups(rows, keys, date, cents).select(*(F.col(k).alias(f"_{k}") for k in keys), "period", "occurrences")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.select(*keys).distinct().join(told, same, "left").select(*keys, "period", "occurrences")
