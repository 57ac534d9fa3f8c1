"""The saved portfolio and the settings, as versioned tables dealt into parts by a hash of the scope.

Any number of writers may work at once (see `versions`): a write touches the parts of its own rows, and a part that another
writer changed meanwhile is worked out again from the newest rows. Null scopes and ids are keys like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.core import checkpointed
from ebbtide.operators.portfolio import STORED, TOTALS, edited, merge_detections, merged, shown_totals, summed_totals, totals_of_changes
from ebbtide.sources.versions import Versions

SETTINGS = "key string, checked_categories array<string>"


class Portfolio:
    def __init__(self, spark: SparkSession, path: str, scope: str = "", parts: int = 16):
        """scope: DDL of key columns that stand before STORED, as `user_id string`; parts: by their hash, rewritten one by one."""
        self.spark, self.path, self.scope_ddl = spark, path.rstrip("/"), scope
        self.ddl = f"{scope}, {STORED}" if scope else STORED
        kinds = T.StructType.fromDDL(scope) if scope else []
        self.scope = tuple(f.name for f in kinds)
        self.keys, self.parts = (*self.scope, "id"), parts if scope else 1
        self.part = F.pmod(F.xxhash64(*(F.col(f.name).cast(f.dataType) for f in kinds)), F.lit(parts)).cast("int") if scope else F.lit(0)
        self.table = Versions(spark, f"{self.path}/subscriptions", self.ddl, self.part, self.parts)
        self.settings = Versions(spark, f"{self.path}/settings", SETTINGS)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.part).distinct().collect()}  # at most `parts`

    def _of(self, rows: DataFrame, parts: set[int]) -> DataFrame:
        return rows.where(self.part.isin(*parts))

    def _write(self, rows: DataFrame, build: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", number: int = 0) -> bool:
        """Commit build(saved, rows) for the parts that rows fall in; False if there is none or the writer's number is known."""
        parts = self._touched(rows)
        return bool(parts) and self.table.commit(parts, lambda saved, stale: build(saved, self._of(rows, stale)), writer, number, dealt=True) is not None

    def _met(self, saved: DataFrame, rows: DataFrame, old: str, new: str) -> DataFrame:
        """Saved rows and rows of one key in one row, their columns behind `old` and `new`; null where there is none."""
        both = self.table.paired(saved, rows, self.keys)
        told = lambda df, side, mark: [(F.when(F.col(f"{side}.there"), F.col(c)) if c in self.keys else F.col(f"{side}.{c}")).alias(f"{mark}{c}") for c in df.columns]
        return both.select(*told(saved, "o", old), *told(rows, "n", new), F.col("o.there").alias("_old"), F.col("n.there").alias("_new"))

    def _without(self, saved: DataFrame, rows: DataFrame) -> DataFrame:
        """Saved rows but those whose key is in rows; nulls are equal."""
        return self._met(saved, rows.select(*self.keys), "", "n_").where("_old and _new is null").select(*saved.columns)

    def _replaced(self, saved: DataFrame, rows: DataFrame) -> DataFrame:
        """Saved rows and rows, which stand for saved ones of their key."""
        return self._met(saved, rows, "o_", "n_").select(*(F.when(F.col("_new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in saved.columns))

    def _edited(self, saved: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
        return edited(self._met(saved, edits, "", "e_").where("_old"), saved.columns, now)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(None if version is None else self.table.version(version))

    def save_detections(self, detected: DataFrame, now: Column, writer: str = "", number: int = 0) -> DataFrame:
        """Merge and save; the counts of added and refreshed rows in the version written. A writer's number is merged once."""
        detected, made = checkpointed(detected), {}

        def build(saved: DataFrame, rows: DataFrame) -> DataFrame:
            told = merge_detections(saved, rows, now, self.scope).select(*self.keys, "change")  # counted: keys and status alone
            made.update(dict.fromkeys(self._touched(rows), told))
            return merged(self._met(saved, rows, "o_", "n_"), saved.columns, now, self.scope)

        wrote = self._write(detected, build, writer, number)
        counted = self.spark.createDataFrame([], "change string")
        for told in {id(m): m for m in made.values()}.values() if wrote else []:
            counted = counted.union(self._of(told, {p for p, m in made.items() if m is told}).select("change"))
        return checkpointed(counted.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "refreshed").alias("refreshed")))  # before what was there is pruned

    def add(self, rows: DataFrame) -> None:
        """Insert rows; those of a known id replace it. Of rows with one id the one updated last counts."""
        names = T.StructType.fromDDL(self.ddl).fieldNames()
        last = F.struct("updated_at", "created_at", F.xxhash64(*names))
        rows = checkpointed(rows.groupBy(*(F.col(k).alias(f"_{k}") for k in self.keys)).agg(F.max_by(F.struct(*names), last).alias("row")).select("row.*"))
        self._write(rows, self._replaced)

    def edit(self, edits: DataFrame, now: Column) -> None:
        edits = checkpointed(edits)
        self._write(edits, lambda saved, own: self._edited(saved, own, now))

    def delete(self, ids: DataFrame) -> None:
        self._write(checkpointed(ids.select(*self.keys)), self._without)

    def checked_categories(self) -> DataFrame:
        """One row; an empty list before anything was saved."""
        told = self.settings.read().where("key = 'memory'")
        return told.agg(F.coalesce(F.first("checked_categories"), F.array().cast("array<string>")).alias("checked_categories"))

    def set_checked_categories(self, categories: list[str]) -> None:
        row = self.spark.createDataFrame([("memory", categories)], SETTINGS)
        self.settings.commit({0}, lambda saved, _: saved.where("key <> 'memory'").unionByName(row))

    def wipe(self) -> None:
        """Empty both tables, rows of writers that come first included."""
        for held in (self.table, self.settings):
            held.commit(set(range(held.parts)), lambda saved, _: saved.where("false"))

    def prune(self, keep: int = 2, unclaimed_seconds: float = 86_400) -> None:
        """Delete versions but the newest, and data that no kept version reads."""
        self.table.prune(keep, unclaimed_seconds)
        self.settings.prune(keep, unclaimed_seconds)


class LiveTotals:
    """Totals of each scope, kept up by what changed between versions and not by recounting.

    They lie in the same parts as the portfolio, so a change rewrites the totals of its own parts alone. The totals' manifest
    says which version they stand for, and a version is taken in once, however many are catching up.
    """

    def __init__(self, portfolio: Portfolio, path: str | None = None):
        self.portfolio = portfolio
        ddl = f"{portfolio.scope_ddl}, {TOTALS}" if portfolio.scope else TOTALS
        self.table = Versions(portfolio.spark, path or f"{portfolio.path}/totals", ddl, portfolio.part, portfolio.parts)

    def seen(self) -> int:
        """The portfolio's version that the totals stand for; -1 for none."""
        return self.table.version().writers.get("portfolio", -1)

    def catch_up(self) -> int:
        """Take in all versions up to the newest; the number of the newest."""
        held, own = self.portfolio.table, self.portfolio
        while (since := self.seen()) < (until := held.version().number):
            delta = checkpointed(totals_of_changes(held.both_sides(since, until), own.scope))
            self.table.commit(held.changed_parts(since, until), lambda saved, stale, delta=delta: summed_totals(saved.unionByName(own._of(delta, stale)), own.scope), "portfolio", until, since)
        return since

    def read(self) -> DataFrame:
        return shown_totals(self.table.read())
