"""Session helpers shared by the whole library."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where none is named, a folder of our own, in local mode alone."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ebbtide-checkpoints-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder: lineage ends there and a lost executor costs a reread."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_distinct(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    """rows with columns that depend on `key` alone, computed once for each distinct value of it.

    Distinct values are found before the shuffle; a few of them are broadcast back by Spark's own choice.
    """
    name = fresh(rows, "_key")
    known = rows.select(F.col(key)).distinct().withColumns(columns).select(F.col(key).alias(name), *columns)
    return rows.join(known, F.col(key).eqNullSafe(F.col(name)), "left").drop(name)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most that many rows (counted); a larger one is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which needn't have it installed; once for each application."""
    name = f"ebbtide-{spark.sparkContext.applicationId}.zip"
    target = Path(tempfile.gettempdir(), name)
    if any(name in str(f) for f in spark.sparkContext.listFiles) or target.exists():
        return
    here = Path(__file__).parent
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(here.rglob("*.py")):
            out.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(target))
