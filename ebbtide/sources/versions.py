"""A table as a folder of versions, written by several writers at once without a lock.

The table is dealt into parts. A write puts the parts that it changes into a folder of their own, which nothing refers to
yet, and then claims the next version: a manifest that names the folder of every part, made by an atomic create that fails
if the version is taken. Whoever loses the race reads what the winners changed: parts that they left alone keep the folder
already written, the others are built again from the newest rows. So no write is lost and none is seen in half, and a job
that dies before its claim leaves a folder that `prune` removes. A manifest also carries the last number of every writer that
numbers its writes: a number that is there already is not written again, which a restarted stream relies on.

Readers take one manifest, so they see one version; `changes` tells two versions apart, reading only parts that differ.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPREAD = 8  # files of a part


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[int, str | None]  #: part to folder below data/, None if it was emptied
    writers: dict[str, int] = field(default_factory=dict)  #: their last numbers


NONE = Version(-1, {})


class Versions:
    def __init__(self, spark: SparkSession, path: str, ddl: str, part: Column | None = None, parts: int = 1):
        """part: 0 to parts - 1 from the table's columns."""
        self.spark, self.path, self.ddl, self.parts = spark, path.rstrip("/"), ddl, parts
        self.part = F.lit(0) if part is None else part

    # ---- files ----

    def _place(self, *names: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _listed(self, *names: str) -> list:
        files, place = self._place(*names)
        return list(files.listStatus(place)) if files.exists(place) else []

    def _claim(self, name: str, body: str) -> bool:
        """Make a small file whole, unless it is there: a rename where the store refuses to replace, a link on local disks, which don't refuse."""
        files, target = self._place("log", name)
        _, draft = self._place("log", f".{name}-{uuid4().hex}")
        out = files.create(draft, True)
        out.write(body.encode())
        out.close()
        if files.getUri().getScheme() == "file":
            nio, there = self.spark._jvm.java.nio.file, lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                nio.Files.createLink(there(target), there(draft))
            except Exception as refused:
                if "FileAlreadyExists" not in str(refused):
                    raise
                return False
            finally:
                files.delete(draft, False)
            return True
        if not files.exists(target) and files.rename(draft, target):
            return True
        files.delete(draft, False)
        return False

    # ---- versions ----

    def numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._listed("log"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self, number: int | None = None) -> Version:
        """That version, or the newest."""
        if number is None:
            known = self.numbers()
            if not known:
                return NONE
            number = known[-1]
        if number < 0:
            return NONE
        files, place = self._place("log", f"{number:012d}.json")
        told = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream := files.open(place))))
        stream.close()
        return Version(number, {int(p): f for p, f in told["folders"].items()}, told["writers"])

    def read(self, version: Version | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        version = self.version() if version is None else version
        wanted = version.folders if parts is None else {p: version.folders.get(p) for p in parts}
        paths = [f"{self.path}/data/{f}/part={p}" for p, f in sorted(wanted.items()) if f]
        return self.spark.read.schema(self.ddl).parquet(*paths) if paths else self.spark.createDataFrame([], self.ddl)

    def paired(self, saved: DataFrame, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """A row for each key: the keys, `o` with the other columns of its saved row, `n` with those of its row in rows, null if there is none.

        Both are shuffled once, to where a write lays them into files, and met there by grouping, which (unlike a join) doesn't
        deal them by all keys again; so what comes of it can be written where it lies. Nulls are equal; keys are unique.
        """
        kinds = {f.name: f.dataType for f in T.StructType.fromDDL(self.ddl)}
        side = lambda df, name: df.select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), F.struct(F.lit(True).alias("there"), *(c for c in df.columns if c not in keys)).alias(name))
        both = side(saved, "o").unionByName(side(rows, "n"), allowMissingColumns=True)
        place = both.withColumns({"_part": self.part, "_slot": F.pmod(F.xxhash64(*keys), F.lit(SPREAD))}).repartition("_part", "_slot")
        return place.groupBy("_part", "_slot", *keys).agg(F.first("o", True).alias("o"), F.first("n", True).alias("n")).drop("_part", "_slot")

    def _write(self, rows: DataFrame, dealt: bool = False) -> tuple[str, set[int]]:
        fields, name = T.StructType.fromDDL(self.ddl), uuid4().hex
        held = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)).withColumn("part", self.part)
        flat = [f.name for f in fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        laid = held if dealt else held.repartition("part", F.pmod(F.xxhash64(*flat), F.lit(SPREAD)))
        laid.write.partitionBy("part").parquet(f"{self.path}/data/{name}")
        return name, {int(s.getPath().getName()[5:]) for s in self._listed("data", name) if s.getPath().getName().startswith("part=")}

    def commit(self, parts: set[int], build: Callable[[DataFrame, set[int]], DataFrame], writer: str = "", number: int = 0, after: int | None = None, dealt: bool = False) -> Version | None:
        """Replace these parts by build(their rows, parts), whatever other writers do meanwhile.

        A named writer's number is written once: None if its last one is no less, or isn't `after`, where that is given.
        build may be called again, with newer rows and fewer parts, and must depend on them alone. dealt: what it gives
        lies as `paired` laid it.
        """
        done: dict[int, str | None] = {}
        base, stale = self.version(), set(parts)
        while True:
            if writer and (base.writers.get(writer, -1) >= number or (after is not None and base.writers.get(writer, -1) != after)):
                return None
            if stale:
                name, full = self._write(build(self.read(base, stale), stale), dealt)
                done |= {p: name if p in full else None for p in stale}
            made = Version(base.number + 1, base.folders | done, base.writers | ({writer: number} if writer else {}))
            if self._claim(f"{made.number:012d}.json", json.dumps({"folders": made.folders, "writers": made.writers})):
                return made
            newest = self.version()
            stale = {p for p in parts if newest.folders.get(p) != base.folders.get(p)}
            base = newest

    def changed_parts(self, since: int, until: int) -> set[int]:
        old, new = self.version(since).folders, self.version(until).folders
        return {p for p in {*old, *new} if old.get(p) != new.get(p)}

    def changes(self, since: int, until: int) -> DataFrame:
        """The rows that two versions don't share, with `weight`: -1 of the earlier, 1 of the later (or as many as there are copies)."""
        fields = T.StructType.fromDDL(self.ddl).fieldNames()
        return self.both_sides(since, until).groupBy(*fields).agg(F.sum("weight").alias("weight")).where("weight <> 0")

    def both_sides(self, since: int, until: int) -> DataFrame:
        """The rows of the parts that two versions don't share, with `weight` -1 and 1, unpaired: for sums, which need no pairs and so no shuffle of rows."""
        parts = self.changed_parts(since, until)
        sides = [self.read(self.version(v), parts).withColumn("weight", F.lit(w)) for v, w in ((since, -1), (until, 1))]
        return sides[0].unionByName(sides[1])

    def prune(self, keep: int = 2, unclaimed_seconds: float = 86_400) -> None:
        """Delete old manifests, and data that none of those kept refers to; what is younger may belong to a write that is under way."""
        kept = [self.version(n) for n in self.numbers()[-keep:]]
        if not kept:
            return
        files, _ = self._place("log")
        for n in self.numbers():
            if n < kept[0].number:
                files.delete(self._place("log", f"{n:012d}.json")[1], False)
        used = {f for v in kept for f in v.folders.values()}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        for s in self._listed("data"):
            if s.getPath().getName() not in used and now - s.getModificationTime() >= 1000 * unclaimed_seconds:
                files.delete(s.getPath(), True)

