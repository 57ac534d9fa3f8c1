"""Calendars as files: a Spark data source that writes one .ics file for each row of (name, content).

    spark.dataSource.register(CalendarSink)
    rows.write.format("calendar").mode("append").save("s3://bucket/calendars")

Every write goes to a folder of its own, dealt into subfolders by a hash of the name. Once all tasks are done, one small
file, `CURRENT`, is replaced to name that folder: readers see all files of a write or none, and a task that runs twice
writes the same bytes to the same place. The folder of a write that fails is never read, and removed once its tasks have stopped. The path must be one that all executors share and that
pyarrow's file systems reach (local mounts, hdfs, s3, gs). Contents are written byte for byte as UTF-8; a null content is an
empty file, of rows with one name the last one written stays.

Reading is by the same source: a task takes one subfolder, lists it and reads its files, so neither the names nor a task for
each few files pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote
from uuid import uuid4
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FOLDERS = 256


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))


def file_name(name: str | None) -> str:
    """Any name as a file's, and the folder it falls in."""
    safe = quote(name, safe="") if name is not None else "%"
    return f"{crc32(safe.encode()) % FOLDERS:02x}/{safe}.ics"


@dataclass
class Written(WriterCommitMessage):
    files: int


class CalendarWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        store, top = _files(self.path)
        many, made = 0, set()
        for row in iterator:
            folder, _, name = file_name(row["name"]).partition("/")
            if folder not in made:
                store.create_dir(f"{top}/{self.job}/{folder}", recursive=True)
                made.add(folder)
            with store.open_output_stream(f"{top}/{self.job}/{folder}/{name}") as out:
                out.write((row["content"] or "").encode())
            many += 1
        return Written(many)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _files(self.path)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/.CURRENT-{self.job}") as out:
            out.write(self.job.encode())
        store.move(f"{top}/.CURRENT-{self.job}", f"{top}/CURRENT")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, top = _files(self.path)
        if store.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/{self.job}")


@dataclass
class Folder(InputPartition):
    path: str


class CalendarReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        store, top = _files(self.path)
        with store.open_input_stream(f"{top}/CURRENT") as told:
            job = told.read().decode()
        held = store.get_file_info(fs.FileSelector(f"{top}/{job}", allow_not_found=True))
        return [Folder(f.path) for f in held if f.type == fs.FileType.Directory] or [Folder("")]  # none: an empty frame

    def read(self, partition: Folder) -> Iterator[tuple[str | None, str]]:
        from pyarrow import fs

        store, _ = _files(self.path)
        for f in store.get_file_info(fs.FileSelector(partition.path)) if partition.path else ():
            stored = f.base_name.removesuffix(".ics")
            with store.open_input_stream(f.path) as content:
                yield None if stored == "%" else unquote(stored), content.read().decode()


class CalendarSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> CalendarWriter:
        return CalendarWriter(self.options["path"])

    def reader(self, schema: StructType) -> CalendarReader:
        return CalendarReader(self.options["path"])


def write_calendars(calendars: DataFrame, path: str, name: str) -> None:
    """Write build_calendar's rows, a file for each value of column `name`."""
    calendars.sparkSession.dataSource.register(CalendarSink)
    calendars.select(F.col(name).cast("string").alias("name"), "content").write.format("calendar").mode("append").save(path)


def read_calendars(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files that the last complete write made."""
    spark.dataSource.register(CalendarSink)
    return spark.read.format("calendar").load(path)
