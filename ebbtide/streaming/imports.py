"""Imports as a stream: captures arrive as files in any order, an import is detected once it is whole, and merged.

An import's captures are held as keyed state until as many have come as the import says it has (`of_captures`, on any of its
rows, or on a row of its own without a capture), or until nothing has come for `wait_seconds`. So how files fall into
micro-batches changes nothing. What comes after a time-out is an import of its own. The portfolio takes a batch in once,
whatever is run again after a failure. A user's imports that get whole in one batch are merged in the order of their ids.

A capture that can't be read counts and is skipped. Every batch reports how many captures it read, skipped and finished, which
`Progress` adds up. Null import ids are an import of their own.

A run over what is there (`available_now`) holds lines in files beside its checkpoint (`Held`): what came and what was held
meet by one shuffle, and no import costs a call. A batch rewrites what is held, and time-outs are looked at when there is data.

A query that stays looks at time-outs every ten seconds, which only state can do without data. A batch's lines of an import
are one value of its state, so state grows by imports and batches and not by lines, but each import costs round trips of
Python. State needs RocksDB as Spark's state store; `merge_stream` asks for it while the query starts. The two kinds can't
read on what the other holds, and a checkpoint of the other kind is refused.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ebbtide.core import checkpointed
from ebbtide.operators.detect import detect
from ebbtide.sources import captures
from ebbtide.sources.store import Portfolio

LINES = (
    "import_id string, capture_id string, capture_index int, line_pos int, text string, segments array<string>, words array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>, "
    "x0 double, y0 double, x1 double, y1 double, confidence double, reference date, unreadable boolean, of_captures int"
)
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: What the last batches of each run gave on, by the run's name and the batch's number, for `Progress`.
FINISHED: dict[str, dict[int, dict[str, int]]] = {}


def line_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over Parquet files of recognised lines; a capture's lines are in one file."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def analyse(lines: DataFrame) -> DataFrame:
    """Subscriptions and other debits of whole imports."""
    readable = lines.where("not coalesce(unreadable, false) and capture_id is not null").drop("of_captures")
    found = detect(checkpointed(captures.transactions(readable)))  # pages are parsed once
    return found.subscriptions.unionByName(found.other_debits)


class Assembly(StatefulProcessor):
    """Holds an import's rows until its captures are complete, or time is up; then gives them all."""

    def __init__(self, wait_seconds: float):
        self.wait = int(1000 * wait_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "body string")
        self.many = handle.getValueState("many", "captures string, expected int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """What comes in one batch is one body; an import that is whole in it is given without being held. Every call of the state costs a round trip."""
        held = self.many.get()
        seen, expected = (set(json.loads(held[0])), held[1]) if held else (set(), None)
        bodies = []
        for row in rows:
            expected = row.of_captures if expected is None else expected
            if row.capture is not None:
                bodies.append(row.body)
                seen.add(row.capture)
        body = f"[{','.join(bodies)}]"
        if held:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if expected is not None and len(seen) >= expected:
            if held:
                yield from self._given()
            yield Row(body=body)
        else:
            if bodies:
                self.rows.appendValue((body,))
            self.many.update((json.dumps(sorted(seen)), expected))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._given()

    def _given(self) -> Iterator[Row]:
        for (body,) in self.rows.get():
            yield Row(body=body)
        for state in (self.rows, self.many):
            state.clear()

    def close(self) -> None:
        pass


def _first_rows(rows: DataFrame) -> Column:
    """One row of each capture: that of its first line, or the one that stands for an unreadable file."""
    return F.col("capture_id").isNotNull() & (F.coalesce("line_pos", F.lit(0)) == 0)


def _arrived(lines: DataFrame) -> DataFrame:
    """The lines, whose captures are counted as they pass."""
    read, skipped = F.count_if(_first_rows(lines)), F.count_if(_first_rows(lines) & F.coalesce("unreadable", F.lit(False)))
    return lines.observe("arrived", read.alias("read"), skipped.alias("skipped"))


def _import_key() -> Column:
    return F.coalesce(F.concat(F.lit("i"), "import_id"), F.lit("none"))  # a key of state isn't null


def _capture() -> Column:
    return F.when(F.col("capture_id").isNotNull(), F.coalesce(F.col("capture_index").cast("string"), F.concat(F.lit("c"), "capture_id")))


class Held:
    """Lines of imports that aren't whole yet, in a folder for each batch of a run over what is there.

    A batch's folder holds the lines that it gives on and those that stay held, decided and written at once; a batch that is
    run again finds its own decision there, so a later clock changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, wait_seconds: float = 3600):
        self.spark, self.path, self.wait = spark, path.rstrip("/"), int(1000 * wait_seconds)

    def _place(self, *names: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def there(self, *names: str) -> bool:
        files, place = self._place(*names)
        return files.exists(place)

    def _read(self, spark: SparkSession, number: int, done: bool, ddl: str) -> DataFrame | None:
        folder = (str(number), f"_done={str(done).lower()}")
        return spark.read.schema(ddl).parquet("/".join((self.path, *folder))) if self.there(*folder) else None

    def taken(self, batch: DataFrame, number: int) -> DataFrame | None:
        """Take a batch's lines in; those of imports that are whole now, or whose time is up, or None. The batch is read once."""
        if not self.there(str(number), "_SUCCESS"):
            self._write(batch, number)
        files, old = self._place(str(number - 2))
        files.delete(old, True)  # the batch before this one is kept until this one is known to be done
        rows = self._read(self.spark, number, True, LINES)
        return None if rows is None else rows.where(_capture().isNotNull())

    def _write(self, batch: DataFrame, number: int) -> None:
        now, names = int(1000 * time.time()), [f.name for f in T.StructType.fromDDL(LINES)]
        rows = batch.select(*names, F.lit(now).cast("bigint").alias("_came"), F.lit(number).cast("bigint").alias("_batch"))
        held = self._read(batch.sparkSession, number - 1, False, f"{LINES}, _came bigint, _batch bigint")
        if held is not None:
            rows = rows.unionByName(held)
        own = Window.partitionBy("_key")
        seen, expected = F.size(F.collect_set("_capture").over(own)), F.min_by("of_captures", F.when(F.col("of_captures").isNotNull(), F.col("_batch"))).over(own)
        late = (F.max("_batch").over(own) < number) & (F.max("_came").over(own) + self.wait <= now)
        told = rows.withColumns({"_key": _import_key(), "_capture": _capture()}).withColumn("_done", F.coalesce(seen >= expected, F.lit(False)) | late)
        told.drop("_key", "_capture").write.mode("overwrite").partitionBy("_done").parquet(f"{self.path}/{number}")


def assembled(lines: DataFrame, wait_seconds: float = 3600) -> DataFrame:
    """A stream of the lines of imports that are whole, held as keyed state."""
    packed = _arrived(lines).select(_import_key().alias("key"), _capture().alias("capture"), "of_captures", F.to_json(F.struct(*lines.columns)).alias("body"))
    whole = packed.groupBy("key").transformWithState(Assembly(wait_seconds), "body string", "Append", "ProcessingTime")
    rows = whole.select(F.inline(F.from_json("body", T.ArrayType(lines.schema))))
    return rows.observe("finished", F.count_if(_first_rows(rows)).alias("captures"), F.count_if(_first_rows(rows) & F.coalesce("unreadable", F.lit(False))).alias("unreadable"))


def merge_stream(
    lines: DataFrame, portfolio: Portfolio, checkpoint: str, now: Callable[[], Column] = F.current_timestamp, available_now: bool = True, wait_seconds: float = 3600, owner: dict[str, Column] | None = None,
    analyse: Callable[[DataFrame], DataFrame] = analyse,
) -> StreamingQuery:
    """Start the stream that keeps the portfolio. owner: the portfolio's scope, from import_id; without it the scope is import_id."""

    def merge(lines: DataFrame, number: int) -> None:
        rows = analyse(lines)
        if owner is None:
            portfolio.save_detections(rows, now(), writer, number)
            return
        rows = rows.withColumns(owner)
        turn = Window.partitionBy(*(F.col(c) for c in owner)).orderBy("import_id")
        rows = rows.withColumn("_turn", F.dense_rank().over(turn)).persist()
        last = rows.agg(F.max("_turn")).first()[0] or 0  # imports of one user in this batch, nearly always 1
        for turn in range(1, last + 1):
            portfolio.save_detections(rows.where(F.col("_turn") == turn).drop("_turn"), now(), f"{writer}/{turn}", number)
        rows.unpersist()

    def from_files(batch: DataFrame, number: int) -> None:
        whole, told = held.taken(batch, number), FINISHED.setdefault(name, {})
        told.pop(number - 100, None)  # long reported
        if whole is not None:
            unreadable = F.coalesce("unreadable", F.lit(False))
            told[number] = whole.agg(F.count_if(_first_rows(whole)).alias("captures"), F.count_if(_first_rows(whole) & unreadable).alias("unreadable")).first().asDict()
            merge(whole, number)

    def from_state(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                merge(batch, number)
        finally:
            batch.unpersist()

    writer, name = f"stream {checkpoint}", f"imports-{uuid4().hex}"
    spark, held = lines.sparkSession, Held(portfolio.spark, f"{checkpoint.rstrip('/')}/held", wait_seconds)
    if Held(spark, checkpoint).there("state" if available_now else "held"):
        raise ValueError("the checkpoint is of a query that stays, whose state a run over what is there can't read" if available_now else "the checkpoint is of runs over what is there, whose files a query that stays can't read")
    if available_now:
        return _arrived(lines).writeStream.foreachBatch(from_files).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        return assembled(lines, wait_seconds).writeStream.foreachBatch(from_state).queryName(name).option("checkpointLocation", checkpoint).trigger(processingTime="10 seconds").start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Progress(StreamingQueryListener):
    """Adds up what import streams report, by run: captures read, skipped (unreadable) and done (in finished imports)."""

    def __init__(self):
        self.counts: dict[str, dict[str, int]] = {}
        self.batches: dict[str, list[dict[str, int]]] = {}
        self.ended = threading.Condition()
        self.over: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics
        if "arrived" not in told:
            return
        done, kept = told.get("finished"), FINISHED.get(event.progress.name, {}).get(event.progress.batchId)
        batch = {"read": told["arrived"].read, "skipped": told["arrived"].skipped, "done": done.captures if done else kept["captures"] if kept else 0}
        with self.ended:
            run = str(event.progress.runId)
            self.batches.setdefault(run, []).append(batch)
            total = self.counts.setdefault(run, dict.fromkeys(batch, 0))
            for k, v in batch.items():
                total[k] += v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.over.add(str(event.runId))
            self.ended.notify_all()

    def of(self, query: StreamingQuery, seconds: float = 60) -> dict[str, int]:
        """The counts of a query that has ended."""
        run = str(query.runId)
        with self.ended:
            self.ended.wait_for(lambda: run in self.over, seconds)
            return dict(self.counts.get(run, {"read": 0, "skipped": 0, "done": 0}))


def live(portfolio: Portfolio, query: Callable[[DataFrame], DataFrame]) -> Callable[[], DataFrame]:
    """A query over the saved rows that reads the newest version each time it is asked."""
    return lambda: query(portfolio.read())


def follow(portfolio: Portfolio, changed: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A stream over the portfolio's versions: `changed` gets the rows that came and went (`weight`) and the newest version's number.

    Manifests are the stream's files, so Spark's checkpoint knows what was seen; a batch that is run again tells the same
    changes with the same number.
    """
    table = portfolio.table

    def tell(batch: DataFrame, _: int) -> None:
        span = batch.agg(F.min("number"), F.max("number")).first()
        if span[0] is not None:
            changed(table.changes(span[0] - 1, span[1]), span[1])

    files = portfolio.spark.readStream.format("text").option("pathGlobFilter", "[0-9]*.json").load(f"{table.path}/log")
    numbered = files.select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("int").alias("number"))
    started = numbered.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if available_now else started).start()
