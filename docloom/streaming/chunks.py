"""Structured Streaming over page chunks.

Three steps, each restartable on its own checkpoint:

1. :func:`write_chunks` translates the chunks of a stream and appends them to a chunk
   table (file sink, exactly once), one file for each slot of documents and trigger.
2. :func:`write_progress` reads that table as a stream and keeps, for each document, which
   indices have arrived. Bodies never enter the state: it holds index numbers only, one entry
   each, and at most ``BUCKET`` chunks have one key, so a very long document is spread over many.
3. Finished documents and previews are plain queries over the two tables.

State lies in RocksDB. Every writer takes the ``trigger`` it runs by; without one it reads what
there is and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from docloom.functions import fixed
from docloom.operators.assemble import assemble_parts
from docloom.operators.policy import RetryPolicy
from docloom.operators.translate import translate_chunks

BUCKET = 4096
CHUNK_SCHEMA = "doc_id long, chunk_index long, chunk_total long, html string"
SLOTS = 64
TABLE_SCHEMA = CHUNK_SCHEMA + ", status string, attempts int, done long, received_at timestamp, slot int"
PROGRESS_SCHEMA = ("doc_id long, bucket long, arrived long, expected long, chunk_total long, rejected long, "
                   "finished boolean, abandoned boolean, version long")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000


def read_chunk_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None,
                      schema: str = CHUNK_SCHEMA, bytes_per_trigger: int | None = None) -> DataFrame:
    """A folder of chunk files; a trigger takes so many files or bytes, or all there are."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(path)


def _started(writer: DataStreamWriter, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _started_with_state(writer: DataStreamWriter, spark: SparkSession, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """Settings are read when a query starts; the session's own come back after. A query that
    is to end must not go on with triggers without data, which timers ask for without end."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE}
    if trigger is None or "availableNow" in trigger or "once" in trigger:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        return _started(writer, checkpoint, trigger)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stream_chunks(chunks: DataFrame, fn: Callable[[str], str], policy: RetryPolicy | None = None) -> DataFrame:
    """One event for each finished chunk: index, total, how many are done, and its HTML."""
    done = translate_chunks(chunks, fn, policy, spread=False)
    return done.select(
        "doc_id", "chunk_index", "chunk_total", "html", "status", "attempts",
        (F.col("chunk_index") + 1).alias("done"), F.current_timestamp().alias("received_at"))


def slot_of(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SLOTS)).cast("int")


def write_chunks(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append to the chunk table, in folders by a hash of the document. Rows are placed by
    that hash first: a trigger adds one file to a folder, not one for each of its tasks."""
    placed = events.withColumn("slot", slot_of()).repartition("slot")
    writer = placed.writeStream.format("parquet").outputMode("append").partitionBy("slot").option("path", path)
    return _started(writer, checkpoint, trigger)


class Arrivals(StatefulProcessor):
    """The chunks of a (document, bucket) that have arrived: one map entry an index."""

    def __init__(self, bucket: int, forget_after_ms: int, abandon_after_ms: int) -> None:
        self.bucket, self.forget_after_ms, self.abandon_after_ms = bucket, forget_after_ms, abandon_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "chunk_index long", "here boolean")
        self.open = handle.getValueState("open", "arrived long, total long, rejected long, version long, timer long")
        self.closed = handle.getValueState("closed", "total long, version long", self.forget_after_ms)

    def _row(self, key: tuple, arrived: int, total: int, rejected: int, version: int, finished: bool = False,
             abandoned: bool = False) -> pd.DataFrame:
        doc_id, number = key
        good = number >= 0
        return pd.DataFrame({
            "doc_id": [doc_id], "bucket": [number], "arrived": [arrived],
            "expected": [self._expected(number, total)], "chunk_total": pd.array([total if good else None], "Int64"),
            "rejected": [rejected], "finished": [finished], "abandoned": [abandoned], "version": [version]})

    def _expected(self, number: int, total: int) -> int:
        return max(0, min(self.bucket, total - number * self.bucket)) if number >= 0 else 0

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        number, indices, highest, count = key[1], set(), 0, 0
        for pdf in rows:
            count += len(pdf)
            if number >= 0:
                indices.update(pdf["chunk_index"].astype("int64").tolist())
                highest = max(highest, int(pdf["chunk_total"].max()))
        if self.closed.exists():
            total, version = self.closed.get()
            total = max(total, highest)
            self.closed.update((total, version + 1))
            yield self._row(key, self._expected(number, total), total, 0, version + 1, finished=True)
            return
        arrived, total, rejected, version, timer = self.open.get() if self.open.exists() else (0, 0, 0, 0, -1)
        total, version = max(total, highest), version + 1
        if number < 0:
            rejected += count
        for k in indices:
            if not self.seen.containsKey((k,)):
                self.seen.updateValue((k,), (True,))
                arrived += 1
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if number >= 0 and arrived >= self._expected(number, total):
            self.seen.clear()
            self.open.clear()
            self.closed.update((total, version))
            yield self._row(key, arrived, total, 0, version, finished=True)
            return
        timer = -1
        if number >= 0:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.abandon_after_ms
            self.handle.registerTimer(timer)
        self.open.update((arrived, total, rejected, version, timer))
        yield self._row(key, arrived, total, rejected, version)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            arrived, total, rejected, version, _ = self.open.get()
            self.open.update((arrived, total, rejected, version + 1, -1))
            yield self._row(key, arrived, total, rejected, version + 1, abandoned=True)


def track_arrivals(chunks: DataFrame, forget_after_ms: int = DAY_MS,
                   abandon_after_ms: int = 30 * DAY_MS) -> DataFrame:
    """``PROGRESS_SCHEMA`` rows of the keys that a trigger touched.

    A repeated index changes nothing. An index that is null, negative or past the end counts
    as ``rejected``, under bucket -1, and never as arrived. A finished bucket drops its indices
    and keeps an empty mark for ``forget_after_ms``, so a late repeat cannot open it again. An
    open bucket that nothing reaches for ``abandon_after_ms`` is reported as ``abandoned``; its
    indices stay, and it goes on where it was when chunks come again. Both times count from when
    a row is read, whatever time it holds. Of a key's rows the one of the highest ``version`` holds.
    """
    good = (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("chunk_total"))
    keyed = chunks.select(
        "doc_id", F.when(good, F.floor(F.col("chunk_index") / BUCKET)).otherwise(-1).cast("long").alias("bucket"),
        "chunk_index", "chunk_total")
    return keyed.groupBy("doc_id", "bucket").transformWithStateInPandas(
        Arrivals(BUCKET, forget_after_ms, abandon_after_ms), PROGRESS_SCHEMA, "Update", "ProcessingTime")


def write_progress(progress: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Progress rows of trigger ``n`` overwrite ``path/batch_id=n``, so a replay is harmless."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = progress.writeStream.outputMode("update").foreachBatch(save)
    return _started_with_state(writer, progress.sparkSession, checkpoint, trigger)


def latest_progress(table: DataFrame) -> DataFrame:
    """Chunks done of all chunks, for each document: ``(doc_id, done, total, rejected, abandoned)``."""
    last = F.max(F.struct("version", "finished", "arrived", "chunk_total", "rejected", "abandoned")).alias("last")
    buckets = table.groupBy("doc_id", "bucket").agg(last).select("doc_id", "last.*")
    return buckets.groupBy("doc_id").agg(
        F.sum("arrived").alias("done"), F.max("chunk_total").alias("total"), F.sum("rejected").alias("rejected"),
        F.max("abandoned").alias("abandoned"))


class Finished(StatefulProcessor):
    """The finished buckets of a document, one map entry each; after its event a mark."""

    def __init__(self, bucket: int, forget_after_ms: int) -> None:
        self.bucket, self.forget_after_ms = bucket, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("buckets", "bucket long", "here boolean")
        self.open = handle.getValueState("open", "count long, total long")
        self.told = handle.getValueState("told", "total long", self.forget_after_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        numbers, highest = set(), 0
        for pdf in rows:
            numbers.update(pdf["bucket"].tolist())
            highest = max(highest, int(pdf["chunk_total"].max()))
        if self.told.exists():
            self.told.update(self.told.get())
            return
        count, total = self.open.get() if self.open.exists() else (0, 0)
        total = max(total, highest)
        for k in numbers:
            if not self.buckets.containsKey((k,)):
                self.buckets.updateValue((k,), (True,))
                count += 1
        if count < -(-total // self.bucket):
            self.open.update((count, total))
            return
        self.buckets.clear()
        self.open.clear()
        self.told.update((total,))
        yield pd.DataFrame({"doc_id": [key[0]], "chunk_total": [total]})


def track_done(progress: DataFrame, forget_after_ms: int = 30 * DAY_MS) -> DataFrame:
    """A stream of progress rows to ``(doc_id, chunk_total)``, once for each document, in the
    trigger that brings its last bucket."""
    ready = progress.where("finished and bucket >= 0").select("doc_id", "bucket", "chunk_total")
    return ready.groupBy("doc_id").transformWithStateInPandas(
        Finished(BUCKET, forget_after_ms), "doc_id long, chunk_total long", "Update", "ProcessingTime")


def read_progress_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None,
                         bytes_per_trigger: int | None = None) -> DataFrame:
    return read_chunk_stream(spark, f"{path}/*", files_per_trigger, PROGRESS_SCHEMA, bytes_per_trigger)


def write_done(done: DataFrame, chunk_path: str, originals: DataFrame, path: str, checkpoint: str,
               trigger: dict | None = None) -> StreamingQuery:
    """The closing event of each document in ``done``, one row for each part of it.

    ``originals`` has (doc_id, original_html, language, provider). Trigger ``n`` overwrites
    ``path/batch_id=n``. Only the folders of the chunk table that newly finished documents lie
    in are read.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ids = batch.select("doc_id", slot_of().alias("slot")).persist()
        slots = [r[0] for r in ids.select("slot").distinct().collect()]  # at most SLOTS
        table = spark.read.schema(TABLE_SCHEMA).parquet(chunk_path).where(F.col("slot").isin(slots))
        ready = table.join(ids.select("doc_id"), "doc_id", "left_semi")
        documents = assemble_parts(latest_chunks(ready), "doc_id")
        done_events(documents, originals).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        ids.unpersist()

    return _started_with_state(done.writeStream.outputMode("update").foreachBatch(save), done.sparkSession, checkpoint, trigger)


def latest_chunks(table: DataFrame) -> DataFrame:
    """One row for each index: a chunk delivered again replaces the earlier one."""
    newest = F.max(F.struct("received_at", "html", "status"))
    # an index past the end belongs to no document
    return table.where("chunk_index >= 0 and chunk_index < chunk_total").groupBy("doc_id", "chunk_index").agg(
        newest.alias("n"), F.max("chunk_total").alias("chunk_total")
    ).select("doc_id", "chunk_index", "chunk_total", F.col("n.html").alias("html"),
             F.col("n.status").alias("status"))


def finished_documents(chunk_table: DataFrame, progress_table: DataFrame) -> DataFrame:
    """The assembled HTML of every document whose chunks have all arrived, in parts.

    Only complete documents are looked up; their ids may be many, so this is an ordinary
    semi join that Spark broadcasts only when it measures the ids as small.
    """
    complete = latest_progress(progress_table).where(F.col("done") >= F.col("total")).select("doc_id")
    ready = chunk_table.join(complete, "doc_id", "left_semi")
    return assemble_parts(latest_chunks(ready), "doc_id")


def partial_preview(chunk_table: DataFrame) -> DataFrame:
    """What has arrived so far, in index order, gaps skipped."""
    return assemble_parts(latest_chunks(chunk_table), "doc_id", header=fixed.PREVIEW_HEADER)


def done_events(documents: DataFrame, originals: DataFrame) -> DataFrame:
    """The closing events: one row for each part of a document, the original with part 0."""
    return documents.join(originals, "doc_id").select(
        "doc_id", F.lit("done").alias("type"), "part_no", "part_total", "html",
        F.when(F.col("part_no") == 0, F.col("original_html")).alias("original_html"), "language", "provider",
        F.lit(None).cast("string").alias("translated_pdf_b64"))


def write_corrections(entries: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append correction entries as they come."""
    writer = entries.writeStream.format("json").outputMode("append").option("compression", "gzip").option("path", path)
    return _started(writer, checkpoint, trigger)


def run_to_end(query, seconds: int | None = None) -> None:
    """Wait until all that is available has been read; with ``seconds``, no longer than that."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError("stream did not finish")
