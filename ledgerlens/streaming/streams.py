"""Streaming forms of ingestion, job tracking and review.

The stateless and aggregating operators are the batch ones applied to a stream.
Order is ``(ts, seq)`` everywhere, so a late event never overwrites a newer state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.constants import STATE_TTL_SECONDS, TASK_TIMEOUT_SECONDS
from ledgerlens.operators.frames import latest
from ledgerlens.operators.jobs import current_jobs, partial_jobs
from ledgerlens.session import work_dir
from ledgerlens.sources.files import admit_files, named_files

#: the columns of Spark's ``binaryFile`` source, which a stream has to be told
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


# --- sources ---------------------------------------------------------------------------

def read_table(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; each file is read once (T1), so many at a time.

    ``pattern`` names files, or folders whose files are read: a larger table is a folder of that name.
    """
    # in braces a plain name is a pattern too, which may stand for a file as well as for a folder
    path = f"{folder.rstrip('/')}/{pattern if set(pattern) & set('*?[{') else '{' + pattern + '}'}"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_landing(spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """New files of a landing folder with their header bytes (T1). The source passes over
    files without a byte, so those never become rows."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return named_files(files).drop("content")


# --- operators ----------------------------------------------------------------------------

def ingest(files: DataFrame) -> DataFrame:
    """Admit or refuse every file (T1, T7). A refused file is a row with a reason, and
    the checkpoint marks it seen like any other."""
    checked = admit_files(files)
    status = F.when(F.col("reject_reason").isNull(), F.lit("pending")).otherwise(F.lit("failed"))
    return checked.withColumn("job_status", status)


def job_state(events: DataFrame) -> DataFrame:
    """Current state per job (T2, T8), for update mode. Combines map-side, so a job
    that sends most of the events is still one row per task.

    Spark keeps a row of state for every job there ever was. ``fold_jobs`` keeps none.
    """
    return current_jobs(events)


def fold_jobs(events: DataFrame, name: str = "jobs", folder: str | None = None) -> tuple[str, str]:
    """Reduce every micro-batch to one row per job; ``jobs.merge_jobs`` joins them.

    Nothing is held between batches: events may come late, in any order and over any
    number of batches, and old jobs cost no memory.
    """
    return run_available(events, name, folder=folder, fold=partial_jobs)


def dedupe_jobs(events: DataFrame, keys: list[str], late: str = "24 hours") -> DataFrame:
    """One row per key among rows at most ``late`` apart (T5); state expires with the watermark.

    For sources in time order only: a row more than ``late`` behind the newest one of earlier batches is
    dropped even when it is the first of its key. ``fold_dedupe`` loses none.
    """
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def first_rows(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The row of each key that is first by ``order``; combines map-side."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*rows.columns)


def fold_dedupe(events: DataFrame, keys: list[str], folder: str | None = None) -> tuple[str, str]:
    """Reduce every micro-batch to one row per key; ``first_rows`` over what is read back joins them (T5).

    Nothing is held between batches, so a row counts however late it comes and whatever came before it.
    """
    return run_available(events, "dedupe", folder=folder, fold=lambda batch: first_rows(batch, keys))


class JobTracker(StatefulProcessor):
    """Keyed job state that expires after its last write and times out long phases.

    One row per change of state: the event's status, or ``failed`` with a message when
    a processing phase outlives the limit (seen from a later event or from the timer).
    """

    def __init__(self, timeout_seconds: int = TASK_TIMEOUT_SECONDS, ttl_seconds: int = STATE_TTL_SECONDS):
        self.timeout_ms, self.ttl_ms = timeout_seconds * 1000, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, at_ms long, seq long", ttlDurationMs=self.ttl_ms)

    def _row(self, key, seq, status, message=None):
        return (key[0], seq, status, message)

    def _late(self, seconds):
        return f"Timed out after {seconds}s."

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        current = self.state.get() if self.state.exists() else None
        batch = pd.concat(rows).sort_values(["at_ms", "seq"])
        for at_ms, seq, status in zip(batch["at_ms"], batch["seq"], batch["status"]):
            at_ms, seq = int(at_ms), int(seq)
            if current is not None:
                if (at_ms, seq) <= (current[1], current[2]):
                    continue  # older than what is known
                if current[0] == "processing" and at_ms - current[1] > self.timeout_ms:
                    out.append(self._row(key, current[2], "failed", self._late(self.timeout_ms // 1000)))
            current = (status, at_ms, seq)
            out.append(self._row(key, seq, status))
        if current is not None:
            self.state.update(current)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if current[0] == "processing":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "error_message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            status, at_ms, seq = self.state.get()
            if status == "processing":
                self.state.update(("failed", at_ms, seq))
                out.append(self._row(key, seq, "failed", self._late(self.timeout_ms // 1000)))
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "error_message"])

    def close(self) -> None:
        pass


def track_jobs(events: DataFrame, timeout_seconds: int = TASK_TIMEOUT_SECONDS,
               ttl_seconds: int = STATE_TTL_SECONDS) -> DataFrame:
    """State changes of all jobs with expiry and timeouts.

    Both run on the wall clock: a state expires ``ttl_seconds`` after it was last
    written, a timer fires ``timeout_seconds`` after processing began. Needs the
    RocksDB state store, which ``session.configure`` sets. Ids keep the type they have.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    stamped = events.select("job_id", "seq", "status", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return stamped.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=JobTracker(timeout_seconds, ttl_seconds),
        outputStructType=f"job_id {kind}, seq long, status string, error_message string",
        outputMode="Append", timeMode="ProcessingTime")


class EventTimeTracker(StatefulProcessor):
    """State changes, timeouts and expiry on the clock of the events.

    Events wait in buckets of their own time until the watermark passes the bucket's end, whatever order or batch
    they come in; then the bucket is walked in order of (time, seq). A replay therefore gives the same rows again. A
    bucket is one entry of the state, and ``AT_ONCE`` of them at most are read together, so memory follows the events of few buckets of one job, not the job.
    At a bucket's end, a processing phase that is older than the limit is reported once, and a job whose
    last event is ``ttl`` old is forgotten. Events of buckets that have been walked are too late and are dropped.

    Every look at the state is a round trip between Python and the JVM, so a job has one timer, for the first moment at which
    something is due, and its few waiting buckets are read and cleared together.
    """

    AT_ONCE = 64

    def __init__(self, timeout_seconds: int, ttl_seconds: int, bucket_seconds: int):
        self.timeout_ms, self.ttl_ms, self.bucket_ms = timeout_seconds * 1000, ttl_seconds * 1000, bucket_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at_ms long, seq long, reported boolean")
        self.waiting = handle.getMapState("waiting", "bucket long", "at_ms array<long>, seq array<long>, status array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        known, first = {b[0] for b in self.waiting.keys()}, None
        for chunk in rows:
            parts: dict[int, list[tuple]] = {}
            for event in zip(*(chunk[c].tolist() for c in ("at_ms", "seq", "status"))):
                if not pd.isna(event[0]):
                    parts.setdefault(int(event[0] // self.bucket_ms), []).append(event)
            for bucket, events in parts.items():
                end = (bucket + 1) * self.bucket_ms
                if end <= passed:
                    continue
                held = self.waiting.getValue((bucket,)) if bucket in known else ([], [], [])
                self.waiting.updateValue((bucket,), tuple(list(h) + list(e) for h, e in zip(held, zip(*events))))
                known.add(bucket)
                first = end if first is None else min(first, end)
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all buckets that have ended, so the rows do not depend on how far the watermark jumped
        end = timerValues.getCurrentWatermarkInMs() // self.bucket_ms * self.bucket_ms
        last, out = self.last.get(), []
        held = sorted(b[0] for b in self.waiting.keys())
        ended = [b for b in held if (b + 1) * self.bucket_ms <= end]
        few = {b[0]: events for b, events in self.waiting.iterator()} if ended and len(held) <= self.AT_ONCE else {}
        for bucket in ended:
            for at_ms, seq, status in sorted(set(zip(*(few[bucket] if few else self.waiting.getValue((bucket,)))))):
                last = self._until(key, last, at_ms, out)
                out.append((key[0], seq, status, None))
                last = (status, at_ms, seq, False)
            if len(ended) < len(held):
                self.waiting.removeKey((bucket,))
        if ended and len(ended) == len(held):
            self.waiting.clear()
        last = self._until(key, last, end, out)
        due = [(b + 1) * self.bucket_ms for b in held[len(ended):][:1]]
        if last is None:
            self.last.clear()
        else:
            self.last.update(last)
            due.append(self._after(last[1] + self.ttl_ms))
            if last[0] == "processing" and not last[3]:
                due.append(self._after(last[1] + self.timeout_ms))
        if due:
            self.handle.registerTimer(min(due))
        return iter([self._frame(out)] if out else [])

    def _until(self, key, last, at_ms: int, out: list[tuple]):
        """The last event as known at a later time: reported where it is a phase that lasts too long, forgotten where it is too old."""
        if last is not None and last[0] == "processing" and not last[3] and at_ms - last[1] > self.timeout_ms:
            out.append((key[0], last[2], "failed", f"Timed out after {self.timeout_ms // 1000}s."))
            last = (*last[:3], True)
        return None if last is None or at_ms - last[1] > self.ttl_ms else last

    def _after(self, at_ms: int) -> int:
        """The first end of a bucket that is later."""
        return (at_ms // self.bucket_ms + 1) * self.bucket_ms

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "seq", "status", "error_message"])

    def close(self) -> None:
        pass


def track_jobs_in_event_time(events: DataFrame, late: str = "1 hour", timeout_seconds: int = TASK_TIMEOUT_SECONDS,
                             ttl_seconds: int = STATE_TTL_SECONDS, bucket_seconds: int = 600) -> DataFrame:
    """State changes of all jobs, with timeouts and expiry by the events' own times.

    Rows may come ``late`` in any order. A bucket is walked once the watermark has passed its end; what is newer waits for
    further events. ``bucket_seconds`` bounds what is held for a job at once.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    stamped = stamped.select("job_id", "seq", "status", "ts", F.unix_millis("ts").alias("at_ms"))
    return stamped.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=EventTimeTracker(timeout_seconds, ttl_seconds, bucket_seconds),
        outputStructType=f"job_id {kind}, seq long, status string, error_message string", outputMode="Append", timeMode="EventTime")


# --- sinks -----------------------------------------------------------------------------------

def run_available(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None,
                  one_batch: bool = False, fold: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, str]:
    """Process what is there and stop. Returns (table path, checkpoint path).

    ``one_batch`` is for operators with wall-clock timers: those always ask for a
    further batch, so "until nothing is left" would never end.
    ``fold`` is applied to each micro-batch as a plain table.
    Each micro-batch overwrites its own ``batch`` folder, so a batch that is run again
    after a failure leaves the same rows. Both paths are under the shared work folder.
    """
    base = folder or f"{work_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table, checkpoint = f"{base}/table", f"{base}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        (fold(batch) if fold else batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    trigger = {"once": True} if one_batch else {"availableNow": True}
    (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(**trigger).start().awaitTermination())
    return table, checkpoint


def read_back(spark: SparkSession, table: str, keys: list[str] | None = None, order: tuple[str, ...] = ("batch",)) -> DataFrame:
    """Rows of a streamed table; with ``keys`` the last row per key by ``order`` (the newest batch's).

    Rows that carry their own order, such as corrections, are taken by that: an older
    one can come in a later batch.
    """
    rows = spark.read.parquet(table)
    return (latest(rows, keys, list(order)) if keys else rows).drop("batch")


def upsert_corrections(corrections: DataFrame, folder: str | None = None) -> tuple[str, str]:
    """Append each batch's newest correction per field.

    A batch touches only its own folder; ``review.apply_corrections`` takes the newest
    ``seq`` per field over all of them, so nothing is rewritten in place.
    """
    base = folder or f"{work_dir(corrections.sparkSession)}/corrections-{uuid.uuid4().hex}"
    table, checkpoint = f"{base}/table", f"{base}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch, ["document_id", "field_path"], ["seq"]).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    (corrections.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return table, checkpoint
