"""Jobs as state on a stream: what a job prints becomes events, the newest job of an image wins, and each job ends once."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumaframe.streaming import ingest

EVENTS = "uuid string, job_id bigint, n bigint, type string, payload string"
#: The store that keeps such states.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobState(StatefulProcessor):
    """Of each image its newest job, the number of that job's last line, and whether it has ended.

    Rows of older jobs are dropped, also those that come late. A job ends with its result or error, when a newer
    job takes its place, or after ``idle`` milliseconds without a line; what it prints after that is dropped.
    States are forgotten after ``keep`` milliseconds.
    """

    def __init__(self, idle: int, keep: int) -> None:
        self.idle, self.keep = idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "job_id bigint, last bigint, ended boolean", self.keep)

    def _wait(self, now: int, ended: bool) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not ended:
            self.handle.registerTimer(now + self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, last, ended = self.state.get() if self.state.exists() else (None, 0, True)
        out = []
        for r in pd.concat(list(rows)).sort_values(["job_id", "n"]).itertuples():
            if job is not None and (r.job_id < job or (r.job_id == job and (ended or r.n <= last))):
                continue
            if r.job_id != job:
                if not ended:
                    out.append((key[0], job, last + 1, "end", "superseded"))
                job, ended = int(r.job_id), False
            last = int(r.n)
            out.append((key[0], job, last, r.type, r.payload))
            if r.type in ("result", "error"):
                ended = True
                last += 1
                out.append((key[0], job, last, "end", ""))
        if job is not None:
            self.state.update((job, last, ended))
            self._wait(timerValues.getCurrentProcessingTimeInMs(), ended)
        if out:
            yield pd.DataFrame(out, columns=["uuid", "job_id", "n", "type", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        job, last, ended = self.state.get()
        if not ended:
            self.state.update((job, last + 1, True))
            yield pd.DataFrame([(key[0], job, last + 1, "end", f"no line for {self.idle} ms")], columns=["uuid", "job_id", "n", "type", "payload"])

    def close(self) -> None:
        pass


def events(lines: DataFrame, idle: int = 600_000, keep: int = 86_400_000) -> DataFrame:
    """Events (uuid, job_id, n, type, payload) of a stream of lines (uuid, job_id, n, value); see ``JobState``.

    ``idle`` and ``keep`` are milliseconds. Lines without a uuid, job_id or n are dropped.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = ingest.events(lines.where("uuid IS NOT NULL AND job_id IS NOT NULL AND n IS NOT NULL")).select("uuid", F.col("job_id").cast("bigint").alias("job_id"), F.col("n").cast("bigint").alias("n"), "type", "payload")
    return known.groupBy("uuid").transformWithStateInPandas(JobState(idle, keep), EVENTS, "Append", "ProcessingTime")


def tag_of(image: str, job_id: int) -> str:
    return f"{image}/{job_id}".replace(",", "_")


class Jobs:
    """Work of images, one job at a time for each: a newer job of an image, or the event that ended one, stops what runs for it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._running: dict[str, int] = {}
        self._lock = threading.Lock()

    def start(self, image: str, job_id: int, work: Callable[[], object]) -> threading.Thread:
        """Run ``work`` in a thread of its own under the job's tag; an older job of the image is stopped."""
        with self._lock:
            older = self._running.get(image)
            self._running[image] = job_id
        if older is not None and older < job_id:
            ingest.cancel(self.spark, tag_of(image, older))

        def run() -> None:
            self.spark.sparkContext.addJobTag(tag_of(image, job_id))
            self.spark.sparkContext.setLocalProperty("spark.job.interruptOnCancel", "true")  # tasks that run are ended too
            try:
                work()
            except (PySparkException, Py4JJavaError):
                if self._running.get(image) == job_id:  # else it was stopped
                    raise
            finally:
                with self._lock:
                    if self._running.get(image) == job_id:
                        del self._running[image]

        thread = threading.Thread(target=run, name=f"job-{image}-{job_id}-{uuid.uuid4().hex[:6]}", daemon=True)
        thread.start()
        return thread

    def stop(self, image: str, job_id: int) -> None:
        with self._lock:
            if self._running.get(image) == job_id:
                del self._running[image]
        ingest.cancel(self.spark, tag_of(image, job_id))

    def follow(self, found: DataFrame, table: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
        """Append a stream of events to a table, and stop the jobs that were superseded or fell silent.

        The query runs until it is stopped, as timers have to be looked at whether or not lines come.
        """

        def take(batch: DataFrame, number: int) -> None:
            own = f"{table}/batch={number}"
            batch.write.mode("overwrite").parquet(own)
            for r in self.spark.read.schema(EVENTS).parquet(own).where("type = 'end' AND payload <> ''").select("uuid", "job_id").toLocalIterator():
                self.stop(r.uuid, r.job_id)

        return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
