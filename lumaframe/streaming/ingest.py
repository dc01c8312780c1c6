"""New container files as a stream: each is parsed once, and its image rows are appended to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumaframe.functions import scalar

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, path: str, pattern: str = "*.lif", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, describe: Callable[[DataFrame], DataFrame], pattern: str = "*.lif") -> StreamingQuery:
    """Append ``describe(files)`` of each batch to Parquet at ``table``; a batch that runs again replaces its own folder."""

    def store(files: DataFrame, batch: int) -> None:
        describe(files).write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return new_files(spark, path, pattern).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(lines: DataFrame, line: str = "value") -> DataFrame:
    """Progress lines ("phase: ... 45.5% ...") as (percent, phase); other lines are dropped."""
    percent = F.regexp_extract(line, "([0-9]+([.][0-9]+)?) ?%", 1).try_cast("double")
    return lines.select("*", percent.alias("percent"), F.trim(F.regexp_extract(line, "^([^:%\\[]*)", 1)).alias("phase")).where("percent IS NOT NULL")


def events(lines: DataFrame, line: str = "value", order: str = "n") -> DataFrame:
    """(type, payload) of a job's output lines: "progress" for lines with a percentage, "result" for a JSON array,
    "error" for lines that say so, "end" for the last one; other lines are "log". Works on streams but for "end"."""
    text = F.trim(F.col(line))
    kind = F.when(text.rlike("[0-9] ?%"), "progress").when(text.startswith("[") & text.endswith("]"), "result").when(F.lower(text).rlike("^(error|traceback|exception)"), "error").otherwise("log")
    out = lines.select("*", kind.alias("type"), text.alias("payload"))
    if lines.isStreaming:
        return out
    closing = lines.agg((F.max(order) + 1).alias(order)).where(F.col(order).isNotNull()).select(order, F.lit("end").alias("type"), F.lit("").alias("payload"))
    return out.select(order, "type", "payload").unionByName(closing)


def timed(jobs: DataFrame, began: str = "began", ended: str = "ended") -> DataFrame:
    """Jobs with when they began (as it is shown) and how long they took: ``at``, ``took``; a job that runs has not taken any time yet."""
    seconds = (F.unix_micros(F.col(ended).cast("timestamp")) - F.unix_micros(F.col(began).cast("timestamp"))) / 1e6
    return jobs.withColumns({"at": scalar.pretty_time(F.col(began).cast("string")), "took": F.when(seconds >= 0, scalar.elapsed_text(seconds))})


def chunk_progress(chunks: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """By group: chunks in all, chunks written, bytes written, and per cent; ``done`` has a row (with bytes) for each chunk written."""
    total = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    got = done.groupBy(*by).agg(F.count(F.lit(1)).alias("written"), F.sum("bytes").alias("bytes"))
    out = total.join(got, by, "left").fillna({"written": 0, "bytes": 0})
    return out.withColumn("percent", F.round(100 * F.col("written") / F.col("total"), 1))


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs that were started under a tag (``SparkContext.addJobTag``), for a request that nobody waits for any more."""
    spark.sparkContext.cancelJobsWithTag(tag)
