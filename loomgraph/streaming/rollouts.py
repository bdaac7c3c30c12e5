"""Versioned rollout streams: freshness, bounded buffers, counters, batch reports, ingest.

Sinks are folders of numbered batches in the shared directory. A batch that is
retried overwrites its own folder, so results do not change; readers take the
newest batch of a key or the newest batch as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomgraph.operators.aggregate import rollup_metrics
from loomgraph.operators.graph import upsert


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there now, batch by batch, and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def batch_folder(path: str, batch: int) -> str:
    return f"{path}/batch={batch:010d}"


def to_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes every micro-batch to its own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(batch_folder(path, batch))

    return write


def newest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest update of every key over all batches."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(*keys, "r.*")


def _batches(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [re.search(r"batch=(\d+)$", str(s.getPath().toString())) for s in fs.listStatus(root)]
    return sorted(int(m.group(1)) for m in found if m)


def newest_batch(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest numbered batch (before a given one), or None."""
    found = [b for b in _batches(spark, path) if before is None or b < before]
    return spark.read.parquet(batch_folder(path, found[-1])) if found else None


def freshness(
    stream: DataFrame, versions: DataFrame, required: int, threshold: float, sync_steps: int, delay: str = "1 day"
) -> DataFrame:
    """Per day and sample version: samples, stale samples, and whether the version is over its budget.

    `stream(ts, param_version)`, static `versions(day, current_version)`. A
    sample is stale when the current version is at least one ahead. The
    watermark lets closed days leave the state.
    """
    budget = int(required * (threshold + 1) * sync_steps)
    rows = stream.withWatermark("ts", delay).withColumn("day", F.to_date("ts")).join(versions, "day", "left")
    stale = F.col("current_version") - F.col("param_version") >= 1
    counts = rows.groupBy(F.window("ts", "1 day").alias("w"), "param_version").agg(
        F.count("*").alias("samples"), F.count_if(stale).alias("stale")
    )
    return counts.select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"),
        "param_version",
        "samples",
        "stale",
        (F.col("samples") > budget).cast("int").alias("over_budget"),
    )


def stream_counters(stream: DataFrame, key: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Produced samples per key and time window."""
    rows = stream.withWatermark("ts", delay)
    counts = rows.groupBy(F.window("ts", window).alias("w"), key).agg(F.count("*").alias("produced"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), key, "produced")


def assembly_report(df: DataFrame) -> DataFrame:
    """Partial samples, their share, the longest version span and the number of versions of a batch."""
    span = F.abs(F.col("param_version_end") - F.col("param_version_start"))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(span > 0).alias("partial_num"),
        (F.count_if(span > 0) / F.count("*")).alias("partial_ratio"),
        F.max(span).alias("max_partial_span"),
        F.count_distinct("param_version").alias("version_diversity"),
        F.avg("processing_time").alias("time_avg"),
        F.max("processing_time").alias("time_max"),
        F.min("processing_time").alias("time_min"),
        F.percentile("processing_time", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("time_percentiles"),
    )


def assembly_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        if not df.isEmpty():
            assembly_report(df).write.mode("overwrite").parquet(batch_folder(path, batch))

    return write


def version_metrics(stream: DataFrame) -> DataFrame:
    """Metric roll-up per version: `stream(param_version, metric, value, step, sample_count)`."""
    return rollup_metrics(stream, ["param_version"])


def ingest_sink(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """Upsert every batch into a table by key; rerunning finished input changes nothing.

    The checkpoint remembers finished files; a repeated batch rewrites its own
    version. A late row never replaces a row that is newer by `order`.
    """

    def write(df: DataFrame, batch: int) -> None:
        current = newest_batch(df.sparkSession, path, batch)
        if current is None:
            out = upsert(df.limit(0), df, key, order)
        else:
            newer = F.col(order) >= F.col("_old")
            seen = current.select(key, F.col(order).alias("_old"))
            fresh = df.join(seen, key, "left").filter(F.col("_old").isNull() | newer).drop("_old")
            out = upsert(current.select(*df.columns), fresh, key, order)
        out.write.mode("overwrite").parquet(batch_folder(path, batch))

    return write


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a growing dataset; readers pick new files up with `file_stream`."""
    df.write.mode("append").parquet(path)
