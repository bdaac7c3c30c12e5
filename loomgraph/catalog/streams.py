"""Streaming queries over the events, cut into files so that several micro-batches run."""

from pyspark.sql import functions as F

from loomgraph.catalog.aggregation import _METRICS, _metric_rows
from loomgraph.catalog.base import query, table
from loomgraph.runtime import scratch_path
from loomgraph.streaming import queues as Q
from loomgraph.streaming import rollouts as ST


def _files(spark, path, build, name, parts=4):
    """The rows of `build` as a folder of `parts` files, and their schema."""
    rows = build(spark, path)
    folder = scratch_path(spark, name)
    rows.repartitionByRange(parts, rows.columns[0]).write.parquet(folder)
    return folder, rows.schema


def _samples(spark, path):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, path, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("kind"),
        k.alias("param_version"),
        (k - k % 3).alias("param_version_start"),
        k.alias("param_version_end"),
        F.col("value").alias("processing_time"),
    )


def _stream(spark, path, name):
    folder, schema = _files(spark, path, _samples, name)
    return ST.file_stream(spark, folder, schema, 1), scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-cp")


_S = {
    "s": """SELECT event_id, ts, event_type AS kind, k AS param_version, k - k % 3 AS v0, value AS processing_time, strftime(ts, '%Y-%m-%d') AS day FROM
        (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
}


@query(
    "st1_freshness",
    """SELECT s.day, param_version, count(*) AS samples, count(*) FILTER (c - param_version >= 1) AS stale, CASE WHEN count(*) > 6 THEN 1 ELSE 0 END AS over_budget
       FROM s JOIN (SELECT day, CAST(floor(avg(param_version)) AS BIGINT) AS c FROM s GROUP BY 1) v ON v.day = s.day GROUP BY 1, 2""",
    _S,
)
def freshness(spark, path):
    stream, out, cp = _stream(spark, path, "st1")
    rows = _samples(spark, path).withColumn("day", F.to_date("ts"))
    versions = rows.groupBy("day").agg(F.floor(F.avg("param_version")).alias("current_version"))
    ST.run_available(ST.freshness(stream, versions, 2, 0.5, 2, "40 days"), cp, ST.to_batches(out), "update")
    return ST.newest_per_key(spark, out, ["day", "param_version"])


_SAMPLE, _OLDEST_FIRST = ["event_id", "ts", "param_version"], ["ts", "event_id"]


def _queues(spark, path, name, requests=0):
    """Samples through queues of 50 a kind; then, after a restart, `requests` samples asked of each kind."""
    put = lambda s, p: _samples(s, p).select(*_SAMPLE, "kind", F.lit(None).cast("bigint").alias("take"))
    folder, schema = _files(spark, path, put, name)
    out, cp = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-cp")

    def run():
        with Q.keyed_state(spark):
            stream = ST.file_stream(spark, folder, schema, 1)
            ST.run_available(Q.bounded_queues(stream, "kind", _SAMPLE, _OLDEST_FIRST, 50), cp, ST.to_batches(out), "update")

    run()
    if requests:
        kinds = _samples(spark, path).select("kind").distinct().withColumn("take", F.lit(requests).cast("bigint"))
        empty = spark.createDataFrame([], schema)
        empty.unionByName(kinds, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(folder)
        run()
    return out, cp


@query(
    "st2_bounded_buffer",
    "SELECT event_id, kind, param_version FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS rn FROM s) WHERE rn <= 50",
    _S,
)
def bounded_buffer(spark, path):
    _, cp = _queues(spark, path, "st2")
    return Q.queue_contents(spark, cp, "kind").select("event_id", "kind", "param_version")


@query(
    "st2_consume",
    """SELECT event_id, kind, param_version FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS rn,
         least(50, count(*) OVER (PARTITION BY kind)) AS held FROM s) WHERE rn <= held AND rn > held - 20""",
    _S,
)
def consume(spark, path):
    """The 20 oldest of each queue, asked for after a restart."""
    out, _ = _queues(spark, path, "st2c", 20)
    return spark.read.parquet(out).filter("event = 'taken'").select("event_id", "kind", "param_version")


@query(
    "st3_queue_statistics",
    """SELECT kind, count(*) AS produced, least(count(*), 20) AS consumed, count(*) - least(count(*), 50) AS dropped,
         greatest(least(count(*), 50) - 20, 0) AS queue_size FROM s GROUP BY 1""",
    _S,
)
def queue_statistics(spark, path):
    out, _ = _queues(spark, path, "st3", 20)
    states = ST.newest_per_key(spark, out, ["kind", "event"]).filter("event = 'state'")
    return states.select("kind", "produced", "consumed", "dropped", "queue_size")


@query("st3_window_counters", "SELECT day || ' 00:00:00' AS start, kind, count(*) AS produced FROM s GROUP BY 1, 2", _S)
def window_counters(spark, path):
    stream, out, cp = _stream(spark, path, "st3w")
    ST.run_available(ST.stream_counters(stream, "kind", delay="40 days"), cp, ST.to_batches(out), "update")
    return ST.newest_per_key(spark, out, ["start", "kind"])


@query(
    "st4_assembly_report",
    """SELECT count(*) AS rows, count(*) FILTER (param_version - v0 > 0) AS partial_num, max(param_version - v0) AS max_partial_span, round(max(processing_time), 6) AS time_max FROM s""",
    _S,
)
def assembly(spark, path):
    stream, out, cp = _stream(spark, path, "st4")
    ST.run_available(stream, cp, ST.assembly_sink(out))
    reports = spark.read.parquet(out)
    return reports.agg(
        F.sum("rows").alias("rows"), F.sum("partial_num").alias("partial_num"), F.max("max_partial_span").alias("max_partial_span"), F.max("time_max").alias("time_max")
    )


@query(
    "st5_version_metrics",
    """SELECT sample_count AS param_version, metric, CASE WHEN contains(metric, 'timing_s/') THEN 'time_sum' WHEN contains(metric, 'mean') THEN 'avg'
         WHEN contains(metric, 'max') THEN 'max' WHEN contains(metric, 'min') THEN 'min' WHEN contains(metric, 'total') THEN 'sum' ELSE 'avg' END AS rule,
       round(CASE WHEN contains(metric, 'timing_s/') THEN sum(value) WHEN contains(metric, 'mean') THEN avg(value)
         WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) WHEN contains(metric, 'total') THEN sum(value)
         ELSE avg(value) END + 1e-9::DOUBLE, 6) AS value FROM m GROUP BY 1, metric""",
    {"m": _METRICS},
)
def version_metrics(spark, path):
    def build(spark, path):
        return _metric_rows(spark, path).select("step", "metric", "value", "sample_count", F.col("sample_count").alias("param_version"))

    folder, schema = _files(spark, path, build, "st5")
    out = scratch_path(spark, "st5-out")
    ST.run_available(ST.version_metrics(ST.file_stream(spark, folder, schema, 1)), scratch_path(spark, "st5-cp"), ST.to_batches(out), "update")
    rows = ST.newest_per_key(spark, out, ["param_version", "metric"])
    return rows.withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query(
    "st6_resumable_ingest",
    "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1",
)
def resumable_ingest(spark, path):
    def build(spark, path):
        return table(spark, path, "events").select("event_id", "user_id", "event_type")

    folder, schema = _files(spark, path, build, "st6")
    out, cp = scratch_path(spark, "st6-out"), scratch_path(spark, "st6-cp")
    # the second run finds every file finished and changes nothing
    for _ in range(2):
        ST.run_available(ST.file_stream(spark, folder, schema, 1), cp, ST.ingest_sink(out, "user_id", "event_id"))
    return ST.newest_batch(spark, out)


@query("st7_dynamic_dataset", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def dynamic_dataset(spark, path):
    ev = table(spark, path, "events").select("event_id", "event_type")
    middle = ev.agg(F.avg("event_id").alias("m")).first()["m"]
    folder, out, cp = (scratch_path(spark, f"st7-{x}") for x in ("in", "out", "cp"))
    # two appends; the reader picks each up once
    for part in (F.col("event_id") < middle, F.col("event_id") >= middle):
        ST.append_rows(ev.filter(part), folder)
        ST.run_available(ST.file_stream(spark, folder, ev.schema), cp, ST.to_batches(out))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("rows"))


