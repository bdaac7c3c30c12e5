"""Session set-up and the few distribution helpers every operator shares.

The helpers exist so that no operator has to pull a whole group into one task:
group statistics are two-phase aggregates joined back (a hot group is split by
AQE's skew join), "first row" and "top k" are partial aggregates, and global
positions come from a range shuffle instead of an unpartitioned window.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "loomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in `spark.checkpoint.dir`.

    A private temporary folder is made only on a local master, where driver and
    executors are one process; elsewhere a missing setting is an error, because
    rows written to one machine's disk would be lost to the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = {"users": 0, "before": "false", "lock": threading.Lock()}


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage."""
    with _cleaning["lock"]:
        if not _cleaning["users"]:
            _cleaning["before"] = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _cleaning["users"] += 1
    try:
        yield
    finally:
        with _cleaning["lock"]:
            _cleaning["users"] -= 1
            if not _cleaning["users"]:
                spark.conf.set(_CLEANUP, _cleaning["before"])


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Attach a costly column that later steps use several times, worked out once a row.

    Plain columns are merged into each of their uses; a one-element explode keeps them apart.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_scalars(df: DataFrame, one_row: DataFrame, name: str = "g") -> DataFrame:
    """Attach a one-row aggregate as the struct `name` through a scalar subquery."""
    return df.withColumn(name, one_row.select(F.struct("*")).scalar())


def with_group_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach group aggregates to every row without a window.

    The aggregate is map-side combined; the join has one row per key on its
    right side, so a key holding a third of the rows is split by AQE.
    """
    stats = df.groupBy(*keys).agg(*aggs)
    return df.join(stats, keys)


# bytes of input files for each task of a shuffle whose rows must all be held, some 450,000 short rows
TASK_BYTES = 8 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` into tasks whose number grows with its input files, so that the share of a task does not.

    Joins and aggregates on the keys, or on more columns than these, stay in those tasks.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = df.inputFiles()
    if not files:
        return df.repartition(least, *keys)
    # only the listing is read
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return df.repartition(max(least, -(-size // TASK_BYTES)), *keys)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the least under `order`; a partial aggregate, not a window."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(best).select("r.*")


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32, rank: str = "rank"
) -> DataFrame:
    """Exact top k per group in two rounds: inside salted sub-groups, then over survivors."""
    cols = df.columns
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    final = Window.partitionBy(*keys).orderBy(*order)
    return first.filter(F.col("_r") <= k).select(*cols).withColumn(rank, F.row_number().over(final)).filter(
        F.col(rank) <= k
    )


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based position in the total order `order`.

    Range shuffle, sort inside partitions, then add the number of rows in the
    earlier partitions. The sorted rows are checkpointed first so that the
    counts and the positions describe the same partitioning even after a retry.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright("_mid", 33)
    tagged = tagged.withColumn("_pid", pid).withColumn("_off", F.col("_mid").bitwiseAND((1 << 33) - 1))
    sizes = tagged.groupBy("_pid").agg(F.count("*").alias("_n"))
    # one row per partition: bounded by the partition count, not by the data
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_pid", before.alias("_start"))
    return tagged.join(starts, "_pid").withColumn(name, F.col("_start") + F.col("_off")).drop(
        "_mid", "_pid", "_off", "_start"
    )


# most rows that a sorted limit may gather in one place
SORTED_LIMIT = 100_000


def first_rows(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """Rows `offset` to `offset + n` of a total order.

    A small page is a top-k; a large one is cut by global position, so its
    rows never pass through one task or the driver. Both come in order.
    """
    if offset + n <= SORTED_LIMIT:
        return df.orderBy(*order).offset(offset).limit(n)
    placed = with_global_index(df, order, "_at")
    return placed.filter((F.col("_at") >= offset) & (F.col("_at") < offset + n)).orderBy("_at").drop("_at")


def with_group_index(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """0-based position inside each group, without a window over the group.

    Rows are put in one global order (group, order); a group's rows are then
    consecutive, so the position is the global index minus the group's least.
    """
    indexed = with_global_index(df, [F.col(k) for k in keys] + order, "_g")
    starts = indexed.groupBy(*keys).agg(F.min("_g").alias("_first"))
    return indexed.join(starts, keys).withColumn(name, F.col("_g") - F.col("_first")).drop("_g", "_first")


def with_group_running_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, partitions: int | None = None
) -> DataFrame:
    """Sum of `value` over the earlier rows of the same group, for groups of any size.

    Sums run inside range partitions of the global (group, order) order and are
    shifted by the sum of the earlier partitions; a group's own sum is the
    difference to its first row. Rows meet that difference by group and range partition, so a group of any
    size stays in as many tasks as it has partitions; without `keys` there is none. `value` should be integral so that
    it is exact.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = [F.col(k) for k in keys] + order
    ranged = df.withColumn("_val", value).repartitionByRange(n, *full).sortWithinPartitions(*full)
    tagged = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33))
    inside = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    tagged = tagged.withColumn("_run", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
    sums = tagged.groupBy("_pid").agg(F.sum("_val").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tagged = tagged.join(sums.select("_pid", before.alias("_start")), "_pid").withColumn("_run", F.col("_run") + F.col("_start"))
    if not keys:
        return tagged.withColumn(name, F.col("_run")).drop("_val", "_mid", "_pid", "_run", "_start")
    # one row per group and range partition that holds it
    first = tagged.groupBy(*keys, "_pid").agg(F.min_by("_run", "_mid").alias("_first"))
    first = first.withColumn("_first", F.min_by("_first", "_pid").over(Window.partitionBy(*keys)))
    out = tagged.join(first, [*keys, "_pid"]).withColumn(name, F.col("_run") - F.col("_first"))
    return out.drop("_val", "_mid", "_pid", "_run", "_start", "_first")


def with_hash_rank(
    df: DataFrame, keys: list[str], digest: Column, tie: list[Column], rank: str = "rank", size: str = "group_size"
) -> DataFrame:
    """1-based rank inside each group in md5 order, and the group size.

    Rows are ranked inside (group, first three hex digits) cells, a 4096th of a
    group each, and shifted by the size of the earlier cells of the group.
    """
    work = df.withColumn("_h", digest).withColumn("_cell", F.substring("_h", 1, 3))
    cells = work.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = F.sum("_n").over(by_key.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(
        *keys, "_cell", F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(by_key).alias(size)
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_h", *tie))
    return (
        work.withColumn("_in", inside)
        .join(cells, [*keys, "_cell"])
        .withColumn(rank, F.col("_start") + F.col("_in"))
        .drop("_h", "_cell", "_in", "_start")
    )


def seeded_digest(seed: int | str, *cols: Column | str) -> Column:
    """md5 of `seed:col:col...`, the deterministic source of randomness."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).cast("binary"))
