"""Mixing sources to target weights [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import word_count


def source_targets(totals: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """`totals(_source, source_size)` with the `target` of each source.

    Sources in code point order, null last, weigh `weights` in turn and share
    the sum of all sizes. A target stops at `max_epochs` times its source and
    the excess is shared again by weight: in order of size per weight, the
    sources that stop are a prefix, found by running sums. Windows here run
    over one row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = totals.withColumn("_weight", weight.cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.col("source_size") * max_epochs
    # what is left to share, and among which weight, if all sources before this one stop
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(capped).over(before), F.lit(0))
    among = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    staged = weighed.select("*", left.alias("_left"), among.alias("_among"))
    # the first source that does not stop fixes the share of one unit of weight
    free = F.col("_left") * F.col("_weight") <= F.col("_among") * F.col("source_size") * max_epochs
    level = F.min(F.when(free, F.struct(F.col("source_size") / F.col("_weight"), F.col("_source").isNull(), "_source", "_left", "_among")))
    staged = staged.withColumn("_level", level.over(everything))
    share = (F.col("_level._left") * F.col("_weight")).cast("double") / F.col("_level._among").cast("double")
    target = F.least(share, (F.col("source_size") * max_epochs).cast("double"))
    return staged.select("_source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: list[int] = (1, 2, 3),
    max_epochs: int = 3,
    size: Column | None = None,
    rows_per_bucket: int = 20_000,
) -> DataFrame:
    """`docs` with `size`, `source_size`, `target` and `taken` (words the mix takes of the document).

    Each source takes its target in whole epochs plus the part of one more,
    which is cut in the order of a hash-random key at the exact budget; the
    document at the cut gives the words that are still missing. A null text
    has size 0 and a null source is a source of its own, last in order. Rows
    that repeat tie on the key and are told apart by size alone, so a rerun
    gives the same rows. Columns named like the new ones are replaced; an empty
    table gives an empty table; when all sizes are 0 nothing is taken.

    The key space is cut into equal ranges per source, `rows_per_bucket` rows
    each at most on average, whatever the source's share: keys are md5, so
    ranges are even. The prefix sum of a row is the sum of the earlier ranges
    of its source plus the sum inside its own range.
    """
    size = word_count(F.col("text")) if size is None else size
    docs = docs.withColumn("size", size)
    docs = docs.drop("source_size", "target", "taken")
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    head = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    keyed = docs.withColumn("_key", key).withColumn("_bucket", F.shiftright(head * buckets, 32))
    keyed = keyed.withColumn("_sk", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    parts = keyed.groupBy("_sk", "_bucket").agg(F.sum("size").alias("_sum"), F.first("source").alias("_source"))
    totals = parts.groupBy("_sk").agg(F.sum("_sum").alias("source_size"), F.first("_source").alias("_source"))
    targets = source_targets(totals.select("_source", "source_size"), list(weights), max_epochs)
    targets = targets.withColumn("_sk", F.coalesce(F.concat(F.lit("="), "_source"), F.lit(""))).drop("_source")
    earlier = Window.partitionBy("_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_sk", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    plan = starts.join(targets, "_sk")
    inside = Window.partitionBy("_sk", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["_sk", "_bucket"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col("_start") - F.col("_in")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return keyed.withColumn("taken", taken.cast("long")).drop("_key", "_bucket", "_sk", "_start", "_in")
