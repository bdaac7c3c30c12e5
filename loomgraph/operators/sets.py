"""Set operators over keyed result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import keep_first


def union_distinct(*branches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, branches).distinct()


def concatenate(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def merge_results(original: DataFrame, supplement: DataFrame, key: str, order: str) -> DataFrame:
    """Original rows first, then supplement rows with a new key; `source` tells which."""
    both = original.withColumn("source", F.lit(0)).unionByName(supplement.withColumn("source", F.lit(1)))
    fresh = keep_first(both.filter(F.col("source") == 1), [key], [F.col(order)])
    fresh = fresh.join(original.select(key), key, "left_anti").select(*both.columns)
    return both.filter(F.col("source") == 0).unionByName(fresh)


def over_retrieval(relaxed: DataFrame, gold: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: sizes of gold and relaxed sets, rows only in relaxed, inflation ratio."""
    tagged = gold.select(*keys, value, F.lit(1).alias("g"), F.lit(0).alias("r")).unionByName(
        relaxed.select(*keys, value, F.lit(0).alias("g"), F.lit(1).alias("r"))
    )
    per_value = tagged.groupBy(*keys, value).agg(F.max("g").alias("g"), F.max("r").alias("r"))
    out = per_value.groupBy(*keys).agg(
        F.sum("g").alias("gold_size"),
        F.sum("r").alias("relaxed_size"),
        F.count_if((F.col("r") == 1) & (F.col("g") == 0)).alias("over_retrieved"),
    )
    return out.withColumn("inflation", F.try_divide(F.col("relaxed_size").cast("double"), F.col("gold_size")))


def jaccard(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """|A intersect B| / |A union B| per key, 0 when both are empty."""
    tagged = left.select(*keys, value, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        right.select(*keys, value, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    per_value = tagged.groupBy(*keys, value).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = per_value.groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("b")).alias("intersection"), F.count("*").alias("union_size")
    )
    return out.withColumn(
        "jaccard",
        F.when(F.col("union_size") > 0, F.col("intersection").cast("double") / F.col("union_size")).otherwise(0.0),
    )


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Column-wise merge of two batches by row id; shared columns must agree."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    extra = [c for c in right.columns if c not in left.columns]
    other = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in shared], *extra)
    joined = left.join(other, key)
    for c in shared:
        agrees = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        value = F.when(agrees, F.col(c)).otherwise(F.raise_error(f"conflicting values for column {c}").cast(left.schema[c].dataType))
        joined = joined.withColumn(c, value)
    return joined.select(*left.columns, *extra)
