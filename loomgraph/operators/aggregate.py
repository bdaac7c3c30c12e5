"""Counting and summary operators over a graph binding or plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.binding import GraphBinding
from loomgraph.functions.presets import OTHER_REGION, PARTY_REGIONS
from loomgraph.operators.filters import filtered_items, items_per, year_of
from loomgraph.runtime import with_scalars

# group_by name -> (relation group, key column, carried columns)
GROUPINGS = {
    "domain": ("topic", "topic_name", []),
    "org": ("party", "party_name", ["party_type"]),
    "org_type": ("party", "party_type", []),
    "country": ("country", "country_name", []),
    "legal_status": ("status", "status_name", []),
    "ipc_section": ("code", "section", []),
}


def region_of(
    column: str, rules: Sequence[tuple[str, str]] = tuple(PARTY_REGIONS), other: str = OTHER_REGION
) -> Column:
    """Ordered CONTAINS cascade: the first rule that matches names the region."""
    out = F.lit(other)
    for needle, region in reversed(list(rules)):
        out = F.when(F.col(column).contains(needle), region).otherwise(out)
    return out


def count_items(graph: GraphBinding, filters: Mapping[str, object] | None = None) -> DataFrame:
    """Number of items under the filters. Filters are semi-joins, so a plain count is distinct."""
    return filtered_items(graph, filters).agg(F.count("*").alias("count"))


def count_by(
    graph: GraphBinding,
    group_by: str,
    filters: Mapping[str, object] | None = None,
    region_rules: Sequence[tuple[str, str]] = tuple(PARTY_REGIONS),
    other: str = OTHER_REGION,
    org_limit: int | None = None,
    years: tuple[str, str] = ("2000", "2030"),
) -> DataFrame:
    """Distinct items per group; an item with two neighbours counts under both.

    `org_limit` keeps the largest parties only. Years outside `years` are left
    out of the count by year, as dates beyond them are input errors.
    """
    if group_by == "year":
        items = filtered_items(graph, filters).filter(F.col("item_date").isNotNull())
        items = items.withColumn("year", year_of()).filter(F.col("year").between(*years))
        return items.groupBy("year").agg(F.count("*").alias("count"))
    if group_by == "region":
        rows = filtered_items(graph, filters, keep="party", distinct=False)
        rows = rows.withColumn("region", region_of("party_name", region_rules, other))
        return items_per(rows, ["region"], "count")
    if group_by not in GROUPINGS:
        raise ValueError(f"unsupported grouping: {group_by}")
    group, key, carried = GROUPINGS[group_by]
    rows = filtered_items(graph, filters, keep=group, distinct=False)
    out = items_per(rows.withColumn(group_by, F.col(key)), [group_by, *carried], "count")
    if group_by == "org" and org_limit:
        out = out.orderBy(F.desc("count"), group_by).limit(org_limit)
    return out


def count_neighbours(graph: GraphBinding, target: str, filters: Mapping[str, object] | None = None) -> DataFrame:
    """Distinct parties or topics of the filtered items."""
    group, key = {"orgs": ("party", "party_id"), "domains": ("topic", "topic_name")}[target]
    return filtered_items(graph, filters, keep=group, distinct=False).agg(F.countDistinct(key).alias("count"))


def flag_ratio(graph: GraphBinding, counter: str, filters: Mapping[str, object] | None = None) -> DataFrame:
    """Items with the activity, all items, and the percentage rounded to 2 dp."""
    items = filtered_items(graph, filters, counters=True)
    agg = items.agg(F.count_if(F.col(counter) > 0).alias("with_activity"), F.count("*").alias("total"))
    return agg.withColumn("ratio", F.round(F.col("with_activity") * 100.0 / F.col("total"), 2))


def counter_summary(graph: GraphBinding, counter: str, filters: Mapping[str, object] | None = None) -> DataFrame:
    items = filtered_items(graph, filters, counters=True)
    return items.agg(F.round(F.avg(counter), 2).alias("avg_value"), F.max(counter).alias("max_value"))


def frequency(
    rel: DataFrame, keys: Sequence[str], value: str | None = None, limit: int | None = None, minimum: int = 0
) -> DataFrame:
    """Frequency table of a relation: rows (or distinct `value`) per key, largest first."""
    n = F.countDistinct(value) if value else F.count("*")
    out = rel.groupBy(*keys).agg(n.alias("n")).filter(F.col("n") >= minimum)
    return out.orderBy(F.desc("n"), *keys).limit(limit) if limit else out


def graph_statistics(
    graph: GraphBinding, top_parties: int | None = None, top_countries: int | None = None
) -> dict[str, DataFrame]:
    """The statistics bundle. Counts are plain, as the statistics of the graph are; both tops are unlimited by default."""
    topic_counts = graph.relation("topic", distinct=True).groupBy("topic_name").agg(F.count("*").alias("item_count"))
    dated = graph.items().filter(F.col("item_date").isNotNull() & (F.col("item_date") != ""))
    return {
        "topics": graph.topics()
        .join(topic_counts, "topic_name", "left")
        .select("topic_name", "topic_level", "topic_parent", F.coalesce("item_count", F.lit(0)).alias("item_count")),
        "top_parties": frequency(graph.relation("party", distinct=True), ["party_name", "party_type"], limit=top_parties),
        "date_range": dated.agg(F.min("item_date").alias("earliest"), F.max("item_date").alias("latest")),
        "total": graph.items().agg(F.count("*").alias("total")),
        "by_year": count_by(graph, "year"),
        "by_status": frequency(graph.relation("status", distinct=True), ["status_name"]),
        "by_country": frequency(graph.relation("country", distinct=True), ["country_name"], limit=top_countries),
    }


def label_counts(graph: GraphBinding) -> DataFrame:
    """Nodes per label, in one table."""
    parts = [
        ("Item", graph.items(), "item_id"),
        ("Organization", graph.parties(), "party_id"),
        ("Topic", graph.topics(), "topic_name"),
        ("Code", graph.relation("code"), "code"),
        ("Country", graph.relation("country"), "country_name"),
        ("Status", graph.relation("status"), "status_name"),
        ("Family", graph.relation("family"), "family_id"),
    ]
    frames = [df.agg(F.countDistinct(key).alias("n")).select(F.lit(label).alias("label"), "n") for label, df, key in parts]
    return reduce(DataFrame.unionByName, frames)


def family_sizes(graph: GraphBinding) -> DataFrame:
    """Members per family, then the extremes over the families."""
    sizes = graph.relation("family", distinct=True).groupBy("family_id").agg(F.count("*").alias("members"))
    return sizes.agg(
        F.min("members").alias("min_members"),
        F.max("members").alias("max_members"),
        F.round(F.avg("members"), 6).alias("avg_members"),
        F.count("*").alias("total_families"),
    )


def edge_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count("*").alias("count"))


def load_statistics(records: DataFrame, scalars: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Histograms of scalar fields and distinct counts of list fields as (field, value, n)."""
    frames = [
        records.filter(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(
            F.lit(c).alias("field"), "value", "n"
        )
        for c in scalars
    ]
    frames += [
        records.select(F.explode(c).alias("v")).agg(F.countDistinct("v").alias("n")).select(
            F.lit(c).alias("field"), F.lit("(distinct)").alias("value"), "n"
        )
        for c in lists
    ]
    frames.append(records.agg(F.count("*").alias("n")).select(F.lit("*").alias("field"), F.lit("(rows)").alias("value"), "n"))
    return reduce(DataFrame.unionByName, frames)


def group_entities(mapping: DataFrame) -> DataFrame:
    """Per standard name: sorted aliases and the first non-null place by original name."""
    alias = F.when(F.col("original_name") != F.col("standard_name"), F.col("original_name"))
    place = F.when(F.col("place").isNotNull(), F.struct("original_name", "place"))
    return mapping.groupBy("standard_name").agg(
        F.array_join(F.array_sort(F.collect_set(alias)), "; ").alias("aliases"),
        F.min(place).getField("place").alias("place"),
    )


def stratified_accuracy(rows: DataFrame, correct: str, strata: Sequence[str]) -> DataFrame:
    """Total, correct and rate for every stratum column, in one pass over grouping sets."""
    cols = [F.col(s) for s in strata]
    sets = [[c] for c in cols]
    grouped = rows.groupingSets(sets, *cols).agg(
        F.count("*").alias("total"),
        F.sum(F.col(correct).cast("int")).alias("correct"),
        F.grouping_id().alias("gid"),
    )
    n = len(strata)
    # bit i of the grouping id (from the left) is 0 for the column the row is grouped by
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, s in enumerate(strata):
        is_set = F.col("gid") == ((1 << n) - 1 - (1 << (n - 1 - i)))
        which = F.when(is_set, s).otherwise(which)
        value = F.when(is_set, F.col(s).cast("string")).otherwise(value)
    rate = F.round(F.col("correct") * 100.0 / F.col("total"), 6)
    return grouped.select(which.alias("stratum"), value.alias("value"), "total", "correct", rate.alias("rate"))


def size_buckets(results: DataFrame) -> DataFrame:
    """Result-size buckets and failures per family; input `family, valid, result_count`."""
    n = F.col("result_count")
    ok = F.col("valid")
    return results.groupBy("family").agg(
        F.count("*").alias("total"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (n == 0)).alias("empty"),
        F.count_if(ok & n.between(1, 5)).alias("small"),
        F.count_if(ok & n.between(6, 20)).alias("medium"),
        F.count_if(ok & (n > 20)).alias("large"),
    )


# fixed values: metric names with an explicit roll-up rule
ROLLUP_RULES = {
    "time_sum": ["perf/time_per_step"],
    "min": ["timing_s/agent_loop/tool_calls/min"],
    "avg": ["timing_s/agent_loop/tool_calls/mean"],
    "max": ["timing_s/agent_loop/tool_calls/max"],
    "last": [
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ],
}
# fixed values: keyword rules, tried in this order after the explicit names
ROLLUP_KEYWORDS = [
    ("time_sum", ["timing_s/"]),
    ("avg", ["mean", "avg", "average"]),
    ("max", ["max", "maximum"]),
    ("min", ["min", "minimum"]),
    ("sum", ["sum", "total"]),
    ("weighted_avg", ["weighted_avg"]),
]


def rollup_kind(metric: str = "metric") -> Column:
    """Roll-up rule of a metric name, as a column."""
    name, lower = F.col(metric), F.lower(F.col(metric))
    out = F.lit("avg")
    for kind, words in reversed(ROLLUP_KEYWORDS):
        hit = reduce(lambda a, b: a | b, [lower.contains(w) for w in words])
        out = F.when(hit, kind).otherwise(out)
    for kind, names in ROLLUP_RULES.items():
        out = F.when(name.isin(names), kind).otherwise(out)
    return out


def rollup_metrics(steps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`metric, value, step, sample_count` -> one value per metric chosen by its name."""
    kind = rollup_kind()
    agg = steps.groupBy(*keys, "metric").agg(
        F.max_by("value", "step").alias("v_last"),
        F.sum("value").alias("v_sum"),
        F.avg("value").alias("v_avg"),
        F.max("value").alias("v_max"),
        F.min("value").alias("v_min"),
        F.sum(F.col("value") * F.col("sample_count")).alias("v_wsum"),
        F.sum("sample_count").alias("v_n"),
    )
    weighted = F.when(F.col("v_n") == 0, F.col("v_avg")).otherwise(F.try_divide("v_wsum", "v_n"))
    picked = (
        F.when(kind == "last", F.col("v_last"))
        .when(kind == "weighted_avg", weighted)
        .when(kind.isin("sum", "time_sum"), F.col("v_sum"))
        .when(kind == "max", F.col("v_max"))
        .when(kind == "min", F.col("v_min"))
        .otherwise(F.col("v_avg"))
    )
    return agg.select(*keys, "metric", kind.alias("rule"), picked.alias("value"))


def reduce_metrics(rows: DataFrame) -> DataFrame:
    """Simple form: a name with `max` takes the maximum, `min` the minimum, else the mean."""
    agg = rows.groupBy("metric").agg(
        F.max("value").alias("mx"), F.min("value").alias("mn"), F.avg("value").alias("av")
    )
    name = F.col("metric")
    pick = F.when(name.contains("max"), F.col("mx")).when(name.contains("min"), F.col("mn")).otherwise(F.col("av"))
    return agg.select("metric", pick.alias("value"))


def mean_score_per_source(rows: DataFrame, source: str, uid: str, score: str) -> DataFrame:
    """Mean over prompts of the mean over a prompt's responses."""
    per = rows.groupBy(source, uid).agg(F.avg(score).alias("m"))
    return per.groupBy(source).agg(F.avg("m").alias("test_score"))


def sum_metric_by(
    graph: GraphBinding, group: str, key: str, counter: str, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """Counter summed over the joined rows, so an item repeats per matching pattern."""
    rows = filtered_items(graph, filters, keep=group, counters=True, bag=True)
    value = F.coalesce(F.col(counter), F.lit(0)) * F.col("mult")
    return rows.groupBy(F.col(key).alias("name")).agg(F.sum(value).alias("value"))


def share_of_total(df: DataFrame, count_col: str) -> DataFrame:
    """Percentage of each row's count in the total, 2 dp."""
    total = df.agg(F.sum(count_col).alias("t"))
    return with_scalars(df, total).withColumn("share", F.round(F.col(count_col) * 100.0 / F.col("g.t"), 2)).drop("g")


