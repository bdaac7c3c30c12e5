"""Rankings, trends and paged lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.binding import GraphBinding
from loomgraph.functions.presets import OTHER_REGION, PARTY_REGIONS
from loomgraph.operators.aggregate import region_of
from loomgraph.operators.filters import filtered_items, items_per, year_of
from loomgraph.runtime import first_rows, with_group_index

# rank_by -> (relation group, key column, carried columns)
RANK_DIMENSIONS = {
    "org": ("party", "party_name", ["party_type"]),
    "domain": ("topic", "topic_name", ["topic_level"]),
    "country": ("country", "country_name", []),
    "inventor": ("person", "person_name", ["person_org"]),
    "ipc": ("code", "code", ["section"]),
    "legal_status": ("status", "status_name", []),
}


def rank_items(
    graph: GraphBinding,
    rank_by: str,
    filters: Mapping[str, object] | None = None,
    top_n: int = 10,
    metric: str = "count",
    region_rules: Sequence[tuple[str, str]] = tuple(PARTY_REGIONS),
    other: str = OTHER_REGION,
) -> DataFrame:
    """Top n of a dimension by distinct items or by a summed counter; ties break on the name."""
    if metric not in ("count", "transfer_count", "litigation_count"):
        raise ValueError(f"unsupported rank metric: {metric}")
    summed = metric != "count"
    if rank_by == "region":
        group, key, carried = "party", "region", []
    elif rank_by in RANK_DIMENSIONS:
        group, key, carried = RANK_DIMENSIONS[rank_by]
    else:
        raise ValueError(f"unsupported rank dimension: {rank_by}")
    rows = filtered_items(graph, filters, keep=group, counters=summed, bag=summed, distinct=summed)
    if rank_by == "region":
        rows = rows.withColumn("region", region_of("party_name", region_rules, other))
    rows = rows.withColumn("name", F.col(key))
    if summed:
        value = F.sum(F.coalesce(F.col(metric), F.lit(0)) * F.col("mult"))
        out = rows.groupBy("name", *carried).agg(value.alias("value"))
    else:
        out = items_per(rows, ["name", *carried], "value")
    return out.orderBy(F.desc("value"), "name", *carried).limit(top_n)


def rank_target(
    graph: GraphBinding,
    target: str,
    filters: Mapping[str, object] | None = None,
    n: int = 10,
    region_rules: Sequence[tuple[str, str]] = tuple(PARTY_REGIONS),
    base: DataFrame | None = None,
    other: str = OTHER_REGION,
) -> DataFrame:
    """The four-target rank tool (orgs, domains, regions, years), optionally over search hits."""
    if target == "years":
        rows = filtered_items(graph, filters, base=base).withColumn("name", year_of())
        out = rows.groupBy("name").agg(F.count("*").alias("value"))
    elif target in ("orgs", "regions"):
        rows = filtered_items(graph, filters, keep="party", base=base, distinct=False)
        key = F.col("party_name") if target == "orgs" else region_of("party_name", region_rules, other)
        out = items_per(rows.withColumn("name", key), ["name"], "value")
    elif target == "domains":
        rows = filtered_items(graph, filters, keep="topic", base=base, distinct=False)
        out = items_per(rows.withColumn("name", F.col("topic_name")), ["name"], "value")
    else:
        raise ValueError(f"unsupported rank target: {target}")
    return out.orderBy(F.desc("value"), "name").limit(n)


def trend(
    graph: GraphBinding,
    start_year: str,
    end_year: str,
    filters: Mapping[str, object] | None = None,
    compare_by: str | None = None,
    region_rules: Sequence[tuple[str, str]] = tuple(PARTY_REGIONS),
    top: int = 5,
    reapply_filters: bool = False,
    base: DataFrame | None = None,
    other: str = OTHER_REGION,
) -> DataFrame:
    """Yearly counts in an inclusive range, alone or compared by topic, region or top parties.

    `compare_by="org"` finds the top parties under the filters and then counts
    all of their items: the filters are not applied again unless asked for.
    """
    in_range = F.col("year").between(start_year, end_year)
    # the range as filter keys too, so that a binding can push it to its files
    ranged = {"year_start": start_year, "year_end": end_year, **(filters or {})}
    if compare_by is None:
        rows = filtered_items(graph, ranged, base=base).withColumn("year", year_of()).filter(in_range)
        return rows.groupBy("year").agg(F.count("*").alias("count"))
    if compare_by == "domain":
        rows = filtered_items(graph, ranged, keep="topic", base=base, distinct=False).withColumn("year", year_of()).filter(in_range)
        return rows.groupBy("year", F.col("topic_name").alias("domain")).agg(F.countDistinct("item_id").alias("count"))
    if compare_by == "region":
        rows = filtered_items(graph, ranged, keep="party", base=base, distinct=False).withColumn("year", year_of()).filter(in_range)
        rows = rows.withColumn("region", region_of("party_name", region_rules, other))
        return rows.groupBy("year", "region").agg(F.countDistinct("item_id").alias("count"))
    if compare_by == "org":
        first = filtered_items(graph, filters, keep="party", base=base, distinct=False)
        totals = first.groupBy("party_name").agg(F.countDistinct("item_id").alias("total"))
        leaders = totals.orderBy(F.desc("total"), "party_name").limit(top).select("party_name")
        bounds = {"year_start": start_year, "year_end": end_year}
        second = filtered_items(graph, ranged if reapply_filters else bounds, keep="party", distinct=False)
        second = second.withColumn("year", year_of()).filter(in_range)
        rows = second.join(leaders, "party_name", "left_semi")
        return rows.groupBy("year", F.col("party_name").alias("org")).agg(F.countDistinct("item_id").alias("count"))
    raise ValueError(f"unsupported comparison: {compare_by}")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return first_rows(df, order, limit, offset)


def list_items(
    graph: GraphBinding,
    filters: Mapping[str, object] | None = None,
    limit: int = 50,
    offset: int = 0,
    applicants: int = 3,
    base: DataFrame | None = None,
) -> DataFrame:
    """A page of items, latest first, with at most `applicants` party names each.

    The page is cut first; parties are joined to the page only.
    """
    rows = page(
        filtered_items(graph, filters, base=base).select("item_id", "title", "item_date"),
        [F.desc("item_date"), F.col("item_id")],
        limit,
        offset,
    )
    names = rows.join(graph.relation("party").select("item_id", "party_name"), "item_id", "left")
    capped = F.slice(F.array_sort(F.collect_set("party_name")), 1, applicants)
    return names.groupBy("item_id", "title", "item_date").agg(F.array_join(capped, ";").alias("applicants"))


def list_targets(
    graph: GraphBinding, target: str, filters: Mapping[str, object] | None = None, limit: int = 50
) -> DataFrame:
    """Distinct parties or topics of the filtered items with their item counts."""
    group, key = {"orgs": ("party", "party_name"), "domains": ("topic", "topic_name")}[target]
    rows = filtered_items(graph, filters, keep=group, distinct=False)
    out = rows.groupBy(F.col(key).alias("name")).agg(F.countDistinct("item_id").alias("count"))
    return out.orderBy(F.desc("count"), "name").limit(limit)


def trailing_mean(
    df: DataFrame, keys: list[str], order: str, value: str, width: int = 10, block: int = 100_000
) -> DataFrame:
    """Moving average over the last `width` rows; rows without a full window are dropped.

    A group is cut into blocks of `block` rows; the last `width - 1` rows of a
    block are also sent to the next one, so a long series is spread over many
    tasks and the averages stay exact.
    """
    placed = with_group_index(df, keys, [F.col(order)])
    home = F.floor(F.col("pos") / block)
    lead = F.floor((F.col("pos") + width - 1) / block)
    homes = F.array_distinct(F.array(home, lead))
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    mean = F.avg(value).over(w.rowsBetween(-(width - 1), 0))
    out = spread.withColumn("moving_avg", mean).filter((F.col("_home") == F.col("_block")) & (F.col("pos") >= width - 1))
    return out.select(*df.columns, "moving_avg")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, for groups of any size.

    Rows get their position in the group from one range shuffle; only the rows
    next to a wanted point are looked at, so no task holds a whole group.
    """
    rows = with_group_index(df.select(*keys, value).filter(F.col(value).isNotNull()), keys, [F.col(value)], "_pos")
    rows = rows.join(rows.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    aggs = []
    for name, p in points.items():
        at = (F.col("_n") - 1) * F.lit(p)
        low = F.max(F.when(F.col("_pos") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("_pos") == F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * share).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def latency_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and exact p50 / p99 with linear interpolation."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return means.join(exact_percentiles(df, keys, value, {"p50": 0.5, "p99": 0.99}), keys, "left")
