"""Constraint objects -> DataFrame: count, rank, trend and list tasks.

A constraint names a task and a handful of conditions; an edge condition
(transferee, licence, pledge, litigation) takes the place of the counter test.
A country without a province is the publication country.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.binding import GraphBinding
from loomgraph.operators.filters import filtered_items, year_of

# fixed values: default sizes of the rank and list tasks
DEFAULT_TOP = 10
DEFAULT_LIST = 50


def constraint_filters(c: Mapping[str, object]) -> dict[str, object]:
    """The relational conditions of a constraint as unified filter keys."""
    f: dict[str, object] = {
        "domain": c.get("tech_domain"),
        "legal_status": c.get("legal_status"),
        "org": c.get("org_name"),
        "org_type": c.get("org_type"),
        "location_province": c.get("province"),
        "transferee": c.get("transferee_name"),
    }
    if c.get("country") and not c.get("province"):
        f["country"] = c["country"]
    if c.get("year_exact"):
        f["year"] = c["year_exact"]
    else:
        f["year_start"], f["year_end"] = c.get("year_from"), c.get("year_to")
    return {k: v for k, v in f.items() if v}


def constrained_items(
    graph: GraphBinding, c: Mapping[str, object], keep: str | None = None, distinct: bool = True
) -> DataFrame:
    base = graph.items()

    def exists(rel: DataFrame) -> None:
        nonlocal base
        base = base.join(rel.select("item_id"), "item_id", "left_semi")

    activity = graph.relation("activity")
    if c.get("has_transfer") and not c.get("transferee_name"):
        exists(activity.filter(F.col("rel_type") == "TRANSFERRED_TO"))
    if c.get("has_license"):
        exists(activity.filter(F.col("rel_type") == "LICENSED_TO"))
    if c.get("has_pledge"):
        exists(activity.filter(F.col("rel_type") == "PLEDGED_TO"))
    if c.get("has_litigation"):
        exists(graph.relation("littype"))
    return filtered_items(graph, constraint_filters(c), keep=keep, base=base, distinct=distinct)


def run_constraints(graph: GraphBinding, c: Mapping[str, object]) -> DataFrame:
    """Dispatch a constraint object to its task."""
    task, group_by, top = c.get("task", "list"), c.get("group_by"), c.get("top_n")
    distinct = F.countDistinct("item_id").alias("count")
    if task == "trend" or (task == "count" and group_by == "year"):
        return constrained_items(graph, c).groupBy(year_of().alias("year")).agg(F.count("*").alias("count"))
    if task in ("count", "rank") and group_by in ("domain", "org", "province", "country"):
        if group_by == "domain":
            rows = constrained_items(graph, c, keep="topic", distinct=False)
            out = rows.groupBy(F.col("topic_name").alias("domain")).agg(distinct)
        elif group_by == "org":
            out = constrained_items(graph, c, keep="party", distinct=False).groupBy(F.col("party_name").alias("org")).agg(distinct)
        elif group_by == "country" and c.get("country") and not c.get("province"):
            out = constrained_items(graph, c, keep="country", distinct=False).groupBy(F.col("country_name").alias("country")).agg(distinct)
        else:
            rows = constrained_items(graph, c, keep="party", distinct=False).drop("place_province", "place_country")
            places = graph.parties().select("party_id", "place_province", "place_country")
            rows = rows.join(places, "party_id").withColumn(group_by, F.col(f"place_{group_by}"))
            if group_by == "province":
                rows = rows.filter(F.col("province").isNotNull() & (F.col("province") != ""))
            out = rows.groupBy(group_by).agg(distinct)
        if task == "rank":
            out = out.orderBy(F.desc("count"), group_by).limit(top or DEFAULT_TOP)
        return out
    if task == "count":
        return constrained_items(graph, c).agg(F.count("*").alias("total"))
    rows = constrained_items(graph, c)
    latest = rows.orderBy(F.desc("item_date"), "item_id")
    if task == "rank":
        return latest.limit(top or DEFAULT_TOP).select("item_id", "title", "item_date")
    return latest.limit(top or DEFAULT_LIST).select("item_id", "title", year_of().alias("year"))
