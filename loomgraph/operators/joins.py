"""Neighbour joins: pattern matches, item detail, co-parties, hierarchies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.binding import GraphBinding
from loomgraph.runtime import spread, top_k_per_group, with_scalars


def collected(values: Column | str, limit: int | None = None) -> Column:
    """Distinct sorted list, optionally capped: `collect(DISTINCT x)[..n]` with a fixed order."""
    arr = F.array_sort(F.collect_set(values))
    return F.slice(arr, 1, limit) if limit else arr


def with_neighbours(items: DataFrame, rel: DataFrame, name: str, out: str, limit: int | None = None) -> DataFrame:
    """OPTIONAL match: left join to the per-item list of neighbours, cut to the first `limit`.

    The relation is cut to the given items before anything is made distinct or ranked.
    """
    rel = rel.join(items.select("item_id"), "item_id", "left_semi")
    if limit:
        rel = top_k_per_group(rel.select("item_id", name).distinct(), ["item_id"], [F.col(name)], limit)
    lists = rel.groupBy("item_id").agg(collected(name, limit).alias(out))
    return items.join(lists, "item_id", "left")


def _edge_lists(graph: GraphBinding, items: DataFrame, columns: Mapping[str, str], many: bool = False) -> DataFrame:
    """`item_id` and, for each output column, the sorted names at the end of its relation; a role follows its name.

    One aggregate gathers the names of each (item, relation), a second one on
    the same key turns the few relations of an item into columns. With `many` items the edges are dealt by item first.
    """
    edges = graph.edges(distinct=False).filter(F.col("rel_type").isin(list(columns.values())))
    if many:
        edges = spread(edges, "src_id")
    edges = edges.join(items.select(F.col("item_id").alias("src_id")), "src_id", "left_semi")
    per = edges.groupBy(F.col("src_id").alias("item_id"), "rel_type").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "dst_name", "role"))), ";").alias("names")
    )
    picked = [F.coalesce(F.max(F.when(F.col("rel_type") == rel, F.col("names"))), F.lit("")).alias(c) for c, rel in columns.items()]
    return per.groupBy("item_id").agg(*picked)


# output column -> relation
DETAIL = {
    "applicants": "APPLIED_BY",
    "owners": "OWNED_BY",
    "transferors": "TRANSFERRED_FROM",
    "transferees": "TRANSFERRED_TO",
    "licensors": "LICENSED_FROM",
    "licensees": "LICENSED_TO",
    "pledgees": "PLEDGED_TO",
    "topics": "BELONGS_TO",
    "codes": "CLASSIFIED_AS",
    "statuses": "HAS_STATUS",
    "countries": "PUBLISHED_IN",
    "families": "IN_FAMILY",
    "litigations": "LITIGATED_WITH",
}


def item_detail(graph: GraphBinding, items: DataFrame) -> DataFrame:
    """All relations of the given items as lists, from one pass over their edges."""
    return items.join(_edge_lists(graph, items, DETAIL), "item_id", "left")


def transfer_chain(graph: GraphBinding, items: DataFrame) -> DataFrame:
    """Original applicants, current owners and transferees of the given items."""
    chain = {"original_applicants": "APPLIED_BY", "current_owners": "OWNED_BY", "transferees": "TRANSFERRED_TO"}
    return items.join(_edge_lists(graph, items, chain, many=True), "item_id", "left")


def collaboration(rel: DataFrame, name_part: str, limit: int | None = None) -> DataFrame:
    """Co-parties of the parties whose name contains `name_part`, by shared items.

    Starts from the edges of the wanted parties, so the work is the degree of
    those parties and not the pairs of every item. `rel` is distinct
    `(item_id, party_id, party_name)`.
    """
    mine = rel.filter(F.col("party_name").contains(name_part)).select(
        "item_id", F.col("party_id").alias("o_id"), F.col("party_name").alias("organization")
    )
    other = rel.select("item_id", F.col("party_id").alias("p_id"), F.col("party_name").alias("partner_name"))
    pairs = mine.join(other, "item_id").filter(F.col("o_id") != F.col("p_id"))
    out = pairs.groupBy("organization", "partner_name").agg(F.countDistinct("item_id").alias("collab_count"))
    return out.orderBy(F.desc("collab_count"), "organization", "partner_name").limit(limit) if limit else out


def two_role_items(rel: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """Items with an edge `left` and an edge `right` to different parties, a name test on each."""

    def side(spec: tuple[str, str], tag: str) -> DataFrame:
        edge, part = spec
        hit = (F.col("rel_type") == edge) & F.col("party_name").contains(part)
        return rel.filter(hit).select(
            "item_id", F.col("party_id").alias(f"{tag}_id"), F.col("party_name").alias(f"{tag}_name")
        )

    return side(left, "l").join(side(right, "r"), "item_id").filter(F.col("l_id") != F.col("r_id")).drop("l_id", "r_id")


def all_parties(*frames: DataFrame) -> DataFrame:
    """Polymorphic endpoint: organisations and persons as one table, name = coalesce(name, uid)."""
    parts = []
    for df in frames:
        name = F.coalesce("name", "uid") if "uid" in df.columns else F.col("name")
        parts.append(df.select("party_id", name.alias("name"), "label"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_parent(nodes: DataFrame, key: str, parent: str, carried: Sequence[str]) -> DataFrame:
    """Optional parent of every node of a hierarchy (left self-join)."""
    up = nodes.select(F.col(key).alias(parent), *[F.col(c).alias(f"parent_{c}") for c in carried])
    return nodes.join(up, parent, "left")


def ancestors(nodes: DataFrame, key: str, parent: str, depth: int) -> DataFrame:
    """(node, ancestor, distance) up to a fixed depth: one equi-join per level."""
    step = nodes.filter(F.col(parent).isNotNull()).select(
        F.col(key).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("distance")
    )
    up = nodes.filter(F.col(parent).isNotNull()).select(F.col(key).alias("ancestor"), F.col(parent).alias("next"))
    out = step
    for d in range(2, depth + 1):
        step = step.join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(d).alias("distance"))
        out = out.unionByName(step)
    return out


def apply_mapping(records: DataFrame, key: str, roles: Sequence[str], mapping: DataFrame) -> DataFrame:
    """Replace the names in list columns by resolved structs.

    Unmapped names stand for themselves and are organisations. All roles travel
    in one long table, so the mapping is joined once. Output: one array column
    `<role>_resolved` per role.
    """
    mention = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("names")) for r in roles])).alias("m")
    long = records.select(key, mention).select(key, F.col("m.role"), F.posexplode("m.names").alias("pos", "original_name"))
    hit = mapping.select("original_name", "standard_name", "entity_type", "location")
    long = long.join(hit, "original_name", "left")
    info = F.struct(
        "pos",
        "original_name",
        F.coalesce("standard_name", "original_name").alias("standard_name"),
        F.coalesce("entity_type", F.lit("organization")).alias("entity_type"),
        "location",
    )
    # a record's own mentions only: bounded by the width of one record
    aggs = [
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("role") == r, info))),
            lambda x: x.dropFields("pos"),
        ).alias(f"{r}_resolved")
        for r in roles
    ]
    resolved = long.groupBy(key).agg(*aggs)
    out = records.join(resolved, key, "left")
    return out.select(
        *records.columns, *[F.coalesce(F.col(f"{r}_resolved"), F.array()).alias(f"{r}_resolved") for r in roles]
    )


def build_edges(mentions: DataFrame, items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints exist, each kept once.

    `mentions(src_id, rel_type, dst_label, dst_key, role)`; a missing endpoint
    drops the edge as a failed MATCH would.
    """
    kept = mentions.join(items.select(F.col("item_id").alias("src_id")), "src_id", "left_semi")
    kept = kept.join(nodes.select("dst_label", "dst_key"), ["dst_label", "dst_key"], "left_semi")
    return kept.select("src_id", "rel_type", "dst_label", "dst_key", "role").distinct()


def align(pred: DataFrame, gold: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Predictions next to gold rows (or two runs next to each other) by a shared key."""
    p = pred.select(key, *[F.col(c).alias(f"pred_{c}") for c in pred.columns if c != key])
    g = gold.select(key, *[F.col(c).alias(f"gold_{c}") for c in gold.columns if c != key])
    return g.join(p, key, how)


def compatible_patterns(matches: DataFrame, returns: DataFrame, rules: DataFrame) -> DataFrame:
    """Match x return patterns minus the pairs whose constrained dimension excludes the return.

    `matches(match_id, dims)`, `returns(return_id)`, `rules(dim, return_id)`. The
    full product is the feature here: both sides are pattern tables of a few dozen rows.
    """
    pairs = matches.select("match_id", F.explode_outer("dims").alias("dim"))
    banned = pairs.join(rules, "dim").select("match_id", "return_id").distinct()
    listed = with_scalars(matches.select("match_id"), returns.agg(F.collect_set("return_id").alias("ids")), "r")
    product = listed.select("match_id", F.explode("r.ids").alias("return_id"))
    return product.join(banned, ["match_id", "return_id"], "left_anti")
