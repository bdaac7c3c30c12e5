"""The unified filter: a dictionary of conditions compiled to semi-joins.

Conditions on the same relation must hold for the same neighbour, so each
relation contributes exactly one join whose right side carries all of its
predicates. Falsy values mean "no condition", except the tri-state flags.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.binding import GraphBinding
from loomgraph.runtime import spread


def _contains(col: str):
    return lambda v: F.col(col).contains(v)


def _equals(col: str):
    return lambda v: F.col(col) == F.lit(v)


def _member(col: str):
    return lambda v: F.col(col).isin(list(v))


def _any_contains(col: str):
    return lambda v: reduce(or_, [F.col(col).contains(x) for x in v])


# key -> (relation group, predicate builder)
RELATION_KEYS = {
    "org": ("party", _contains("party_name")),
    "org_exact": ("party", _equals("party_name")),
    "org_type": ("party", _equals("party_type")),
    "org_in": ("party", _any_contains("party_name")),
    "region": ("party", _contains("party_name")),
    "region_exclude": ("party", lambda v: ~F.col("party_name").contains(v)),
    "region_in": ("party", _any_contains("party_name")),
    "location": ("party", _contains("place_name")),
    "location_country": ("party", _equals("place_country")),
    "location_province": ("party", _equals("place_province")),
    "location_city": ("party", _equals("place_city")),
    "location_district": ("party", _equals("place_district")),
    "location_level": ("party", _equals("place_level")),
    "location_path": ("party", lambda v: F.col("place_path").startswith(v)),
    "inventor": ("person", _equals("person_name")),
    "inventor_org": ("person", _contains("person_org")),
    "domain": ("topic", _equals("topic_name")),
    "domain_in": ("topic", _member("topic_name")),
    "ipc": ("code", _equals("code")),
    "ipc_prefix": ("code", lambda v: F.col("code").startswith(v)),
    "ipc_section": ("code", _equals("section")),
    "legal_status": ("status", _equals("status_name")),
    "legal_status_in": ("status", _member("status_name")),
    "country": ("country", _equals("country_name")),
    "country_in": ("country", _member("country_name")),
    "litigation_party": ("litigation", _contains("party_name")),
    "litigation_type": ("littype", _equals("type_name")),
    "litigation_type_in": ("littype", _member("type_name")),
    "family_id": ("family", _equals("family_id")),
}

# key -> edge name of the activity-party filters, one join each
ACTIVITY_KEYS = {
    "transferor": "TRANSFERRED_FROM",
    "transferee": "TRANSFERRED_TO",
    "licensor": "LICENSED_FROM",
    "licensee": "LICENSED_TO",
    "current_licensee": "CURRENT_LICENSED_TO",
    "pledgor": "PLEDGED_FROM",
    "pledgee": "PLEDGED_TO",
    "current_pledgee": "CURRENT_PLEDGED_TO",
    "rights_holder": "OWNED_BY",
}

FLAG_KEYS = {
    "has_transfer": "transfer_count",
    "has_license": "license_count",
    "has_pledge": "pledge_count",
    "has_litigation": "litigation_count",
}
MINIMUM_KEYS = {"transfer_count_min": "transfer_count", "litigation_count_min": "litigation_count"}


ALL_KEYS = [
    *RELATION_KEYS,
    *ACTIVITY_KEYS,
    *FLAG_KEYS,
    *MINIMUM_KEYS,
    "litigation_role",
    "has_family",
    "year",
    "year_start",
    "year_end",
    "patent_type",
    "keywords",
]

# keys that still act after a full-text search; the rest are ignored on that path
FULLTEXT_KEYS = [
    "org",
    "org_exact",
    "org_type",
    "org_in",
    "region",
    "region_exclude",
    "region_in",
    "inventor",
    "inventor_org",
    "domain",
    "domain_in",
    "ipc",
    "ipc_prefix",
    "ipc_section",
    "legal_status",
    "legal_status_in",
    "country",
    "country_in",
    "transferor",
    "transferee",
    "licensee",
    "pledgor",
    "pledgee",
    "litigation_party",
    "litigation_type",
    "litigation_type_in",
    "year",
    "year_start",
    "year_end",
    "patent_type",
    "has_transfer",
    "has_license",
    "has_pledge",
    "has_litigation",
]

# the eight keys of the older builder used by count / rank / trend / list
LEGACY_KEYS = ["org", "domain", "region", "year", "year_start", "year_end", "legal_status", "country"]

PLACE_KEYS = {k for k in RELATION_KEYS if k.startswith("location")}


def year_of(col: str = "item_date") -> Column:
    return F.substring(F.col(col), 1, 4)


def item_predicates(filters: Mapping[str, object]) -> list[Column]:
    """Conditions on the item's own columns; these reach the scan."""
    out: list[Column] = []
    for key, col in FLAG_KEYS.items():
        if filters.get(key) is True:
            out.append(F.col(col) > 0)
        elif filters.get(key) is False:
            out.append(F.coalesce(F.col(col), F.lit(0)) == 0)
    for key, col in MINIMUM_KEYS.items():
        if filters.get(key):
            out.append(F.col(col) >= filters[key])
    if filters.get("year"):
        out.append(year_of() == str(filters["year"]))
    if filters.get("year_start"):
        out.append(year_of() >= str(filters["year_start"]))
    if filters.get("year_end"):
        out.append(year_of() <= str(filters["year_end"]))
    if filters.get("patent_type"):
        out.append(F.col("item_type") == filters["patent_type"])
    return out


def year_bounds(items: DataFrame, filters: Mapping[str, object]) -> list[Column]:
    """The year conditions once more on the raw timestamp, which the file reader can use."""
    if "item_ts" not in items.columns:
        return []
    kind = items.schema["item_ts"].dataType.simpleString()
    low = [str(filters[k]) for k in ("year", "year_start") if filters.get(k)]
    high = [str(filters[k]) for k in ("year", "year_end") if filters.get(k)]
    out = [F.col("item_ts") >= F.lit(f"{y}-01-01").cast(kind) for y in low if len(y) == 4 and y.isdigit()]
    return out + [F.col("item_ts") < F.lit(f"{int(y) + 1}-01-01").cast(kind) for y in high if len(y) == 4 and y.isdigit()]


def relation_predicates(filters: Mapping[str, object]) -> dict[str, list[Column]]:
    groups: dict[str, list[Column]] = {}
    for key, (group, build) in RELATION_KEYS.items():
        if filters.get(key):
            groups.setdefault(group, []).append(build(filters[key]))
    if filters.get("litigation_party") and filters.get("litigation_role"):
        groups["litigation"].append(F.col("role") == filters["litigation_role"])
    if filters.get("has_family") is True:
        groups.setdefault("family", [])
    return groups


def needs_counters(filters: Mapping[str, object]) -> bool:
    return any(filters.get(k) is not None for k in FLAG_KEYS) or any(filters.get(k) for k in MINIMUM_KEYS)


def filtered_items(
    graph: GraphBinding,
    filters: Mapping[str, object] | None = None,
    keep: str | None = None,
    counters: bool = False,
    bag: bool = False,
    base: DataFrame | None = None,
    distinct: bool = True,
) -> DataFrame:
    """Items that satisfy every condition.

    `keep` names a relation whose matching neighbours stay in the output (one
    row per item and neighbour, or as often as the relation has it with
    `distinct=False`, which spares a shuffle to callers that count distinct
    items anyway). With `bag=True` a column `mult` carries how
    often the item would repeat in a pattern match over the other relations.
    """
    filters = dict(filters or {})
    unknown = set(filters) - set(ALL_KEYS)
    if unknown:
        raise ValueError(f"unknown filter keys: {sorted(unknown)}")
    items = base if base is not None else graph.items(counters=counters or needs_counters(filters))
    for pred in item_predicates(filters) + year_bounds(items, filters):
        items = items.filter(pred)
    items = items.drop("item_ts")
    mult = F.lit(1)

    def hop(items: DataFrame, rel: DataFrame, tag: str) -> DataFrame:
        nonlocal mult
        if not bag:
            return items.join(rel.select("item_id"), "item_id", "left_semi")
        counts = rel.groupBy("item_id").agg(F.count("*").alias(f"_m_{tag}"))
        mult = mult * F.col(f"_m_{tag}")
        return items.join(counts, "item_id")

    place = any(filters.get(k) for k in PLACE_KEYS)
    groups = relation_predicates(filters)
    for group, preds in groups.items():
        if group == keep:
            continue
        rel = graph.relation(group, place=place and group == "party", distinct=bag)
        items = hop(items, reduce(lambda d, p: d.filter(p), preds, rel), group)
    for key, edge in ACTIVITY_KEYS.items():
        if filters.get(key):
            rel = graph.relation("activity", distinct=bag).filter(
                (F.col("rel_type") == edge) & F.col("party_name").contains(filters[key])
            )
            items = hop(items, rel, key)
    if filters.get("has_family") is False:
        items = items.join(graph.relation("family").select("item_id"), "item_id", "left_anti")
    if keep:
        # join first: only the rows of items that pass are made distinct
        rel = graph.relation(keep, place=place and keep == "party")
        if base is None and not any(v is not None for v in filters.values()):
            rel = spread(rel, "item_id")  # nothing narrows the items: all of the relation moves
        items = items.join(reduce(lambda d, p: d.filter(p), groups.get(keep, []), rel), "item_id")
        if distinct:
            items = items.dropDuplicates(rel.columns)
    if bag:
        items = items.withColumn("mult", mult).drop(*[c for c in items.columns if c.startswith("_m_")])
    return items


def items_per(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct items per `keys`; pairs are made distinct by item first, where the join has left them."""
    return rows.select("item_id", *keys).distinct().groupBy(*keys).agg(F.count("item_id").alias(name))


def without_group(filters: Mapping[str, object], groups: set[str]) -> dict[str, object]:
    """The same filters with every condition on the named relation groups removed."""
    drop = {k for k, (g, _) in RELATION_KEYS.items() if g in groups}
    if "activity" in groups:
        drop |= set(ACTIVITY_KEYS) | set(FLAG_KEYS) | set(MINIMUM_KEYS)
    if "litigation" in groups:
        drop.add("litigation_role")
    if "family" in groups:
        drop.add("has_family")
    if "time" in groups:
        drop |= {"year", "year_start", "year_end"}
    return {k: v for k, v in filters.items() if k not in drop}


def having(df: DataFrame, column: str, minimum: int) -> DataFrame:
    """Post-aggregate filter."""
    return df.filter(F.col(column) >= minimum)


def combine_all(preds: list[Column]) -> Column:
    return reduce(and_, preds, F.lit(True))
