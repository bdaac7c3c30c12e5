"""Unified filter: one query per filter group over the orders graph."""

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.base import query
from loomgraph.operators import aggregate, filters
from loomgraph.operators.filters import filtered_items


def _register(name: str, spec: dict, where: str, source: str = "items") -> None:
    """Items under `spec`, checked against a WHERE clause over `source`."""
    sql = f"SELECT i.item_id, i.item_date FROM {source} i WHERE {where}"

    @query(name, sql)
    def run(spark, path, spec=spec):
        return filtered_items(OrdersBinding(spark, path), spec).select("item_id", "item_date")


def _exists(rel: str, cond: str) -> str:
    return f"EXISTS (SELECT 1 FROM {rel} r WHERE r.item_id = i.item_id AND {cond})"


_register("f01_party_contains", {"org": "#00000001"}, _exists("party", "contains(party_name, '#00000001')"))
_register("f01_party_exact", {"org_exact": "Customer#000000042"}, _exists("party", "party_name = 'Customer#000000042'"))
_register(
    "f01_party_type_and_list",
    {"org_type": "BUILDING", "org_in": ["00012", "00077", "001"]},
    _exists(
        "party",
        "party_type = 'BUILDING' AND (contains(party_name, '00012') OR contains(party_name, '00077') OR contains(party_name, '001'))",
    ),
)
_register(
    "f02_region_same_party",
    {"region_in": ["#0000001", "#0000007"], "region_exclude": "5", "org_type": "MACHINERY"},
    _exists(
        "party",
        "(contains(party_name, '#0000001') OR contains(party_name, '#0000007')) AND NOT contains(party_name, '5') AND party_type = 'MACHINERY'",
    ),
)
_register("f02_region_contains", {"region": "#0000003"}, _exists("party", "contains(party_name, '#0000003')"))
_register(
    "f03_person",
    {"inventor": "Supplier#000000007", "inventor_org": "Nation"},
    _exists("person", "person_name = 'Supplier#000000007' AND contains(person_org, 'Nation')"),
)
_register("f03_person_affiliation", {"inventor_org": "Nation 1"}, _exists("person", "contains(person_org, 'Nation 1')"))
_register("f04_topic", {"domain": "PROMO Brand#13"}, _exists("topic", "topic_name = 'PROMO Brand#13'"))
_register(
    "f04_topic_list",
    {"domain_in": ["PROMO Brand#13", "SMALL Brand#4", "LARGE Brand#2"]},
    _exists("topic", "topic_name IN ('PROMO Brand#13', 'SMALL Brand#4', 'LARGE Brand#2')"),
)
_register("f05_code_prefix_section", {"ipc_prefix": "E1", "ipc_section": "E"}, _exists("code", "starts_with(code, 'E1') AND section = 'E'"))
_register("f05_code_exact", {"ipc": "P13S/11"}, _exists("code", "code = 'P13S/11'"))
_register("f06_status", {"legal_status": "F"}, _exists("status", "status_name = 'F'"))
_register("f06_status_list", {"legal_status_in": ["F", "P"]}, _exists("status", "status_name IN ('F', 'P')"))
_register("f07_country", {"country": "ASIA"}, _exists("country", "country_name = 'ASIA'"))
_register("f07_country_list", {"country_in": ["ASIA", "EUROPE"]}, _exists("country", "country_name IN ('ASIA', 'EUROPE')"))
_register(
    "f08_place_two_hops",
    {"location_path": "ASIA/", "location_level": 2, "org_type": "BUILDING"},
    _exists("party", "starts_with(place_path, 'ASIA/') AND place_level = 2 AND party_type = 'BUILDING'"),
)
_register(
    "f08_place_fields",
    {"location": "NATION_1", "location_country": "AMERICA"},
    _exists("party", "contains(place_name, 'NATION_1') AND place_country = 'AMERICA'"),
)
_register("f08_place_province", {"location_province": "NATION_7"}, _exists("party", "place_province = 'NATION_7'"))
_register("f09_flags", {"has_transfer": True, "has_license": False}, "transfer_count > 0 AND license_count = 0", "citems")
_register("f09_flags_negative", {"has_pledge": False, "has_litigation": True}, "pledge_count = 0 AND litigation_count > 0", "citems")
_register("f10_minimums", {"transfer_count_min": 2, "litigation_count_min": 1}, "transfer_count >= 2 AND litigation_count >= 1", "citems")
for _key, _rel in filters.ACTIVITY_KEYS.items():
    if not _rel.startswith("CURRENT_"):
        _register(
            f"f11_{_key}",
            {_key: "#00000001"},
            _exists("activity", f"rel_type = '{_rel}' AND contains(party_name, '#00000001')"),
        )
_register(
    "f11_two_activities",
    {"transferee": "7", "licensor": "3"},
    _exists("activity", "rel_type = 'TRANSFERRED_TO' AND contains(party_name, '7')")
    + " AND "
    + _exists("activity", "rel_type = 'LICENSED_FROM' AND contains(party_name, '3')"),
)
_register(
    "f12_litigation_role",
    {"litigation_party": "#0000000", "litigation_role": "plaintiff", "litigation_type": "R"},
    _exists("litigation", "contains(party_name, '#0000000') AND role = 'plaintiff'") + " AND " + _exists("littype", "type_name = 'R'"),
)
_register("f12_litigation_types", {"litigation_type_in": ["R", "A"]}, _exists("littype", "type_name IN ('R', 'A')"))
_register("f13_family_present", {"has_family": True}, _exists("family", "true"))
_register("f13_family_absent", {"has_family": False}, "NOT " + _exists("family", "true"))
_register("f13_family_id", {"family_id": "42-1998"}, _exists("family", "family_id = '42-1998'"))
_register(
    "f14_year_range_type",
    {"year_start": "1996", "year_end": "1998", "patent_type": "2-HIGH"},
    "substr(item_date, 1, 4) BETWEEN '1996' AND '1998' AND item_type = '2-HIGH'",
)
_register("f14_year", {"year": 1997}, "substr(item_date, 1, 4) = '1997'")
_register(
    "f14_all_groups_conjunction",
    {
        "org_type": "BUILDING",
        "domain_in": ["PROMO Brand#13", "SMALL Brand#4", "LARGE Brand#2", "ECONOMY Brand#7"],
        "legal_status_in": ["F", "P"],
        "location_country": "ASIA",
        "has_transfer": True,
        "year_start": "1996",
        "year_end": "2000",
    },
    _exists("party", "party_type = 'BUILDING' AND place_country = 'ASIA'")
    + " AND "
    + _exists("topic", "topic_name IN ('PROMO Brand#13', 'SMALL Brand#4', 'LARGE Brand#2', 'ECONOMY Brand#7')")
    + " AND "
    + _exists("status", "status_name IN ('F', 'P')")
    + " AND transfer_count > 0 AND substr(item_date, 1, 4) BETWEEN '1996' AND '2000'",
    "citems",
)


@query(
    "f16_legacy_filter",
    f"""SELECT item_id FROM items i WHERE {_exists("party", "contains(party_name, '#0000001')")}
        AND {_exists("status", "status_name = 'O'")} AND substr(item_date, 1, 4) >= '1997'""",
)
def legacy_filter(spark, path):
    spec = {"region": "#0000001", "legal_status": "O", "year_start": "1997", "has_transfer": True}
    spec = {k: v for k, v in spec.items() if k in filters.LEGACY_KEYS}
    return filtered_items(OrdersBinding(spark, path), spec).select("item_id")


@query(
    "f18_having",
    "SELECT party_name, count(*) AS n FROM party GROUP BY 1 HAVING count(*) >= 12",
)
def having(spark, path):
    return aggregate.frequency(OrdersBinding(spark, path).relation("party"), ["party_name"], minimum=12)
