"""Rankings, trends, lists and constraint tasks over the orders graph."""

from pyspark.sql import functions as F

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.aggregation import REGION_SQL, REGIONS
from loomgraph.catalog.base import query, table
from loomgraph.operators import ranking as R
from loomgraph.operators.filters import filtered_items, year_of
from loomgraph.plans.constraints import run_constraints
from loomgraph.runtime import keep_first


def _rank(name: str, sql: str, **kw) -> None:
    @query(name, sql)
    def run(spark, path, kw=kw):
        return R.rank_items(OrdersBinding(spark, path), region_rules=REGIONS, other="other", **kw)


_rank(
    "w01_rank_org",
    """SELECT party_name AS name, party_type, count(DISTINCT p.item_id) AS value FROM party p
       WHERE place_country = 'ASIA' AND substr((SELECT item_date FROM items i WHERE i.item_id = p.item_id), 1, 4) BETWEEN '1996' AND '2000'
       AND EXISTS (SELECT 1 FROM topic t WHERE t.item_id = p.item_id AND topic_name IN ('PROMO Brand#13', 'SMALL Brand#4', 'LARGE Brand#2', 'ECONOMY Brand#7'))
       GROUP BY 1, 2 ORDER BY value DESC, name, party_type LIMIT 10""",
    rank_by="org",
    filters={
        "domain_in": ["PROMO Brand#13", "SMALL Brand#4", "LARGE Brand#2", "ECONOMY Brand#7"],
        "location_country": "ASIA",
        "year_start": "1996",
        "year_end": "2000",
    },
)
_rank(
    "w01_rank_domain",
    "SELECT topic_name AS name, topic_level, count(DISTINCT item_id) AS value FROM topic GROUP BY 1, 2 ORDER BY value DESC, name LIMIT 10",
    rank_by="domain",
)
_rank(
    "w01_rank_region",
    f"SELECT {REGION_SQL} AS name, count(DISTINCT item_id) AS value FROM party GROUP BY 1 ORDER BY value DESC, name LIMIT 3",
    rank_by="region",
    top_n=3,
)
_rank(
    "w01_rank_country",
    "SELECT country_name AS name, count(DISTINCT item_id) AS value FROM country GROUP BY 1 ORDER BY value DESC, name LIMIT 10",
    rank_by="country",
)
_rank(
    "w01_rank_inventor",
    """SELECT person_name AS name, person_org, count(DISTINCT item_id) AS value FROM person GROUP BY 1, 2
       ORDER BY value DESC, name, person_org LIMIT 10""",
    rank_by="inventor",
)
_rank(
    "w01_rank_code",
    "SELECT code AS name, section, count(DISTINCT item_id) AS value FROM code GROUP BY 1, 2 ORDER BY value DESC, name, section LIMIT 15",
    rank_by="ipc",
    top_n=15,
)
_rank(
    "w01_rank_status",
    "SELECT status_name AS name, count(DISTINCT item_id) AS value FROM status GROUP BY 1 ORDER BY value DESC, name LIMIT 10",
    rank_by="legal_status",
)
_rank(
    "w01_rank_org_by_transfers",
    """SELECT party_name AS name, party_type, CAST(sum(transfer_count) AS BIGINT) AS value FROM party p JOIN citems i ON p.item_id = i.item_id
       JOIN littype l ON l.item_id = p.item_id WHERE type_name IN ('R', 'A') GROUP BY 1, 2 ORDER BY value DESC, name LIMIT 10""",
    rank_by="org",
    metric="transfer_count",
    filters={"litigation_type_in": ["R", "A"]},
)


def _target(name: str, target: str, key: str, src: str) -> None:
    sql = f"""SELECT {key} AS name, count(DISTINCT x.item_id) AS value FROM {src} x JOIN status s ON s.item_id = x.item_id
        WHERE status_name = 'P' GROUP BY 1 ORDER BY value DESC, name LIMIT 8"""

    @query(name, sql)
    def run(spark, path, target=target):
        return R.rank_target(OrdersBinding(spark, path), target, {"legal_status": "P"}, 8, REGIONS, other="other")


_target("w02_rank_target_orgs", "orgs", "party_name", "party")
_target("w02_rank_target_domains", "domains", "topic_name", "topic")
_target("w02_rank_target_regions", "regions", REGION_SQL.replace("'other'", "'other'"), "party")
_target("w02_rank_target_years", "years", "substr(item_date, 1, 4)", "items")


def _trend(name: str, sql: str, **kw) -> None:
    @query(name, sql)
    def run(spark, path, kw=kw):
        return R.trend(OrdersBinding(spark, path), "1996", "1999", region_rules=REGIONS, other="other", **kw)


_YEARS = "substr(item_date, 1, 4) BETWEEN '1996' AND '1999'"
_trend(
    "w03_trend",
    f"""SELECT substr(item_date, 1, 4) AS year, count(*) AS count FROM items i WHERE {_YEARS}
        AND EXISTS (SELECT 1 FROM party p WHERE p.item_id = i.item_id AND party_type = 'BUILDING') GROUP BY 1""",
    filters={"org_type": "BUILDING"},
)
_trend(
    "w04_trend_by_domain",
    f"""SELECT substr(item_date, 1, 4) AS year, topic_name AS domain, count(DISTINCT i.item_id) AS count FROM items i
        JOIN topic t ON t.item_id = i.item_id WHERE {_YEARS} AND topic_name IN ('PROMO Brand#13', 'SMALL Brand#4') GROUP BY 1, 2""",
    filters={"domain_in": ["PROMO Brand#13", "SMALL Brand#4"]},
    compare_by="domain",
)
_trend(
    "w04_trend_by_region",
    f"""SELECT substr(item_date, 1, 4) AS year, {REGION_SQL} AS region, count(DISTINCT i.item_id) AS count FROM items i
        JOIN party p ON p.item_id = i.item_id WHERE {_YEARS} GROUP BY 1, 2""",
    compare_by="region",
)
_trend(
    "w05_trend_top_parties",
    f"""SELECT substr(item_date, 1, 4) AS year, party_name AS org, count(DISTINCT i.item_id) AS count FROM items i
        JOIN party p ON p.item_id = i.item_id WHERE {_YEARS} AND party_name IN
        (SELECT party_name FROM (SELECT party_name, count(DISTINCT p.item_id) AS total FROM party p JOIN status s ON s.item_id = p.item_id
           WHERE status_name = 'F' GROUP BY 1 ORDER BY total DESC, party_name LIMIT 5)) GROUP BY 1, 2""",
    filters={"legal_status": "F"},
    compare_by="org",
)


@query(
    "w06_keep_first",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER
       (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def keep_first_rows(spark, path):
    cols = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    order = [F.col(c) for c in cols[1:]]
    return keep_first(table(spark, path, "lineitem").select(*cols), ["l_partkey"], order).drop("l_extendedprice")


@query(
    "w07_best_turn",
    """SELECT conv_id, turn, length(text) AS score FROM (SELECT *, row_number() OVER
       (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) AS rn FROM conversations) WHERE rn = 1""",
)
def best_turn(spark, path):
    conv = table(spark, path, "conversations").select("conv_id", "turn", F.length("text").alias("score"))
    return keep_first(conv, ["conv_id"], [-F.col("turn"), -F.col("score")])


@query(
    "w11_trailing_mean",
    """SELECT user_id, event_id, round(m, 6) AS moving_avg FROM (SELECT user_id, event_id,
         avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn >= 10""",
)
def trailing_mean(spark, path):
    ev = table(spark, path, "events").select("user_id", "event_id", "value")
    return R.trailing_mean(ev, ["user_id"], "event_id", "value").select("user_id", "event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query(
    "w12_latency_percentiles",
    """SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
)
def latency(spark, path):
    out = R.latency_summary(table(spark, path, "events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p99")])


_PAGE = """SELECT i.item_id, title, item_date FROM items i JOIN party p ON p.item_id = i.item_id WHERE party_type = 'BUILDING'
    ORDER BY item_date DESC, i.item_id LIMIT 25 OFFSET 10"""


@query(
    "l01_latest_items",
    "SELECT i.item_id, title, item_date FROM items i JOIN status s ON s.item_id = i.item_id WHERE status_name = 'P' ORDER BY item_date DESC, i.item_id LIMIT 20",
)
def latest_items(spark, path):
    rows = filtered_items(OrdersBinding(spark, path), {"legal_status": "P"}).select("item_id", "title", "item_date")
    return R.page(rows, [F.desc("item_date"), F.col("item_id")], 20)


for _target_name, _key, _src in (("orgs", "party_name", "party"), ("domains", "topic_name", "topic")):

    @query(
        f"l01_list_{_target_name}",
        f"""SELECT {_key} AS name, count(DISTINCT x.item_id) AS count FROM {_src} x JOIN status s ON s.item_id = x.item_id
            WHERE status_name = 'O' GROUP BY 1 ORDER BY count DESC, name LIMIT 30""",
    )
    def _list(spark, path, target=_target_name):
        return R.list_targets(OrdersBinding(spark, path), target, {"legal_status": "O"}, 30)


@query(
    "l02_page_with_offset",
    """SELECT g.item_id, title, item_date, string_agg(DISTINCT party_name, ';' ORDER BY party_name) AS applicants
       FROM page g JOIN party p ON p.item_id = g.item_id GROUP BY 1, 2, 3""",
    {"page": _PAGE},
)
def page_with_offset(spark, path):
    return R.list_items(OrdersBinding(spark, path), {"org_type": "BUILDING"}, 25, 10)


@query("l03_projection_limit", "SELECT item_id, title, substr(item_date, 1, 4) AS year FROM items ORDER BY item_id LIMIT 50")
def projection_limit(spark, path):
    items = OrdersBinding(spark, path).items()
    return items.orderBy("item_id").limit(50).select("item_id", "title", year_of().alias("year"))


def _constraint(name: str, sql: str, c: dict) -> None:
    @query(name, sql)
    def run(spark, path, c=c):
        return run_constraints(OrdersBinding(spark, path), c)


def _ex(rel: str, cond: str = "true") -> str:
    return f"EXISTS (SELECT 1 FROM {rel} r WHERE r.item_id = i.item_id AND {cond})"


_constraint(
    "f17_constraint_count",
    f"SELECT count(*) AS total FROM items i WHERE {_ex('topic', chr(39).join(['topic_name = ', 'PROMO Brand#13', '']))}",
    {"task": "count", "tech_domain": "PROMO Brand#13"},
)
_constraint(
    "f17_constraint_list",
    f"""SELECT item_id, title, substr(item_date, 1, 4) AS year FROM items i WHERE {_ex("topic", "topic_name = 'SMALL Brand#4'")}
        AND {_ex("party", "place_province = 'NATION_3'")} ORDER BY item_date DESC, item_id LIMIT 50""",
    {"task": "list", "tech_domain": "SMALL Brand#4", "province": "NATION_3"},
)
_constraint(
    "f17_constraint_rank",
    f"""SELECT party_name AS org, count(DISTINCT i.item_id) AS count FROM items i JOIN party p ON p.item_id = i.item_id
        WHERE party_type = 'BUILDING' AND {_ex("topic", "topic_name = 'SMALL Brand#4'")} GROUP BY 1 ORDER BY count DESC, org LIMIT 10""",
    {"task": "rank", "org_type": "BUILDING", "tech_domain": "SMALL Brand#4", "group_by": "org", "top_n": 10},
)
_constraint(
    "f17_constraint_trend",
    f"""SELECT substr(item_date, 1, 4) AS year, count(*) AS count FROM items i WHERE {_ex("topic", "topic_name = 'LARGE Brand#2'")}
        AND item_date >= '1998' GROUP BY 1""",
    {"task": "trend", "tech_domain": "LARGE Brand#2", "year_from": "1998"},
)
_constraint(
    "f17_constraint_transfer",
    f"""SELECT item_id, title, substr(item_date, 1, 4) AS year FROM items i WHERE {_ex("topic", "topic_name = 'LARGE Brand#2'")}
        AND {_ex("activity", "rel_type = 'TRANSFERRED_TO'")} ORDER BY item_date DESC, item_id LIMIT 50""",
    {"task": "list", "has_transfer": True, "tech_domain": "LARGE Brand#2"},
)
_constraint(
    "f17_constraint_province_rank",
    f"""SELECT place_province AS province, count(DISTINCT i.item_id) AS count FROM items i JOIN party p ON p.item_id = i.item_id
        WHERE {_ex("country", "country_name = 'ASIA'")} AND {_ex("littype")} AND {_ex("activity", "rel_type = 'PLEDGED_TO'")}
        GROUP BY 1 ORDER BY count DESC, province LIMIT 10""",
    {"task": "rank", "country": "ASIA", "has_litigation": True, "has_pledge": True, "group_by": "province"},
)
