"""Counts, ratios and statistics over the orders graph."""

from pyspark.sql import functions as F

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.base import query, table
from loomgraph.operators import aggregate as A
from loomgraph.operators.filters import filtered_items, year_of

REGIONS = [("#0000000", "north"), ("#0000001", "north"), ("#000001", "east"), ("5", "south"), ("7", "west")]
REGION_SQL = """CASE WHEN contains(party_name, '#0000000') THEN 'north' WHEN contains(party_name, '#0000001') THEN 'north'
    WHEN contains(party_name, '#000001') THEN 'east' WHEN contains(party_name, '5') THEN 'south'
    WHEN contains(party_name, '7') THEN 'west' ELSE 'other' END"""


@query(
    "a01_count_filtered",
    """SELECT count(DISTINCT i.item_id) AS count FROM items i JOIN party p ON i.item_id = p.item_id
       JOIN topic t ON i.item_id = t.item_id
       WHERE party_type = 'BUILDING' AND topic_parent = 'PROMO' AND topic_name LIKE '%#13' AND item_date >= '1996'""",
)
def count_filtered(spark, path):
    spec = {"org_type": "BUILDING", "domain": "PROMO Brand#13", "year_start": "1996"}
    return A.count_items(OrdersBinding(spark, path), spec)


def _count_by(name: str, group_by: str, sql: str, spec: dict | None = None) -> None:
    @query(name, sql)
    def run(spark, path, group_by=group_by, spec=spec):
        return A.count_by(OrdersBinding(spark, path), group_by, spec, REGIONS, "other")


_count_by(
    "a02_count_by_year",
    "year",
    """SELECT substr(item_date, 1, 4) AS year, count(DISTINCT i.item_id) AS count FROM items i
       JOIN status s ON i.item_id = s.item_id WHERE status_name = 'F' AND substr(item_date, 1, 4) BETWEEN '2000' AND '2030' GROUP BY 1""",
    {"legal_status": "F"},
)
_count_by("a03_count_by_domain", "domain", "SELECT topic_name AS domain, count(DISTINCT item_id) AS count FROM topic GROUP BY 1")
_count_by(
    "a03_count_by_org",
    "org",
    """SELECT party_name AS org, party_type, count(DISTINCT item_id) AS count FROM party GROUP BY 1, 2""",
)
_count_by("a03_count_by_org_type", "org_type", "SELECT party_type AS org_type, count(DISTINCT item_id) AS count FROM party GROUP BY 1")
_count_by("a03_count_by_region", "region", f"SELECT {REGION_SQL} AS region, count(DISTINCT item_id) AS count FROM party GROUP BY 1")
_count_by("a03_count_by_country", "country", "SELECT country_name AS country, count(DISTINCT item_id) AS count FROM country GROUP BY 1")
_count_by("a03_count_by_status", "legal_status", "SELECT status_name AS legal_status, count(DISTINCT item_id) AS count FROM status GROUP BY 1")
@query(
    "a03_count_by_code_section",
    """SELECT section AS ipc_section, count(DISTINCT c.item_id) AS count FROM code c JOIN citems i ON i.item_id = c.item_id
       WHERE transfer_count > 0 GROUP BY 1""",
)
def count_by_section(spark, path):
    return A.count_by(OrdersBinding(spark, path), "ipc_section", {"has_transfer": True})


@query(
    "a04_count_neighbours",
    """SELECT 'orgs' AS target, count(DISTINCT party_id) AS count FROM party p JOIN status s ON p.item_id = s.item_id WHERE status_name = 'F'
       UNION ALL SELECT 'domains', count(DISTINCT topic_name) FROM topic t JOIN status s ON t.item_id = s.item_id WHERE status_name = 'F'""",
)
def count_neighbours(spark, path):
    g = OrdersBinding(spark, path)
    parts = [A.count_neighbours(g, t, {"legal_status": "F"}).select(F.lit(t).alias("target"), "count") for t in ("orgs", "domains")]
    return parts[0].unionByName(parts[1])


@query(
    "a05_flag_ratio",
    """SELECT count(*) FILTER (transfer_count > 0) AS with_activity, count(*) AS total,
       round(count(*) FILTER (transfer_count > 0) * 100.0 / count(*), 2)::DOUBLE AS ratio FROM citems""",
)
def flag_ratio(spark, path):
    return A.flag_ratio(OrdersBinding(spark, path), "transfer_count")


@query(
    "a06_counter_summary",
    "SELECT round(avg(license_count), 2) AS avg_value, max(license_count) AS max_value FROM citems",
)
def counter_summary(spark, path):
    return A.counter_summary(OrdersBinding(spark, path), "license_count")


@query(
    "a07_sum_metric_with_multiplicity",
    """SELECT topic_name AS name, CAST(sum(transfer_count) AS BIGINT) AS value FROM citems i JOIN topic t ON i.item_id = t.item_id
       JOIN activity a ON a.item_id = i.item_id WHERE a.rel_type = 'LICENSED_TO' AND contains(a.party_name, '1') GROUP BY 1""",
)
def sum_metric(spark, path):
    return A.sum_metric_by(OrdersBinding(spark, path), "topic", "topic_name", "transfer_count", {"licensee": "1"})


_STATS = {
    "topics": """SELECT t.topic_name, t.topic_level, t.topic_parent, count(e.item_id) AS item_count
        FROM topics t LEFT JOIN topic e ON t.topic_name = e.topic_name GROUP BY 1, 2, 3""",
    "top_parties": "SELECT party_name, party_type, count(*) AS n FROM party GROUP BY 1, 2 ORDER BY n DESC, party_name, party_type LIMIT 100",
    "date_range": "SELECT min(item_date) AS earliest, max(item_date) AS latest FROM items",
    "total": "SELECT count(*) AS total FROM items",
    "by_year": "SELECT substr(item_date, 1, 4) AS year, count(*) AS count FROM items WHERE substr(item_date, 1, 4) BETWEEN '2000' AND '2030' GROUP BY 1",
    "by_status": "SELECT status_name, count(*) AS n FROM status GROUP BY 1",
    "by_country": "SELECT country_name, count(*) AS n FROM country GROUP BY 1",
}
for _part, _sql in _STATS.items():

    @query(f"a08_statistics_{_part}", _sql)
    def _stat(spark, path, part=_part):
        return A.graph_statistics(OrdersBinding(spark, path), 100, 30)[part]


@query(
    "a08_label_counts",
    """SELECT 'Item' AS label, count(*) AS n FROM items UNION ALL SELECT 'Organization', count(*) FROM parties
       UNION ALL SELECT 'Topic', count(*) FROM topics UNION ALL SELECT 'Code', count(DISTINCT code) FROM code
       UNION ALL SELECT 'Country', count(DISTINCT country_name) FROM country UNION ALL SELECT 'Status', count(DISTINCT status_name) FROM status
       UNION ALL SELECT 'Family', count(DISTINCT family_id) FROM family""",
)
def label_counts(spark, path):
    return A.label_counts(OrdersBinding(spark, path))


def _frequency(name: str, sql: str, build) -> None:
    @query(name, sql)
    def run(spark, path, build=build):
        return build(OrdersBinding(spark, path))


_frequency(
    "a09_parties_by_items",
    "SELECT party_name, party_type, count(DISTINCT item_id) AS n FROM party GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 100",
    lambda g: A.frequency(g.relation("party"), ["party_name", "party_type"], "item_id", 100),
)
for _edge in ("TRANSFERRED_TO", "LICENSED_TO", "PLEDGED_TO"):
    _frequency(
        f"a09_parties_by_{_edge.lower()}",
        f"SELECT party_name, count(DISTINCT item_id) AS n FROM activity WHERE rel_type = '{_edge}' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50",
        lambda g, e=_edge: A.frequency(
            g.relation("activity").filter(F.col("rel_type") == e), ["party_name"], "item_id", 50
        ),
    )
_frequency(
    "a09_places_by_parties",
    "SELECT place_province, place_country, count(DISTINCT party_id) AS n FROM parties GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50",
    lambda g: A.frequency(g.parties(), ["place_province", "place_country"], "party_id", 50),
)
_frequency(
    "a09_codes",
    "SELECT code, count(DISTINCT item_id) AS n FROM code GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30",
    lambda g: A.frequency(g.relation("code"), ["code"], "item_id", 30),
)
_frequency(
    "a09_litigation_types",
    "SELECT type_name, count(DISTINCT item_id) AS n FROM littype GROUP BY 1",
    lambda g: A.frequency(g.relation("littype"), ["type_name"], "item_id"),
)
_frequency(
    "a09_large_families",
    "SELECT family_id, count(*) AS n FROM family GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, 1 LIMIT 20",
    lambda g: A.frequency(g.relation("family"), ["family_id"], limit=20, minimum=3),
)
_frequency(
    "a09_party_types",
    "SELECT party_type, count(*) AS n FROM parties GROUP BY 1",
    lambda g: A.frequency(g.parties(), ["party_type"]),
)
_frequency(
    "a09_years",
    "SELECT substr(item_date, 1, 4) AS year, count(*) AS n FROM items GROUP BY 1 ORDER BY 1 DESC LIMIT 20",
    lambda g: g.items().groupBy(year_of().alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year")).limit(20),
)


@query(
    "a10_family_sizes",
    """SELECT min(m) AS min_members, max(m) AS max_members, round(avg(m), 6) AS avg_members, count(*) AS total_families
       FROM (SELECT family_id, count(*) AS m FROM family GROUP BY 1)""",
)
def family_sizes(spark, path):
    return A.family_sizes(OrdersBinding(spark, path))


@query("a11_edge_histogram", "SELECT rel_type, count(*) AS count FROM edges GROUP BY 1")
def edge_histogram(spark, path):
    return A.edge_histogram(OrdersBinding(spark, path).edges())


@query(
    "a12_load_statistics",
    """SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2
       UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
       UNION ALL SELECT 'words', '(distinct)', count(DISTINCT w) FROM (SELECT unnest(string_split_regex(lower(trim(text)), '[ \\n]+')) AS w FROM documents)
       UNION ALL SELECT '*', '(rows)', count(*) FROM documents""",
)
def load_statistics(spark, path):
    docs = table(spark, path, "documents").withColumn("words", F.split(F.lower(F.trim("text")), "[ \n]+"))
    return A.load_statistics(docs, ["lang", "source"], ["words"])


@query(
    "a13_group_entities",
    """SELECT topic_parent AS standard_name, string_agg(topic_name, '; ' ORDER BY topic_name) AS aliases, min(topic_name) AS place
       FROM topics WHERE topic_level = 3 GROUP BY 1""",
)
def group_entities(spark, path):
    topics = OrdersBinding(spark, path).topics().filter("topic_level = 3")
    mapping = topics.select(
        F.col("topic_name").alias("original_name"), F.col("topic_parent").alias("standard_name"), F.col("topic_name").alias("place")
    )
    return A.group_entities(mapping)


@query(
    "a14_value_lists",
    """SELECT 'status' AS field, status_name AS value FROM (SELECT DISTINCT status_name FROM status)
       UNION ALL SELECT 'transferee', party_name FROM (SELECT party_name, count(*) AS n FROM activity WHERE rel_type = 'TRANSFERRED_TO'
           GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50)""",
)
def value_lists(spark, path):
    g = OrdersBinding(spark, path)
    status = g.relation("status").select(F.lit("status").alias("field"), F.col("status_name").alias("value")).distinct()
    act = g.relation("activity", distinct=True).filter(F.col("rel_type") == "TRANSFERRED_TO")
    top = A.frequency(act, ["party_name"], limit=50).select(F.lit("transferee").alias("field"), F.col("party_name").alias("value"))
    return status.unionByName(top)


_METRICS = """SELECT event_type || CASE k % 6 WHEN 0 THEN '/max' WHEN 1 THEN '/mean' WHEN 2 THEN '/min' WHEN 3 THEN '/total'
    WHEN 4 THEN '/timing_s/step' ELSE '/loss' END AS metric, value, event_id AS step, k AS sample_count
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def _metric_rows(spark, path):
    ev = table(spark, path, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("/max", "/mean", "/min", "/total", "/timing_s/step", "/loss")]), (F.col("k") % 6 + 1).cast("int"))
    return ev.select(F.concat("event_type", names).alias("metric"), "value", F.col("event_id").alias("step"), F.col("k").alias("sample_count"))


@query(
    "a17_rollup_metrics",
    """SELECT metric, CASE WHEN contains(metric, 'timing_s/') THEN 'time_sum' WHEN contains(metric, 'mean') THEN 'avg'
         WHEN contains(metric, 'max') THEN 'max' WHEN contains(metric, 'min') THEN 'min' WHEN contains(metric, 'total') THEN 'sum' ELSE 'avg' END AS rule,
       round(CASE WHEN contains(metric, 'timing_s/') THEN sum(value) WHEN contains(metric, 'mean') THEN avg(value)
         WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) WHEN contains(metric, 'total') THEN sum(value)
         ELSE avg(value) END, 6) AS value FROM m GROUP BY metric""",
    {"m": _METRICS},
)
def rollup_metrics(spark, path):
    return A.rollup_metrics(_metric_rows(spark, path)).withColumn("value", F.round("value", 6))


@query(
    "a17_reduce_metrics",
    """SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value)
       ELSE avg(value) END, 6) AS value FROM m GROUP BY metric""",
    {"m": _METRICS},
)
def reduce_metrics(spark, path):
    return A.reduce_metrics(_metric_rows(spark, path)).withColumn("value", F.round("value", 6))


@query(
    "a18_mean_score_per_source",
    """SELECT source, round(avg(m), 6) AS test_score FROM (SELECT source, uid, avg(score) AS m FROM responses GROUP BY 1, 2) GROUP BY 1""",
)
def mean_score(spark, path):
    ev = table(spark, path, "events").select(F.col("event_type").alias("source"), F.col("user_id").alias("uid"), F.col("value").alias("score"))
    return A.mean_score_per_source(ev, "source", "uid", "score").withColumn("test_score", F.round("test_score", 6))
