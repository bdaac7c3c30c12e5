"""Neighbourhoods, profiles, transfer chains, upserts."""

from pyspark.sql import functions as F

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.base import query, table
from loomgraph.operators import graph as G
from loomgraph.operators import joins as J
from loomgraph.runtime import spread


@query(
    "g04_disambiguate_persons",
    """SELECT name, main_party, topic, items, name || '@' || main_party || '_' || topic AS uid,
       count(*) OVER (PARTITION BY name) AS identities, CASE WHEN count(*) OVER (PARTITION BY name) = 1 THEN 1 ELSE 0 END AS direct FROM
       (SELECT p.person_name AS name, c.c_mktsegment AS main_party, o.o_orderstatus AS topic, count(DISTINCT p.item_id) AS items
        FROM person p JOIN orders o ON o.o_orderkey = p.item_id JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 2, 3)""",
)
def disambiguate(spark, path):
    g = OrdersBinding(spark, path)
    person = spread(g.relation("person").select("item_id", F.col("person_name").alias("name")), "item_id")
    party = g.relation("party").select("item_id", F.col("party_type").alias("main_party"))
    status = g.relation("status").select("item_id", F.col("status_name").alias("topic"))
    return G.disambiguate_persons(person.join(party, "item_id").join(status, "item_id"))


_BETWEEN = """SELECT DISTINCT * FROM (
    SELECT 'Organization' AS src_label, party_name AS src_name, 'LOCATED_IN' AS rel_type, 'Location' AS dst_label, place_name AS dst_name FROM parties
    UNION ALL SELECT 'Location', place_name, 'PARENT_LOCATION', 'Location', place_country FROM parties
    UNION ALL SELECT 'Topic', topic_name, 'PARENT_DOMAIN', 'Topic', topic_parent FROM topics WHERE topic_parent IS NOT NULL)"""


def _around(label: str, part: str) -> str:
    return f"""SELECT DISTINCT * FROM (
        SELECT dst_name AS entity, rel_type, 'in' AS direction, 'Item' AS related_type, CAST(src_id AS VARCHAR) AS related_name FROM edges
            WHERE dst_label = '{label}' AND contains(dst_name, '{part}')
        UNION ALL SELECT dst_name, rel_type, 'in', src_label, src_name FROM between_entities WHERE dst_label = '{label}' AND contains(dst_name, '{part}')
        UNION ALL SELECT src_name, rel_type, 'out', dst_label, dst_name FROM between_entities WHERE src_label = '{label}' AND contains(src_name, '{part}'))
        ORDER BY 1, 2, 3, 4, 5 LIMIT 50"""


@query("g05_entity_edges", "SELECT * FROM between_entities", {"between_entities": _BETWEEN})
def entity_edges(spark, path):
    return G.entity_edges(OrdersBinding(spark, path))


@query("g05_neighbourhood", _around("Organization", "Supplier#00000001"), {"between_entities": _BETWEEN})
def neighbourhood(spark, path):
    return G.neighbourhood(OrdersBinding(spark, path), "Supplier#00000001", "Organization")


@query("g05_explore_party", _around("Organization", "Customer#00000001"), {"between_entities": _BETWEEN})
def explore_party(spark, path):
    return G.neighbourhood(OrdersBinding(spark, path), "Customer#00000001", "Organization")


@query("g05_explore_place", _around("Location", "I"), {"between_entities": _BETWEEN})
def explore_place(spark, path):
    return G.neighbourhood(OrdersBinding(spark, path), "I", "Location")


@query("g05_explore_topic", _around("Topic", "ECONOMY"), {"between_entities": _BETWEEN})
def explore_topic(spark, path):
    return G.neighbourhood(OrdersBinding(spark, path), "ECONOMY", "Topic")


@query(
    "g05_explore_item",
    """SELECT DISTINCT CAST(src_id AS VARCHAR) AS entity, rel_type, 'out' AS direction, dst_label AS related_type, dst_name AS related_name
       FROM edges WHERE src_id IN (1, 2, 3) ORDER BY 1, 2, 4, 5 LIMIT 50""",
)
def explore_item(spark, path):
    return G.explore_items(OrdersBinding(spark, path), [1, 2, 3])


@query("g06_subgraph_one_hop", "SELECT DISTINCT src_id AS item_id, dst_label AS type, dst_name AS name, rel_type, 1 AS hop FROM edges")
def subgraph_one(spark, path):
    g = OrdersBinding(spark, path)
    return G.subgraph(g, g.items(), 1)


@query(
    "g06_subgraph_two_hops",
    """SELECT DISTINCT src_id AS item_id, dst_label AS type, dst_name AS name, rel_type, 1 AS hop FROM walked
       UNION ALL SELECT DISTINCT a.src_id, 'Item', CAST(c.src_id AS VARCHAR), c.rel_type, 2 FROM walked a
       JOIN walked c ON c.dst_label = a.dst_label AND c.dst_name = a.dst_name AND c.src_id <> a.src_id""",
    {"walked": "SELECT * FROM edges WHERE rel_type = 'IN_FAMILY'"},
)
def subgraph_two(spark, path):
    """Around every item, over the families."""
    g = OrdersBinding(spark, path)
    return G.subgraph(g, g.items(), 2, ["IN_FAMILY"])


@query(
    "g06_two_hops_by_degree",
    """SELECT src_id AS item_id, 1 AS hop, type, name, rel_type, CAST(NULL AS BIGINT) AS n_items FROM ends
       UNION ALL SELECT DISTINCT a.src_id, 2, 'Item', CAST(c.src_id AS VARCHAR), c.rel_type, 1 FROM ends a
       JOIN degrees USING (type, name) JOIN ends c ON c.type = a.type AND c.name = a.name AND c.src_id <> a.src_id WHERE edges <= 16
       UNION ALL SELECT * FROM (
           SELECT a.src_id, 2, a.type, a.name, c.rel_type, c.n - count(*) FILTER (a.rel_type = c.rel_type) AS others FROM ends a
           JOIN degrees d ON d.type = a.type AND d.name = a.name AND d.edges > 16
           JOIN (SELECT type, name, rel_type, count(*) AS n FROM ends GROUP BY ALL) c ON c.type = a.type AND c.name = a.name
           GROUP BY a.src_id, a.type, a.name, c.rel_type, c.n) WHERE others > 0""",
    {
        "ends": "SELECT DISTINCT src_id, rel_type, dst_label AS type, dst_name AS name FROM edges",
        "degrees": "SELECT type, name, count(*) AS edges FROM ends GROUP BY 1, 2",
    },
)
def two_hops_by_degree(spark, path):
    """Around every item, over all relations."""
    g = OrdersBinding(spark, path)
    return G.subgraph_by_degree(g)


_PARTY = {
    "matches": """SELECT party_name, party_type, (SELECT count(*) FROM party p WHERE p.party_id = q.party_id) AS item_count FROM parties q
        WHERE contains(party_name, '#0000004') ORDER BY item_count DESC, party_name LIMIT 5""",
    "topics": """SELECT topic_name, count(*) AS count FROM party p JOIN topic t ON t.item_id = p.item_id
        WHERE contains(party_name, '#0000004') GROUP BY 1""",
    "trend": """SELECT substr(item_date, 1, 4) AS year, count(*) AS count FROM party p JOIN items i ON i.item_id = p.item_id
        WHERE contains(party_name, '#0000004') AND item_date >= '1997' GROUP BY 1""",
}
for _part, _sql in _PARTY.items():

    @query(f"g07_party_profile_{_part}", _sql)
    def _party(spark, path, part=_part):
        return G.profile_party(OrdersBinding(spark, path), "#0000004", "1997")[part]


_TOPIC = {
    "count": "SELECT count(*) AS count FROM topic WHERE topic_name = 'SMALL Brand#4'",
    "parties": """SELECT party_name, party_type, count(*) AS count FROM topic t JOIN party p ON t.item_id = p.item_id
        WHERE topic_name = 'SMALL Brand#4' GROUP BY 1, 2 ORDER BY count DESC, 1 LIMIT 10""",
    "trend": """SELECT substr(item_date, 1, 4) AS year, count(*) AS count FROM topic t JOIN items i ON t.item_id = i.item_id
        WHERE topic_name = 'SMALL Brand#4' AND item_date >= '1997' GROUP BY 1""",
}
for _part, _sql in _TOPIC.items():

    @query(f"g07_topic_profile_{_part}", _sql)
    def _topic(spark, path, part=_part):
        return G.profile_topic(OrdersBinding(spark, path), "SMALL Brand#4", "1997")[part]


def _names(rel: str) -> str:
    return f"coalesce(string_agg(DISTINCT dst_name, ';' ORDER BY dst_name) FILTER (rel_type = '{rel}'), '')"


@query(
    "g08_transfer_chain",
    f"""SELECT i.item_id, {_names("APPLIED_BY")} AS original_applicants, {_names("OWNED_BY")} AS current_owners,
        {_names("TRANSFERRED_TO")} AS transferees FROM items i LEFT JOIN edges e ON e.src_id = i.item_id GROUP BY 1""",
)
def transfer_chain(spark, path):
    g = OrdersBinding(spark, path)
    return J.transfer_chain(g, g.items().select("item_id"))


@query(
    "g09_entity_items",
    """SELECT party_name AS entity, i.item_id, title, item_date, status_name FROM party p JOIN items i ON i.item_id = p.item_id
       JOIN status s ON s.item_id = i.item_id WHERE contains(party_name, '#0000012') ORDER BY item_date DESC, i.item_id LIMIT 20""",
)
def entity_items(spark, path):
    return G.entity_items(OrdersBinding(spark, path), "#0000012", "organization")


@query(
    "g09_topic_items",
    """SELECT topic_name AS entity, i.item_id, title, item_date, status_name FROM topic p JOIN items i ON i.item_id = p.item_id
       JOIN status s ON s.item_id = i.item_id WHERE topic_name = 'SMALL Brand#4' ORDER BY item_date DESC, i.item_id LIMIT 20""",
)
def topic_items(spark, path):
    return G.entity_items(OrdersBinding(spark, path), "SMALL Brand#4", "topic")


@query(
    "g10_upsert",
    """SELECT coalesce(c.c_custkey, n.o_custkey) AS id, coalesce(n.st, c.c_mktsegment) AS label, coalesce(n.pr, c.c_acctbal) AS amount
       FROM customer c FULL JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS st, max_by(o_totalprice, o_orderkey) AS pr
         FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) n ON n.o_custkey = c.c_custkey""",
)
def upsert(spark, path):
    current = table(spark, path, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("amount"))
    changes = table(spark, path, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("amount"), "o_orderkey"
    )
    return G.upsert(current, changes, "id", "o_orderkey")
