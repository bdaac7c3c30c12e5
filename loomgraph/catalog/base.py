"""Registry and the SQL building blocks that mirror `OrdersBinding`."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# relation name -> SQL; one entry per relation of the orders binding
CTES = {
    "items": """SELECT o_orderkey AS item_id, strftime(o_orderdate, '%Y-%m-%d') AS item_date,
        o_orderpriority AS item_type, 'Order ' || o_orderkey AS title FROM orders""",
    "counters": """SELECT l_orderkey AS item_id,
        count(*) FILTER (l_returnflag = 'R') AS transfer_count,
        count(*) FILTER (l_returnflag = 'A') AS license_count,
        count(*) FILTER (l_returnflag = 'N') AS pledge_count,
        count(*) FILTER (l_quantity >= 45) AS litigation_count FROM lineitem GROUP BY 1""",
    "citems": """SELECT i.*, coalesce(transfer_count, 0) AS transfer_count, coalesce(license_count, 0) AS license_count,
        coalesce(pledge_count, 0) AS pledge_count, coalesce(litigation_count, 0) AS litigation_count
        FROM items i LEFT JOIN counters c ON i.item_id = c.item_id""",
    "places": """SELECT n_nationkey, n_name AS place_name, r_name AS place_country, n_name AS place_province,
        2 AS place_level, r_name || '/' || n_name AS place_path FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "parties": """SELECT c_custkey AS party_id, c_name AS party_name, c_mktsegment AS party_type, p.*
        FROM customer JOIN places p ON c_nationkey = n_nationkey""",
    "party": """SELECT o_orderkey AS item_id, parties.* FROM orders JOIN parties ON o_custkey = party_id""",
    "person": """SELECT DISTINCT l_orderkey AS item_id, s_suppkey AS party_id, s_name AS person_name,
        'Nation ' || s_nationkey AS person_org FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "topic": """SELECT DISTINCT l_orderkey AS item_id, p_type || ' ' || p_brand AS topic_name, 3 AS topic_level,
        p_type AS topic_parent FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "topics": """SELECT DISTINCT p_type || ' ' || p_brand AS topic_name, 3 AS topic_level, p_type AS topic_parent FROM part
        UNION ALL SELECT DISTINCT p_type, 2, 'ALL' FROM part UNION ALL SELECT 'ALL', 1, NULL""",
    "code": """SELECT DISTINCT l_orderkey AS item_id,
        substr(p_type, 1, 1) || lpad(regexp_extract(p_brand, '(\\d+)', 1), 2, '0') || upper(substr(p_name, 1, 1)) || '/' || p_size AS code,
        substr(p_type, 1, 1) AS section FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "status": "SELECT o_orderkey AS item_id, o_orderstatus AS status_name FROM orders",
    "country": "SELECT item_id, place_country AS country_name FROM party",
    "activity": """SELECT DISTINCT l_orderkey AS item_id,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'TRANSFERRED_TO'
             WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'TRANSFERRED_FROM'
             WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'LICENSED_TO'
             WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'LICENSED_FROM'
             WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'PLEDGED_TO'
             WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'OWNED_BY' END AS rel_type,
        s_suppkey AS party_id, s_name AS party_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "litigation": """SELECT DISTINCT l_orderkey AS item_id, s_suppkey AS party_id, s_name AS party_name,
        CASE WHEN l_linestatus = 'O' THEN 'plaintiff' ELSE 'defendant' END AS role
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45""",
    "littype": "SELECT DISTINCT l_orderkey AS item_id, l_returnflag AS type_name FROM lineitem WHERE l_quantity >= 45",
    "family": """SELECT o_orderkey AS item_id, o_custkey || '-' || year(o_orderdate) AS family_id
        FROM orders WHERE o_orderstatus <> 'O'""",
    "edges": """SELECT item_id AS src_id, 'APPLIED_BY' AS rel_type, 'Organization' AS dst_label, party_name AS dst_name, NULL AS role FROM party
        UNION ALL SELECT item_id, 'APPLIED_BY', 'Person', person_name, NULL FROM (SELECT DISTINCT item_id, person_name FROM person)
        UNION ALL SELECT item_id, 'BELONGS_TO', 'Topic', topic_name, NULL FROM topic
        UNION ALL SELECT item_id, 'CLASSIFIED_AS', 'Code', code, NULL FROM code
        UNION ALL SELECT item_id, 'HAS_STATUS', 'Status', status_name, NULL FROM status
        UNION ALL SELECT item_id, 'PUBLISHED_IN', 'Country', country_name, NULL FROM country
        UNION ALL SELECT item_id, rel_type, 'Organization', party_name, NULL FROM activity
        UNION ALL SELECT item_id, 'LITIGATED_WITH', 'Organization', party_name, role FROM litigation
        UNION ALL SELECT item_id, 'HAS_LITIGATION_TYPE', 'LitigationType', type_name, NULL FROM littype
        UNION ALL SELECT item_id, 'IN_FAMILY', 'Family', family_id, NULL FROM family""",
    # one response per event: group = user, score = value, version and length from props.k
    "responses": """SELECT event_id, user_id AS uid, event_type AS source, value AS score, ts,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with exactly the CTEs it mentions, in dependency order."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in known.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + body


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register `fn(spark, path) -> DataFrame` under `name`, with its SQL if there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, ctes)
        return fn

    return add


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")
