"""Result-set evaluation over result tables derived from the driver's tables."""


from pyspark.sql import functions as F

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.base import query, table
from loomgraph.operators import aggregate as A
from loomgraph.operators import joins as J
from loomgraph.operators import resultsets as E

# gold: per customer, priority x status counts; pred: depends on the customer's segment
_GOLD = """SELECT o_custkey AS qid, o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS VARCHAR) AS c FROM orders GROUP BY 1, 2, 3"""
_PRED = """SELECT qid, CASE seg WHEN 'BUILDING' THEN c WHEN 'AUTOMOBILE' THEN b ELSE a END AS a,
    CASE seg WHEN 'BUILDING' THEN a WHEN 'AUTOMOBILE' THEN b ELSE b END AS b,
    CASE seg WHEN 'BUILDING' THEN b WHEN 'MACHINERY' THEN CASE WHEN b = 'F' THEN '9' ELSE c END ELSE c END AS c
    FROM (SELECT g.*, c_mktsegment AS seg FROM gold g JOIN customer ON c_custkey = g.qid) WHERE NOT (seg = 'HOUSEHOLD' AND b = 'P')"""
_CTES = {"gold": _GOLD, "pred": _PRED}


def _gold(spark, path):
    return table(spark, path, "orders").groupBy(
        F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")
    ).agg(F.count("*").cast("string").alias("c"))


def _pred(spark, path):
    seg = table(spark, path, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("seg"))
    g = _gold(spark, path).join(seg, "qid").filter(~((F.col("seg") == "HOUSEHOLD") & (F.col("b") == "P")))
    is_b, is_a = F.col("seg") == "BUILDING", F.col("seg") == "AUTOMOBILE"
    wrong = (F.col("seg") == "MACHINERY") & (F.col("b") == "F")
    return g.select(
        "qid",
        F.when(is_b, F.col("c")).when(is_a, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(is_b, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(is_b, F.col("b")).when(wrong, "9").otherwise(F.col("c")).alias("c"),
    )


def _results(spark, path):
    g = E.long_results(_gold(spark, path).withColumn("o", F.lit(0)), "qid", "gold", ["a", "b", "c"], "o")
    p = E.long_results(_pred(spark, path).withColumn("o", F.lit(0)), "qid", "pred", ["a", "b", "c"], "o")
    return g.unionByName(p)


def _queries(spark, path):
    cust = table(spark, path, "customer")
    return cust.select(
        F.col("c_custkey").alias("qid"),
        F.col("c_name").alias("gold_text"),
        F.when(F.col("c_acctbal") > 9000, F.col("c_name")).otherwise(F.concat(F.lit("p "), "c_name")).alias("pred_text"),
        F.lit(True).alias("gold_ok"),
        (F.col("c_acctbal") > 0).alias("pred_ok"),
    )


_ORDERS = ["a, b, c", "a, c, b", "b, a, c", "b, c, a", "c, a, b", "c, b, a"]


def _bag(cols: str, src: str) -> str:
    key = " || '|' || ".join(cols.split(", "))
    return f"SELECT qid, string_agg({key}, ';' ORDER BY {key}) AS bag FROM {src} GROUP BY 1"


_EQUAL = "SELECT qid, 1 AS eq FROM (" + " UNION ALL ".join(f"SELECT g.qid FROM ({_bag('a, b, c', 'gold')}) g JOIN ({_bag(o, 'pred')}) p ON g.qid = p.qid AND g.bag = p.bag" for o in _ORDERS) + ") GROUP BY 1"


@query(
    "e02_execution_accuracy",
    """SELECT c_custkey AS qid, CASE WHEN c_acctbal > 9000 THEN 1 WHEN c_acctbal <= 0 THEN 0 WHEN coalesce(gn, 0) = 0 AND coalesce(pn, 0) = 0 THEN 1
         ELSE coalesce(eq, 0) END AS ex, coalesce(gn, 0) AS gold_rows, coalesce(pn, 0) AS pred_rows FROM customer
       LEFT JOIN (SELECT qid, count(*) AS gn FROM gold GROUP BY 1) g ON g.qid = c_custkey
       LEFT JOIN (SELECT qid, count(*) AS pn FROM pred GROUP BY 1) p ON p.qid = c_custkey LEFT JOIN equal e ON e.qid = c_custkey""",
    {**_CTES, "equal": _EQUAL},
)
def execution_accuracy(spark, path):
    return E.execution_accuracy(_queries(spark, path), _results(spark, path))


@query(
    "e01_canonical_values",
    """SELECT vec_id, '[' || array_to_string(list_sort(list_transform(embedding::DOUBLE[], lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR))), ',') || ']' AS v,
       '{a=' || label || ',b=' || vec_id || '}' AS m FROM embeddings""",
)
def canonical_values(spark, path):
    vec = table(spark, path, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("bigint")).alias("v"),
        F.create_map(F.lit("b"), F.col("vec_id"), F.lit("a"), F.col("label").cast("bigint")).alias("m"),
    )
    return vec.select("vec_id", E.canonical_text(vec, "v").alias("v"), E.canonical_text(vec, "m").alias("m"))


@query(
    "e01_typed_values",
    """SELECT event_id, true AS int_float, false AS int_text, value <> round(value) AS differs, k = 1 AS int_bool FROM
       (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def typed_values(spark, path):
    """Numbers agree across their types, never with text."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    ev = table(spark, path, "events").select(
        "event_id", k.alias("i"), k.cast("double").alias("d"), k.cast("string").alias("s"), "value",
        F.round("value").cast("bigint").alias("r"), F.lit(True).alias("b"),
    )
    text = {c: E.canonical_text(ev, c) for c in ("i", "d", "s", "value", "r", "b")}
    return ev.select(
        "event_id",
        (text["i"] == text["d"]).alias("int_float"),
        (text["i"] == text["s"]).alias("int_text"),
        (text["value"] != text["r"]).alias("differs"),
        (text["i"] == text["b"]).alias("int_bool"),
    )


@query(
    "e01_normal_numbers",
    """SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b, event_type AS c FROM events""",
)
def normal_numbers(spark, path):
    k = F.get_json_object("props", "$.k")
    ev = table(spark, path, "events")
    return ev.select(
        "event_id",
        E.normal_number(F.concat(F.lit(" 0"), k)).alias("a"),
        E.normal_number(F.concat(k, F.lit(".0"))).alias("b"),
        E.normal_number(F.col("event_type")).alias("c"),
    )


@query(
    "e03_quick_reject",
    """SELECT qid, max(CASE WHEN s < 2 THEN 1 ELSE 0 END) AS rejected FROM (SELECT qid, k, count(DISTINCT side) AS s FROM
       (SELECT qid, 'g' AS side, list_sort([a, b, c]) AS k FROM gold UNION ALL SELECT qid, 'p', list_sort([a, b, c]) FROM pred) GROUP BY 1, 2) GROUP BY 1""",
    _CTES,
)
def quick_reject(spark, path):
    return E.quick_reject(_results(spark, path))


_CELLS = """SELECT DISTINCT qid, side, col, v FROM (SELECT qid, 'gold' AS side, unnest([0, 1, 2]) AS col, unnest([a, b, c]) AS v FROM gold
    UNION ALL SELECT qid, 'pred', unnest([0, 1, 2]), unnest([a, b, c]) FROM pred)"""


@query(
    "e04_column_candidates",
    """SELECT h.qid, gold_col, h.pred_col FROM (SELECT p.qid, g.col AS gold_col, p.col AS pred_col, count(*) AS have FROM cells p JOIN cells g
         ON g.qid = p.qid AND g.v = p.v AND g.side = 'gold' AND p.side = 'pred' GROUP BY 1, 2, 3) h
       JOIN (SELECT qid, col AS pred_col, count(*) AS need FROM cells WHERE side = 'pred' GROUP BY 1, 2) n
         ON n.qid = h.qid AND n.pred_col = h.pred_col AND have = need""",
    {**_CTES, "cells": _CELLS},
)
def column_candidates(spark, path):
    return E.column_candidates(_results(spark, path))


def _numbered(df, *order):
    from pyspark.sql import Window

    return df.withColumn("o", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def _tool_results(spark, path, gold_columns):
    """Gold with some of its columns, tool rows with all three; machinery counts differ."""
    g = E.long_results(_numbered(_gold(spark, path), "a", "b"), "qid", "gold", gold_columns, "o")
    p = E.long_results(_numbered(_pred(spark, path), "b", "a", "c"), "qid", "pred", ["a", "b", "c"], "o")
    return g.unionByName(p)


def _in_order(gold_columns: str) -> str:
    """Gold rows in order, each taking the first free tool row that holds its values."""
    return f"""WITH RECURSIVE g AS (SELECT qid, [{gold_columns}] AS v, row_number() OVER (PARTITION BY qid ORDER BY a, b) AS rn FROM gold),
    p AS (SELECT qid, [a, b, c] AS v, row_number() OVER (PARTITION BY qid ORDER BY b, a, c) AS rn FROM pred),
    sizes AS (SELECT qid, count(*) FILTER (side = 'g') AS gn, count(*) FILTER (side = 'p') AS pn
        FROM (SELECT qid, 'g' AS side FROM g UNION ALL SELECT qid, 'p' FROM p) GROUP BY 1),
    go AS (SELECT qid, 0::BIGINT AS i, []::BIGINT[] AS used, true AS ok FROM sizes WHERE gn = pn
        UNION ALL SELECT qid, i, list_append(used, hit), hit IS NOT NULL FROM
            (SELECT go.qid, go.i + 1 AS i, go.used, (SELECT min(p.rn) FROM p WHERE p.qid = go.qid AND list_has_all(p.v, g.v) AND NOT list_contains(go.used, p.rn)) AS hit
             FROM go JOIN g ON g.qid = go.qid AND g.rn = go.i + 1 WHERE go.ok))
    SELECT qid, CASE WHEN gn = pn AND bool_and(ok) THEN 1 ELSE 0 END AS match FROM sizes LEFT JOIN go USING (qid) GROUP BY qid, gn, pn"""


def _with_recursive(body: str) -> str:
    return body.replace("WITH RECURSIVE ", f"WITH RECURSIVE gold AS ({_GOLD}), pred AS ({_PRED}), ", 1)


@query("e05_lenient_match", _with_recursive(_in_order("a, c")))
def lenient_match(spark, path):
    return E.lenient_match(_tool_results(spark, path, ["a", "c"]))


@query("e05_lenient_equal_width", _with_recursive(_in_order("a, b, c")))
def lenient_equal_width(spark, path):
    return E.lenient_match(_tool_results(spark, path, ["a", "b", "c"]))


@query(
    "e05_lenient_ordered",
    """SELECT coalesce(g.qid, p.qid) AS qid, CASE WHEN bool_and(g.qid IS NOT NULL AND p.qid IS NOT NULL AND list_contains(p.vals, g.a) AND list_contains(p.vals, g.c)) THEN 1 ELSE 0 END AS match
       FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY a, b) AS rn FROM gold) g
       FULL JOIN (SELECT qid, [x.a, x.b, x.c] AS vals, rn FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY b, a, c) AS rn FROM pred) x) p
         ON p.qid = g.qid AND p.rn = g.rn GROUP BY 1""",
    _CTES,
)
def lenient_ordered(spark, path):
    from pyspark.sql import Window

    g = _gold(spark, path).withColumn("o", F.row_number().over(Window.partitionBy("qid").orderBy("a", "b")))
    p = _pred(spark, path).withColumn("o", F.row_number().over(Window.partitionBy("qid").orderBy("b", "a", "c")))
    res = E.long_results(g, "qid", "gold", ["a", "c"], "o").unionByName(E.long_results(p, "qid", "pred", ["a", "b", "c"], "o"))
    return E.lenient_match_ordered(res)


@query(
    "e06_semantic_match",
    """SELECT qid, gn AS gold_rows, pn AS pred_rows, m AS matched, round(r, 6) AS recall, round(p, 6) AS precision,
         round(CASE WHEN p + r > 0 AND NOT (gn = 0 AND pn > 0) THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CASE WHEN r >= 0.8 THEN 1 ELSE 0 END AS semantic_match FROM
       (SELECT *, CASE WHEN gn = 0 THEN 1.0::DOUBLE ELSE m / gn END AS r, CASE WHEN gn = 0 AND pn = 0 THEN 1.0::DOUBLE WHEN gn = 0 OR pn = 0 THEN 0.0 ELSE m / pn END AS p FROM
         (SELECT c_custkey AS qid, (SELECT count(*) FROM gold g WHERE g.qid = c_custkey) AS gn, (SELECT count(*) FROM pred p WHERE p.qid = c_custkey) AS pn,
           (SELECT count(*) FROM gold g WHERE g.qid = c_custkey AND EXISTS (SELECT 1 FROM pred p WHERE p.qid = g.qid
              AND list_has_all([p.a, p.b, p.c], [g.a, g.b, g.c]))) AS m FROM customer))""",
    _CTES,
)
def semantic_match(spark, path):
    out = E.semantic_match(_results(spark, path), _queries(spark, path))
    return out.select(
        "qid", "gold_rows", "pred_rows", "matched", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")], "semantic_match"
    )


@query(
    "e07_provenance_similarity",
    """SELECT c_custkey AS qid, round(CASE WHEN c_acctbal > 9000 THEN 1.0 WHEN c_acctbal <= 0 THEN 0.0 ELSE coalesce(j, 0) END, 6) AS psjs FROM customer LEFT JOIN
       (SELECT qid, sum(a * b) / count(*) AS j FROM (SELECT o_custkey AS qid, l_suppkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS a,
          max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          WHERE l_returnflag = 'R' OR l_linestatus = 'F' GROUP BY 1, 2) GROUP BY 1) ON qid = c_custkey""",
)
def provenance(spark, path):
    orders = table(spark, path, "orders").select("o_orderkey", F.col("o_custkey").alias("qid"))
    line = table(spark, path, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    g = line.filter("l_returnflag = 'R'").select("qid", F.lit("gold").alias("side"), F.col("l_suppkey").alias("node_id"))
    p = line.filter("l_linestatus = 'F'").select("qid", F.lit("pred").alias("side"), F.col("l_suppkey").alias("node_id"))
    out = E.provenance_similarity(g.unionByName(p), _queries(spark, path))
    return out.withColumn("psjs", F.round("psjs", 6))


@query(
    "e08_evaluation_report",
    """SELECT event_type AS model, count(*) AS total, round(avg(CASE WHEN k > 50 THEN 1 ELSE 0 END), 6) AS execution_accuracy,
       round(avg(CASE WHEN k > 5 THEN 1 ELSE 0 END), 6) AS executable_rate, round(avg(CASE WHEN k > 40 THEN 1 ELSE 0 END), 6) AS semantic_rate,
       round(avg(CASE WHEN k <= 2 THEN 1 ELSE 0 END), 6) AS syntax_error_rate, round(avg(CASE WHEN k = 3 THEN 1 ELSE 0 END), 6) AS timeout_rate,
       round(avg(k / 100), 6) AS psjs, round(avg(value), 6) AS latency_mean, round(quantile_cont(value, 0.5), 6) AS latency_p50,
       round(quantile_cont(value, 0.99), 6) AS latency_p99, round(avg(k), 6) AS input_tokens, round(avg(user_id), 6) AS output_tokens FROM
       (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""",
)
def evaluation_report(spark, path):
    k = F.get_json_object("props", "$.k").cast("bigint")
    message = F.when(k <= 2, "SyntaxError near x").when(k == 3, "Timeout reached").when(k <= 5, "boom")
    rows = table(spark, path, "events").select(
        F.col("event_type").alias("model"),
        F.when(k > 50, 1).otherwise(0).alias("ex"),
        (k > 5).alias("executable"),
        F.when(k > 40, 1).otherwise(0).alias("semantic_match"),
        F.when(message.isNotNull(), E.error_class(message)).alias("error_type"),
        (k / 100).alias("psjs"),
        F.col("value").alias("latency_ms"),
        k.alias("input_tokens"),
        F.col("user_id").alias("output_tokens"),
    )
    out = E.evaluation_report(rows)
    return out.select("model", "total", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("model", "total")])


@query(
    "e09_error_class",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'syntax') OR contains(lower(text), 'thth') THEN 'x' ELSE 'y' END AS has,
       CASE WHEN n_chars > 3000 THEN 'syntax_error' WHEN n_chars > 1000 THEN 'timeout' ELSE 'execution_error' END AS class FROM documents""",
)
def error_class(spark, path):
    docs = table(spark, path, "documents")
    msg = F.when(F.col("n_chars") > 3000, "a SYNTAX error").when(F.col("n_chars") > 1000, "TimeOut after 9 s").otherwise("other")
    has = F.when(F.lower("text").contains("syntax") | F.lower("text").contains("thth"), "x").otherwise("y")
    return docs.select("doc_id", has.alias("has"), E.error_class(msg).alias("class"))


_QTEXT = """SELECT p_partkey AS qid, 'MATCH (p)-[:' || p_type || ']->(a)' || repeat('<-[r:X]-(b)', p_size % 3) ||
    CASE WHEN p_size > 35 THEN ' RETURN a.name, count(p) AS n ORDER BY n DESC LIMIT 5' WHEN p_size > 20 THEN ' WITH substring(p.d, 0, 4) AS year, p RETURN year, COUNT (p)'
    WHEN p_size > 10 THEN ' RETURN count(DISTINCT p)' WHEN p_size > 5 THEN ' RETURN p.application_no, p.Title' ELSE ' RETURN p.x' END AS text, p_size, p_type FROM part"""


def _qtext(spark, path):
    size = F.col("p_size")
    tail = (
        F.when(size > 35, " RETURN a.name, count(p) AS n ORDER BY n DESC LIMIT 5")
        .when(size > 20, " WITH substring(p.d, 0, 4) AS year, p RETURN year, COUNT (p)")
        .when(size > 10, " RETURN count(DISTINCT p)")
        .when(size > 5, " RETURN p.application_no, p.Title")
        .otherwise(" RETURN p.x")
    )
    text = F.concat(F.lit("MATCH (p)-[:"), "p_type", F.lit("]->(a)"), F.repeat(F.lit("<-[r:X]-(b)"), size % 3), tail)
    return table(spark, path, "part").select(F.col("p_partkey").alias("qid"), text.alias("text"), "p_size", "p_type")


_DIMS = {"topic": [":PROMO", ":small"], "size": ["economy", r"\]->\(a\)<-"], "time": ["YEAR"]}


@query(
    "e10_query_features",
    """SELECT qid, concat_ws(',', CASE WHEN p_type = 'ECONOMY' OR p_size % 3 > 0 THEN 'size' END, CASE WHEN p_size BETWEEN 21 AND 35 THEN 'time' END,
         CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'topic' END) AS dims,
       1 + p_size % 3 AS hops, CASE WHEN p_size > 35 THEN 'ranking' WHEN p_size > 20 THEN 'trend' WHEN p_size > 10 THEN 'count' ELSE 'list' END AS kind FROM q""",
    {"q": _QTEXT},
)
def query_features(spark, path):
    text = F.col("text")
    return _qtext(spark, path).select(
        "qid", F.array_join(E.dimensions(text, _DIMS), ",").alias("dims"), E.hop_count(text).alias("hops"), E.query_type(text).alias("kind")
    )


@query(
    "e11_expected_tool",
    """SELECT qid, CASE WHEN p_size > 35 THEN 'count_patents' WHEN p_size > 20 THEN 'trend_patents' WHEN p_size > 10 THEN 'count_patents'
       WHEN p_size > 5 THEN 'get_patent_detail' ELSE 'query_patents' END AS tool FROM q""",
    {"q": _QTEXT},
)
def expected_tool(spark, path):
    return _qtext(spark, path).select("qid", E.expected_tool(F.col("text")).alias("tool"))


@query(
    "e12_consistency_vote",
    """SELECT qid, first(text ORDER BY votes DESC, first_pos) AS text, CAST(first(h ORDER BY votes DESC, first_pos) AS VARCHAR) AS result_hash,
       first(votes ORDER BY votes DESC, first_pos) AS votes FROM
       (SELECT user_id AS qid, event_type AS h, count(*) AS votes, min(event_id) AS first_pos, CAST(min(event_id) AS VARCHAR) AS text FROM events
        WHERE value > 5 GROUP BY 1, 2) GROUP BY 1""",
)
def consistency_vote(spark, path):
    ev = table(spark, path, "events").select(
        F.col("user_id").alias("qid"),
        F.col("event_id").alias("pos"),
        F.col("event_id").cast("string").alias("text"),
        (F.col("value") > 5).alias("ok"),
        F.col("event_type").alias("result_hash"),
    )
    return E.consistency_vote(ev)


@query(
    "e12_result_hash_groups",
    """SELECT count(*) AS users, count(DISTINCT h) AS distinct_results FROM (SELECT o_custkey, string_agg(o_orderstatus || o_orderpriority, ',' ORDER BY o_orderstatus || o_orderpriority) AS h
       FROM orders GROUP BY 1)""",
)
def result_hash_groups(spark, path):
    rows = table(spark, path, "orders").select(F.col("o_custkey").alias("qid"), F.lit(0).alias("pos"), F.concat("o_orderstatus", "o_orderpriority").alias("row_text"))
    return E.result_hash(rows).agg(F.count("*").alias("users"), F.count_distinct("result_hash").alias("distinct_results"))


_SPECS = [
    ("s1", {"org_type": "BUILDING", "domain": "PROMO Brand#13", "year_start": "1997"}),
    ("s2", {"location_country": "ASIA", "legal_status": "F", "has_transfer": True}),
    ("s3", {"org_type": "MACHINERY", "legal_status": "P", "domain_in": ["SMALL Brand#4", "LARGE Brand#2"]}),
]
_DIM_GROUPS = {"technical": {"topic", "code"}, "legal": {"status", "family"}, "business": {"activity", "litigation"}}
_S = {
    "s1": "party_type = 'BUILDING' AND substr(item_date, 1, 4) >= '1997'",
    "s2": "place_country = 'ASIA'",
    "s3": "party_type = 'MACHINERY'",
}
_T = {"s1": "('PROMO Brand#13')", "s3": "('SMALL Brand#4', 'LARGE Brand#2')"}


def _spec_sql(qid: str, without: str | None) -> str:
    conds = [_S[qid]]
    if qid in _T and without != "technical":
        conds.append(f"EXISTS (SELECT 1 FROM topic t WHERE t.item_id = i.item_id AND topic_name IN {_T[qid]})")
    status = {"s2": "F", "s3": "P"}.get(qid)
    if status and without != "legal":
        conds.append(f"EXISTS (SELECT 1 FROM status s WHERE s.item_id = i.item_id AND status_name = '{status}')")
    if qid == "s2" and without != "business":
        conds.append("transfer_count > 0")
    return f"SELECT i.item_id FROM citems i JOIN party p ON p.item_id = i.item_id WHERE {' AND '.join(conds)}"


_USES = [("technical", "s1"), ("technical", "s3"), ("legal", "s2"), ("legal", "s3"), ("business", "s2")]
_PER_QUERY = " UNION ALL ".join(
    f"SELECT '{d}' AS dim, (SELECT count(*) FROM ({_spec_sql(s, None)})) AS g, (SELECT count(*) FROM ({_spec_sql(s, d)})) AS r" for d, s in _USES
)


@query(
    "e13_relaxation_report",
    f"""SELECT dim, count(*) AS total, count(*) FILTER (r > g) AS violations, round(count(*) FILTER (r > g) * 100.0 / count(*), 6)::DOUBLE AS violation_pct,
        round(avg(r / nullif(g, 0)), 6) AS avg_inflation FROM ({_PER_QUERY}) GROUP BY 1""",
)
def relaxation_report(spark, path):
    out = E.relaxation_report(OrdersBinding(spark, path), _SPECS, _DIM_GROUPS)
    return out.withColumn("violation_pct", F.round("violation_pct", 6)).withColumn("avg_inflation", F.round("avg_inflation", 6))


@query(
    "e14_retrieval_scores",
    """SELECT method, n_dims, count(*) AS queries, round(avg(CASE WHEN f = 0 THEN 0 ELSE tp / f END), 6) AS precision, round(avg(tp / gold), 6) AS recall FROM
       (SELECT c_custkey AS qid, c_nationkey % 3 AS n_dims, m.method, (SELECT count(*) FROM g WHERE g.qid = c_custkey) AS gold,
          (SELECT count(*) FROM fnd WHERE fnd.qid = c_custkey AND fnd.method = m.method) AS f,
          (SELECT count(*) FROM fnd JOIN g ON g.qid = fnd.qid AND g.v = fnd.v WHERE fnd.qid = c_custkey AND fnd.method = m.method) AS tp
        FROM customer, (VALUES ('O'), ('P')) m(method)) WHERE gold > 0 GROUP BY 1, 2""",
    {
        "g": "SELECT DISTINCT o_custkey AS qid, o_orderpriority AS v FROM orders WHERE o_orderstatus = 'F'",
        "fnd": "SELECT DISTINCT o_custkey AS qid, o_orderpriority AS v, o_orderstatus AS method FROM orders WHERE o_orderstatus <> 'F'",
    },
)
def retrieval_scores(spark, path):
    orders = table(spark, path, "orders").select(
        F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("node_id"), F.col("o_orderstatus").alias("method")
    )
    queries = table(spark, path, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_nationkey") % 3).alias("n_dims"))
    out = E.retrieval_scores(orders.filter("method <> 'F'"), orders.filter("method = 'F'").select("qid", "node_id"), queries)
    return out.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(
    "e15_out_of_template",
    """SELECT qid, p_type AS relations, CASE WHEN p_size > 45 THEN 'UNWIND' ELSE '' END AS operators, 1 AS is_oot FROM q""",
    {"q": _QTEXT},
)
def out_of_template(spark, path):
    text = F.when(F.col("p_size") > 45, F.concat("text", F.lit(" UNWIND x"))).otherwise(F.col("text"))
    oot = _qtext(spark, path).select("qid", E.out_of_template(text).alias("o"))
    return oot.select("qid", F.array_join("o.relations", ",").alias("relations"), F.array_join("o.operators", ",").alias("operators"), F.col("o.is_oot").cast("int").alias("is_oot"))


@query(
    "e16_diversity",
    """SELECT round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length,
       round(count(DISTINCT substr(text, 1, 4)) / count(*), 6) AS unique_start_ratio FROM documents""",
)
def diversity(spark, path):
    out = E.diversity(table(spark, path, "documents"), "text")
    return out.withColumn("avg_length", F.round("avg_length", 6)).withColumn("unique_start_ratio", F.round("unique_start_ratio", 6))


@query("e16_top_prefixes", "SELECT substr(text, 1, 4) AS start, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, start LIMIT 10")
def top_prefixes(spark, path):
    return E.top_prefixes(table(spark, path, "documents"), "text")


@query(
    "e16_word_shares",
    """SELECT word, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6)::DOUBLE AS share FROM
       (SELECT unnest(['the', 'thing', 'und', 'elle']) AS word, text FROM documents) WHERE contains(text, word) GROUP BY 1""",
)
def word_shares(spark, path):
    return E.word_shares(table(spark, path, "documents"), "text", ["the", "thing", "und", "elle"]).withColumn("share", F.round("share", 6))


@query(
    "e16_coverage_by_relation",
    "SELECT rel, count(*) AS n FROM (SELECT qid, unnest(regexp_extract_all(text, '\\[:([A-Z_]+)\\]', 1)) AS rel FROM q) GROUP BY 1",
    {"q": _QTEXT},
)
def coverage(spark, path):
    rel = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[:([A-Z_]+)\]"), F.lit(1))))
    return _qtext(spark, path).select(rel.alias("rel")).groupBy("rel").agg(F.count("*").alias("n"))


@query(
    "e17_case_studies",
    "SELECT p_partkey AS qid, p_size % 5 AS n_dims, p_size % 3 AS hops FROM part WHERE p_size > 20 AND p_retailprice <= 1000 AND p_size % 5 >= 2 ORDER BY n_dims DESC, hops DESC, qid LIMIT 25",
)
def case_studies(spark, path):
    size = F.col("p_size")
    rows = table(spark, path, "part").select(
        F.col("p_partkey").alias("qid"),
        (size > 20).alias("a_correct"),
        (F.col("p_retailprice") > 1000).alias("b_correct"),
        (size % 5).alias("n_dims"),
        (size % 3).alias("hops"),
    )
    return E.case_studies(rows, 25).select("qid", "n_dims", "hops")


@query(
    "l04_case_ranking",
    "SELECT p_partkey AS qid, p_size % 7 AS n_dims, p_size % 4 AS hops FROM part ORDER BY n_dims DESC, hops DESC, qid LIMIT 50",
)
def case_ranking(spark, path):
    rows = table(spark, path, "part").select(F.col("p_partkey").alias("qid"), (F.col("p_size") % 7).alias("n_dims"), (F.col("p_size") % 4).alias("hops"))
    return rows.orderBy(F.desc("n_dims"), F.desc("hops"), "qid").limit(50)


@query(
    "e18_gold_answers",
    " UNION ALL ".join(f"SELECT '{s}' AS qid, 1 AS success, (SELECT count(*) FROM ({_spec_sql(s, None)})) AS row_count" for s, _ in _SPECS)
    + " UNION ALL SELECT 'bad', 0, 0",
)
def gold_answers(spark, path):
    return E.materialise_answers(OrdersBinding(spark, path), [*_SPECS, ("bad", {"no_such_key": 1})])


_FEAT = "SELECT qid, 1 + p_size % 3 AS hops, CASE WHEN p_size > 35 THEN 'ranking' WHEN p_size > 20 THEN 'trend' WHEN p_size > 10 THEN 'count' ELSE 'list' END AS kind, p_type, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS ok FROM q"


@query(
    "a15_stratified_accuracy",
    " UNION ALL ".join(
        f"SELECT '{c}' AS stratum, CAST({c} AS VARCHAR) AS value, count(*) AS total, CAST(sum(ok) AS BIGINT) AS correct, round(sum(ok) * 100.0 / count(*), 6)::DOUBLE AS rate FROM feat GROUP BY {c}"
        for c in ("hops", "kind", "p_type")
    ),
    {"q": _QTEXT, "feat": _FEAT},
)
def stratified_accuracy(spark, path):
    text = F.col("text")
    rows = _qtext(spark, path).select(E.hop_count(text).alias("hops"), E.query_type(text).alias("kind"), "p_type", (F.col("p_size") > 25).alias("ok"))
    return A.stratified_accuracy(rows, "ok", ["hops", "kind", "p_type"])


@query(
    "a16_size_buckets",
    """SELECT c_mktsegment AS family, count(*) AS total, count(*) FILTER (c_acctbal <= 0) AS failed, count(*) FILTER (c_acctbal > 0 AND n = 0) AS empty,
       count(*) FILTER (c_acctbal > 0 AND n BETWEEN 1 AND 5) AS small, count(*) FILTER (c_acctbal > 0 AND n BETWEEN 6 AND 20) AS medium,
       count(*) FILTER (c_acctbal > 0 AND n > 20) AS large FROM (SELECT *, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) GROUP BY 1""",
)
def size_buckets(spark, path):
    n = table(spark, path, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("result_count"))
    rows = table(spark, path, "customer").join(n, "c_custkey", "left").na.fill(0, ["result_count"])
    return A.size_buckets(rows.select(F.col("c_mktsegment").alias("family"), (F.col("c_acctbal") > 0).alias("valid"), "result_count"))


@query(
    "j14_align_predictions",
    "SELECT g.qid, g.n AS gold_n, p.n AS pred_n FROM (SELECT qid, count(*) AS n FROM gold GROUP BY 1) g LEFT JOIN (SELECT qid, count(*) AS n FROM pred GROUP BY 1) p ON p.qid = g.qid",
    _CTES,
)
def align_predictions(spark, path):
    g = _gold(spark, path).groupBy("qid").agg(F.count("*").alias("n"))
    p = _pred(spark, path).groupBy("qid").agg(F.count("*").alias("n"))
    return J.align(p, g, "qid", "left")


