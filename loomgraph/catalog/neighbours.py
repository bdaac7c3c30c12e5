"""Pattern matches, item detail, co-parties and hierarchies over the orders graph."""

from pyspark.sql import functions as F

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.base import query, table
from loomgraph.operators import joins as J
from loomgraph.operators.filters import filtered_items


@query(
    "j01_one_hop",
    "SELECT topic_parent, count(*) AS rows, count(DISTINCT item_id) AS items FROM topic GROUP BY 1",
)
def one_hop(spark, path):
    rel = OrdersBinding(spark, path).relation("topic", distinct=True)
    return rel.groupBy("topic_parent").agg(F.count("*").alias("rows"), F.countDistinct("item_id").alias("items"))


@query(
    "j02_two_hops",
    """SELECT place_country, place_province, count(DISTINCT item_id) AS items FROM party
       WHERE place_province IS NOT NULL AND place_province <> '' GROUP BY 1, 2""",
)
def two_hops(spark, path):
    rel = OrdersBinding(spark, path).relation("party", place=True)
    rel = rel.filter(F.col("place_province").isNotNull() & (F.col("place_province") != ""))
    return rel.groupBy("place_country", "place_province").agg(F.countDistinct("item_id").alias("items"))


@query(
    "j03_star",
    """SELECT party_name, topic_name, count(DISTINCT p.item_id) AS items FROM party p JOIN topic t ON t.item_id = p.item_id
       JOIN status s ON s.item_id = p.item_id JOIN country c ON c.item_id = p.item_id
       WHERE status_name = 'F' AND country_name = 'EUROPE' AND topic_parent = 'PROMO'
       AND EXISTS (SELECT 1 FROM activity a WHERE a.item_id = p.item_id AND rel_type = 'LICENSED_TO') GROUP BY 1, 2""",
)
def star(spark, path):
    g = OrdersBinding(spark, path)
    items = filtered_items(g, {"legal_status": "F", "country": "EUROPE"}, keep="topic").filter("topic_parent = 'PROMO'")
    licensed = g.relation("activity").filter("rel_type = 'LICENSED_TO'").select("item_id")
    rows = items.join(licensed, "item_id", "left_semi").join(g.relation("party"), "item_id")
    return rows.groupBy("party_name", "topic_name").agg(F.countDistinct("item_id").alias("items"))


@query(
    "j04_optional_neighbours",
    """SELECT i.item_id, (SELECT string_agg(party_name, ';' ORDER BY party_name) FROM
         (SELECT DISTINCT party_name FROM activity a WHERE a.item_id = i.item_id AND rel_type = 'TRANSFERRED_TO'
          ORDER BY party_name LIMIT 2)) AS names FROM items i""",
)
def optional_neighbours(spark, path):
    g = OrdersBinding(spark, path)
    rel = g.relation("activity").filter("rel_type = 'TRANSFERRED_TO'")
    rows = J.with_neighbours(g.items().select("item_id"), rel, "party_name", "names", 2)
    return rows.withColumn("names", F.array_join("names", ";"))


def _names(rel: str) -> str:
    return f"coalesce(string_agg(DISTINCT dst_name, ';' ORDER BY dst_name) FILTER (rel_type = '{rel}'), '')"


@query(
    "j05_item_detail",
    f"""SELECT src_id AS item_id, {_names("APPLIED_BY")} AS applicants, {_names("OWNED_BY")} AS owners,
        {_names("TRANSFERRED_FROM")} AS transferors, {_names("TRANSFERRED_TO")} AS transferees, {_names("LICENSED_FROM")} AS licensors,
        {_names("LICENSED_TO")} AS licensees, {_names("PLEDGED_TO")} AS pledgees, {_names("BELONGS_TO")} AS topics,
        {_names("CLASSIFIED_AS")} AS codes, {_names("HAS_STATUS")} AS statuses, {_names("PUBLISHED_IN")} AS countries,
        {_names("IN_FAMILY")} AS families,
        coalesce(string_agg(DISTINCT dst_name || ':' || role, ';' ORDER BY dst_name || ':' || role) FILTER (rel_type = 'LITIGATED_WITH'), '') AS litigations
        FROM edges GROUP BY 1""",
)
def item_detail(spark, path):
    g = OrdersBinding(spark, path)
    return J.item_detail(g, g.items().select("item_id"))


@query(
    "j06_collaboration",
    """SELECT a.party_name AS organization, b.party_name AS partner_name, count(DISTINCT a.item_id) AS collab_count
       FROM per a JOIN per b ON a.item_id = b.item_id AND a.party_id <> b.party_id WHERE contains(a.party_name, '#00000000')
       GROUP BY 1, 2 ORDER BY collab_count DESC, 1, 2 LIMIT 20""",
    {"per": "SELECT item_id, party_id, person_name AS party_name FROM person"},
)
def collaboration(spark, path):
    rel = OrdersBinding(spark, path).relation("person", distinct=True)
    rel = rel.select("item_id", "party_id", F.col("person_name").alias("party_name"))
    return J.collaboration(rel, "#00000000", limit=20)


@query(
    "j07_anti_pattern",
    """SELECT i.item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM activity a WHERE a.item_id = i.item_id AND rel_type = 'TRANSFERRED_TO')""",
)
def anti_pattern(spark, path):
    g = OrdersBinding(spark, path)
    rel = g.relation("activity").filter("rel_type = 'TRANSFERRED_TO'").select("item_id")
    return g.items().select("item_id").join(rel, "item_id", "left_anti")


@query(
    "j08_two_roles",
    """SELECT l.item_id, l.party_name AS l_name, r.party_name AS r_name FROM activity l JOIN activity r ON l.item_id = r.item_id
       AND l.party_id <> r.party_id WHERE l.rel_type = 'TRANSFERRED_FROM' AND contains(l.party_name, '1')
       AND r.rel_type = 'LICENSED_TO' AND contains(r.party_name, '2')""",
)
def two_roles(spark, path):
    rel = OrdersBinding(spark, path).relation("activity", distinct=True)
    return J.two_role_items(rel, ("TRANSFERRED_FROM", "1"), ("LICENSED_TO", "2"))


@query(
    "j09_polymorphic_parties",
    """SELECT c_custkey AS party_id, c_name AS name, 'Organization' AS label FROM customer
       UNION ALL SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name ELSE 'uid-' || s_suppkey END, 'Person' FROM supplier""",
)
def polymorphic(spark, path):
    orgs = table(spark, path, "customer").select(F.col("c_custkey").alias("party_id"), F.col("c_name").alias("name"), F.lit("Organization").alias("label"))
    people = table(spark, path, "supplier").select(
        F.col("s_suppkey").alias("party_id"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"),
        F.concat(F.lit("uid-"), F.col("s_suppkey").cast("string")).alias("uid"),
        F.lit("Person").alias("label"),
    )
    return J.all_parties(orgs, people)


@query(
    "j10_apply_mapping",
    """SELECT doc_id, count(*) AS mentions, count(*) FILTER (w IN (SELECT lang FROM documents)) AS mapped,
       string_agg(CASE WHEN w IN (SELECT lang FROM documents) THEN 'language' ELSE w END, ' ' ORDER BY pos) AS names FROM
       (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM
         (SELECT doc_id, string_split(lang || ' ' || source, ' ') AS ws FROM documents)) GROUP BY 1""",
)
def apply_mapping(spark, path):
    docs = table(spark, path, "documents")
    recs = docs.select("doc_id", F.split(F.concat_ws(" ", "lang", "source"), " ").alias("applicants"))
    mapping = docs.select(
        F.col("lang").alias("original_name"),
        F.lit("language").alias("standard_name"),
        F.lit("person").alias("entity_type"),
        F.lit(None).cast("string").alias("location"),
    ).distinct()
    out = J.apply_mapping(recs, "doc_id", ["applicants"], mapping)
    res = F.col("applicants_resolved")
    return out.select(
        "doc_id",
        F.size(res).cast("bigint").alias("mentions"),
        F.size(F.filter(res, lambda x: x.entity_type == "person")).cast("bigint").alias("mapped"),
        F.array_join(F.transform(res, lambda x: x.standard_name), " ").alias("names"),
    )


@query(
    "j11_build_edges",
    """SELECT rel, count(*) AS n FROM (SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'TRANSFERRED_TO' ELSE 'OWNED_BY' END AS rel,
         l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
         AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) GROUP BY 1""",
)
def build_edges(spark, path):
    mentions = table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("src_id"),
        F.when(F.col("l_returnflag") == "R", "TRANSFERRED_TO").otherwise("OWNED_BY").alias("rel_type"),
        F.lit("Organization").alias("dst_label"),
        F.col("l_suppkey").alias("dst_key"),
        F.lit(None).cast("string").alias("role"),
    )
    items = table(spark, path, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"))
    nodes = table(spark, path, "supplier").filter("s_acctbal > 0").select(F.lit("Organization").alias("dst_label"), F.col("s_suppkey").alias("dst_key"))
    edges = J.build_edges(mentions, items, nodes)
    return edges.groupBy(F.col("rel_type").alias("rel")).agg(F.count("*").alias("n"))


@query(
    "j14_align_runs",
    """SELECT d.doc_id, length(text) AS gold_len, quality AS pred_quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
)
def align_runs(spark, path):
    gold = table(spark, path, "documents").select("doc_id", F.length("text").alias("len"))
    pred = table(spark, path, "labels").select("doc_id", "quality")
    return J.align(pred, gold, "doc_id")


@query(
    "j15_compatible_patterns",
    """SELECT DISTINCT a.p_brand AS match_id, b.p_type AS return_id FROM part a, part b WHERE NOT EXISTS
       (SELECT 1 FROM part x WHERE x.p_brand = a.p_brand AND x.p_type = b.p_type AND x.p_size > 48)""",
)
def compatible_patterns(spark, path):
    part = table(spark, path, "part")
    matches = part.groupBy(F.col("p_brand").alias("match_id")).agg(F.collect_set("p_brand").alias("dims"))
    returns = part.select(F.col("p_type").alias("return_id")).distinct()
    rules = part.filter("p_size > 48").select(F.col("p_brand").alias("dim"), F.col("p_type").alias("return_id")).distinct()
    return J.compatible_patterns(matches, returns, rules)


@query(
    "j16_parent_lookup",
    """SELECT c.topic_name, c.topic_level, c.topic_parent, p.topic_level AS parent_topic_level FROM topics c
       LEFT JOIN topics p ON c.topic_parent = p.topic_name""",
)
def parent_lookup(spark, path):
    return J.with_parent(OrdersBinding(spark, path).topics(), "topic_name", "topic_parent", ["topic_level"])


@query(
    "j16_ancestors",
    """SELECT topic_name AS node, topic_parent AS ancestor, 1 AS distance FROM topics WHERE topic_parent IS NOT NULL
       UNION ALL SELECT a.topic_name, b.topic_parent, 2 FROM topics a JOIN topics b ON a.topic_parent = b.topic_name WHERE b.topic_parent IS NOT NULL""",
)
def ancestors(spark, path):
    return J.ancestors(OrdersBinding(spark, path).topics(), "topic_name", "topic_parent", 3)
