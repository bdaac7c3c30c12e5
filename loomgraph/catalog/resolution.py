"""Entity resolution over the driver's names and vectors."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import query, table
from loomgraph.operators import graph as G
from loomgraph.operators import resolution as R
from loomgraph.operators import vectors as V
from loomgraph.runtime import cut_lineage


def _names(spark, path):
    """Every party and part name and every word of the conversations, with how often it occurs."""
    parts = [table(spark, path, t).select(F.col(c).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    words = table(spark, path, "conversations").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("name"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(words)
    return every.filter("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


@query("j12_blocked_similarity")
def blocked_similarity(spark, path):
    return R.similar_in_block(_names(spark, path), 0.95)


@query("j12_unblocked_similarity")
def unblocked_similarity(spark, path):
    return R.similar_in_block(_names(spark, path), 0.95, prefix=0)


@query("j12_neighbour_blocks")
def neighbour_blocks(spark, path):
    return R.similar_across_blocks(_names(spark, path), 0.7)


@query("j12_neighbour_blocks_whole")
def neighbour_blocks_whole(spark, path):
    return R.similar_across_blocks(_names(spark, path), 0.9, head=None)


_UNIT = """SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM
    (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"""
_COS = "list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2]))"
_PAIRS = f"""SELECT qid AS a, vid AS b, score FROM (SELECT a.vec_id AS qid, b.vec_id AS vid, {_COS} AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM unit a JOIN unit b ON a.vec_id <> b.vec_id)
    WHERE rank <= 8 AND vid > qid AND score >= 0.45"""
_CTES = {"unit": _UNIT, "pairs": _PAIRS}


def _pairs(spark, path):
    vec = table(spark, path, "embeddings").select(F.col("vec_id").alias("vid"), "embedding")
    return V.candidate_pairs(vec)


@query("j13_nearest_pairs", "SELECT a, b, round(score, 6) AS score FROM pairs", _CTES)
def nearest_pairs(spark, path):
    return _pairs(spark, path).withColumn("score", F.round("score", 6))


@query(
    "j13_rule_filter",
    r"""SELECT a, b FROM np WHERE least(length(a), length(b)) / greatest(length(a), length(b)) >= 0.5
        AND length(regexp_replace(a, '[\s\d]|[^\p{L}\p{N}\p{M}_]', '', 'g')) >= 2 AND length(regexp_replace(b, '[\s\d]|[^\p{L}\p{N}\p{M}_]', '', 'g')) >= 2""",
    {"np": "SELECT p_name AS a, p_type || CASE WHEN p_size > 25 THEN ' ' || p_brand ELSE '' END AS b FROM part"},
)
def rule_filter(spark, path):
    tail = F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_brand")).otherwise("")
    return R.rule_filter(table(spark, path, "part").select(F.col("p_name").alias("a"), F.concat("p_type", tail).alias("b")), 0.5)


_COMPONENTS = """WITH RECURSIVE unit AS ({unit}), pairs AS MATERIALIZED ({pairs}),
    both_ways AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
    reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON e.x = r.seen),
    comps AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1) """.format(unit=_UNIT, pairs=_PAIRS)


@query("g01_connected_components", _COMPONENTS + "SELECT node, component FROM comps")
def components(spark, path):
    nodes = table(spark, path, "embeddings").select(F.col("vec_id").alias("node"))
    return G.connected_components(nodes, _pairs(spark, path))


@query(
    "g02_chunk_groups",
    "SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 30) AS BIGINT) AS chunk FROM events",
)
def chunk_groups(spark, path):
    ev = table(spark, path, "events").select("user_id", "event_id")
    return G.chunk_groups(ev, "user_id", "event_id").withColumn("chunk", F.col("chunk").cast("bigint"))


@query(
    "g03_canonical_names",
    _COMPONENTS
    + """SELECT 'v' || c.node AS original_name, first_value('v' || c.node) OVER (PARTITION BY component
         ORDER BY label DESC, length('v' || c.node) DESC, 'v' || c.node) AS standard_name, 'v' || component AS component
         FROM (SELECT node, min_comp AS component FROM (SELECT node, min('v' || seen) AS mc FROM reach GROUP BY 1)
               JOIN (SELECT 'v' || vec_id AS nm, vec_id AS min_comp FROM embeddings) ON nm = mc) c JOIN embeddings e ON e.vec_id = c.node""",
)
def canonical_names(spark, path):
    named = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    names = table(spark, path, "embeddings").select(named.alias("name"), F.col("label").alias("n"))
    pairs = _pairs(spark, path).select(*[F.concat(F.lit("v"), F.col(c).cast("string")).alias(c) for c in ("a", "b")])
    return R.resolve_names(names, pairs)


@query("g03_resolve_words")
def resolve_words(spark, path):
    words = cut_lineage(_names(spark, path))
    # all names, not only those of a block, and all of two neighbouring blocks
    alike, near = R.similar_in_block(words, 0.95, prefix=0), R.similar_across_blocks(words, 0.9, head=None)
    pairs = alike.select("a", "b").unionByName(near.select("a", "b"))
    return R.resolve_names(words, R.rule_filter(pairs))


@query(
    "h01_decisions",
    """SELECT DISTINCT p_name || ', ' || p_type AS original_name, upper(p_name) AS standard_name,
       CASE WHEN contains(p_name, 'red') THEN 'decided' ELSE 'organization' END AS entity_type,
       md5(p_name || ', ' || p_type || ';' || upper(p_name)) AS decision_key FROM part""",
)
def decisions(spark, path):
    part = table(spark, path, "part")
    names = part.select(F.concat_ws(", ", "p_name", "p_type").alias("original_name"), F.upper("p_name").alias("standard_name")).distinct()

    def decider(pdf):
        red = pdf[pdf["original_name"].str.contains("red", regex=False)]
        return red.assign(entity_type="decided", country=None, province=None, city=None)

    kept = R.decide(names, decider)
    # names here carry a blank in the family part, so none is a person by the default rule
    return kept.select("original_name", "standard_name", "entity_type", "decision_key")
