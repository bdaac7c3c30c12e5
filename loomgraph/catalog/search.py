"""Text and vector search."""

from pyspark.sql import functions as F

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.base import query, table
from loomgraph.operators import search as S
from loomgraph.operators import sets
from loomgraph.operators import text_index as TI
from loomgraph.operators import vector_index as I
from loomgraph.operators import vectors as V

_TOK = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _bm25(src: str, key: str, words: list[str]) -> str:
    """BM25 of literal words over (key, text) rows."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    parts = " + ".join(
        f"ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))"
        for i in range(len(words))
    )
    hit = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"""SELECT {key}, {parts} AS score FROM (SELECT {key}, len(w) AS length, {tf} FROM (SELECT {key}, {_TOK} AS w FROM {src})) d,
        (SELECT count(*) AS n, avg(length) AS mean, {df} FROM (SELECT len(w) AS length, {tf} FROM (SELECT {_TOK} AS w FROM {src}))) s
        WHERE {hit}"""


_ORDER_TEXTS = """SELECT l_orderkey AS item_id, string_agg(p_name, ' ' ORDER BY l_linenumber, p_name) AS text
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"""
_TEXTS = {"texts": _ORDER_TEXTS}


def _docs(spark, path):
    return table(spark, path, "documents").select("doc_id", "text")


def _index(spark, path):
    return TI.build_text_index(_docs(spark, path), "doc_id")


@query(
    "t01_text_search",
    f"SELECT doc_id, round(score, 6) AS score FROM ({_bm25('documents', 'doc_id', ['the', 'thing', 'und'])}) ORDER BY score DESC, doc_id LIMIT 50",
)
def text_search(spark, path):
    hits = S.text_search(_docs(spark, path), "the thing und", "doc_id").select("doc_id", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "doc_id").limit(50)


@query(
    "t01_search_items",
    f"""SELECT h.item_id, round(score, 6) AS score, title, item_date, (SELECT min(topic_name) FROM topic t WHERE t.item_id = h.item_id) AS topics,
        party_name AS applicants FROM (SELECT * FROM ({_bm25('texts', 'item_id', ['red', 'widget'])}) WHERE score > 0.5 ORDER BY score DESC, item_id LIMIT 20) h
        JOIN items i ON i.item_id = h.item_id JOIN party p ON p.item_id = h.item_id""",
    _TEXTS,
)
def search_items(spark, path):
    out = S.search_items(OrdersBinding(spark, path), "Red widget", 20)
    return out.select(
        "item_id",
        F.round("score", 6).alias("score"),
        "title",
        "item_date",
        F.array_join("topics", ";").alias("topics"),
        F.array_join("applicants", ";").alias("applicants"),
    )


@query(
    "t01_search_many",
    f"""SELECT * FROM (SELECT 'q1' AS qid, doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_bm25('documents', 'doc_id', ['the', 'and'])})
        UNION ALL SELECT 'q2', doc_id, round(score, 6), row_number() OVER (ORDER BY score DESC, doc_id) FROM ({_bm25('documents', 'doc_id', ['elle', 'que'])})) WHERE rank <= 20""",
)
def search_many(spark, path):
    asked = spark.createDataFrame([("q1", "the and"), ("q2", "Elle que")], "qid string, query string")
    hits = TI.search_many(_index(spark, path), asked, 20)
    return hits.select("qid", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_BENCH_SEARCH = f"""WITH words AS (SELECT doc_id, {_TOK} AS w FROM documents),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
    asked AS (SELECT DISTINCT item_id AS qid, unnest({_TOK}) AS term FROM benchmark),
    scores AS (SELECT qid, c.doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / mean))) AS score
        FROM asked JOIN counts c USING (term) JOIN df USING (term) JOIN words w USING (doc_id), (SELECT count(*) AS n, avg(len(w)) AS mean FROM words) GROUP BY 1, 2)
    SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10"""


@query("t01_index_search", _BENCH_SEARCH)
def index_text_search(spark, path):
    """Every benchmark text asks the stored postings of all documents."""
    asked = table(spark, path, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = TI.search_many(_index(spark, path), asked, 10)
    return hits.select("qid", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("t02_contains_fallback", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'thing') ORDER BY doc_id LIMIT 20")
def contains_fallback(spark, path):
    return S.contains_search(_docs(spark, path), "thing other", "doc_id", 20)


@query(
    "t03_supplement",
    f"""SELECT item_id, 0 AS source FROM few UNION ALL SELECT item_id, 1 FROM (SELECT item_id FROM ({_bm25('texts', 'item_id', ['red', 'anvil'])})
        WHERE score > 0.3 AND item_id NOT IN (SELECT item_id FROM few) ORDER BY score DESC, item_id LIMIT 10)""",
    {**_TEXTS, "few": "SELECT item_id FROM family WHERE family_id = '42-1998'"},
)
def supplement(spark, path):
    g = OrdersBinding(spark, path)
    few = g.relation("family").filter("family_id = '42-1998'").select("item_id")
    text_hits = TI.search(TI.build_text_index(g.texts()), "red anvil", minimum=0.3)
    return S.supplement(few, [text_hits], "item_id", minimum=10_000)


@query("t03_supplement_enough", "SELECT item_id, 0 AS source FROM family WHERE family_id LIKE '%-1998'")
def supplement_enough(spark, path):
    """As many results as asked for: the search adds nothing."""
    g = OrdersBinding(spark, path)
    few = g.relation("family").filter("family_id LIKE '%-1998'").select("item_id")
    text_hits = S.text_search(g.texts(), "red anvil", "item_id", 0.3)
    return S.supplement(few, [text_hits], "item_id", minimum=10)


@query(
    "t04_tfidf_weights",
    f"""WITH words AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2),
        df AS (SELECT term, count(*) AS df FROM words GROUP BY 1)
        SELECT doc_id, term, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS weight FROM words JOIN df USING (term)""",
)
def tfidf_weights(spark, path):
    return S.tfidf_weights(_docs(spark, path), "doc_id").withColumn("weight", F.round("weight", 6))


@query("t04_tfidf_vectors")
def tfidf_vectors(spark, path):
    return S.tfidf_vectors(_docs(spark, path), "doc_id", features=256, dims=64).select("doc_id", F.size("embedding").alias("dims"))


@query(
    "f15_search_then_filter",
    f"""SELECT h.item_id, round(score, 6) AS score FROM ({_bm25('texts', 'item_id', ['hot', 'gear'])}) h JOIN citems i ON i.item_id = h.item_id
        JOIN party p ON p.item_id = h.item_id WHERE party_type = 'BUILDING' AND transfer_count > 0 AND substr(i.item_date, 1, 4) >= '1998'""",
    _TEXTS,
)
def search_then_filter(spark, path):
    spec = {"org_type": "BUILDING", "has_transfer": True, "has_pledge": False, "year_start": "1998", "location_country": "ASIA", "rights_holder": "x"}
    out = S.search_then_filter(OrdersBinding(spark, path), "hot gear", spec)
    return out.select("item_id", F.round("score", 6).alias("score"))


@query(
    "w02_rank_target_with_keywords",
    f"""SELECT party_name AS name, count(DISTINCT h.item_id) AS value FROM ({_bm25('texts', 'item_id', ['hot', 'gear'])}) h
        JOIN party p ON p.item_id = h.item_id GROUP BY 1 ORDER BY value DESC, name LIMIT 10""",
    _TEXTS,
)
def rank_with_keywords(spark, path):
    from loomgraph.operators.ranking import rank_target

    g = OrdersBinding(spark, path)
    return rank_target(g, "orgs", n=10, base=S.search_then_filter(g, "hot gear", {}, hits=TI.search(TI.build_text_index(g.texts()), "hot gear")))


def _vectors(spark, path):
    return table(spark, path, "embeddings").select(F.col("vec_id").alias("vid"), "embedding", "label")


_UNIT = """SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM
    (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"""
_COS = "list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2]))"


@query("v01_unit_norm", "SELECT vec_id, round(u[1], 6) AS first, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm FROM unit", {"unit": _UNIT})
def unit_norm(spark, path):
    u = _vectors(spark, path).select(F.col("vid").alias("vec_id"), V.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(V.cosine(F.col("u"), F.col("u")), 6).alias("norm"))


@query(
    "v02_exact_top_k",
    f"""SELECT qid, vid, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS vid, {_COS} AS score,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM unit a, unit b) WHERE rank <= 5""",
    {"unit": _UNIT},
)
def exact_top_k(spark, path):
    vec = _vectors(spark, path)
    near = V.top_k_cosine(vec.select(F.col("vid").alias("qid"), "embedding"), vec, 5)
    return near.select("qid", "vid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_ASKED_BEST = f"""SELECT a.vec_id AS qid, b.vec_id AS vid, b.label, {_COS} AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS n FROM unit a, unit b WHERE a.vec_id % 100 = 0"""


def _asked(vec):
    return vec.filter("vid % 100 = 0").select(F.col("vid").alias("qid"), "embedding")


@query(
    "v03_hashed_search",
    """SELECT qid, vid, label, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank
        FROM best WHERE n <= 20 AND label IN (0, 2, 4, 6, 8) QUALIFY rank <= 10""",
    {"unit": _UNIT, "best": _ASKED_BEST},
)
def index_search(spark, path):
    """Every hundredth vector asks the index; cells beyond the probed ones are visited where they can matter."""
    vec = _vectors(spark, path)
    hits = V.index_search(I.build_index(vec.select("vid", "embedding")), vec, _asked(vec), 10, {"label": [0, 2, 4, 6, 8], "unknown": 1}, exact=True)
    return hits.select("qid", "vid", "label", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("v03_probed_search")
def probed_search(spark, path):
    """The default number of probes alone, which may lose some neighbours; its recall is tested against all pairs."""
    vec = _vectors(spark, path)
    return I.search(I.build_index(vec.select("vid", "embedding")), _asked(vec), 10)


@query(
    "v04_post_filter",
    f"""SELECT b.vec_id AS vid, b.label, round({_COS}, 6) AS score FROM unit a, unit b WHERE a.vec_id = 0 AND b.label IN (1, 3, 5)
        ORDER BY {_COS} DESC, 1 LIMIT 20""",
    {"unit": _UNIT},
)
def post_filter(spark, path):
    vec = _vectors(spark, path)
    scored = V.scored_against(vec, list(vec.filter("vid = 0").first()["embedding"]))
    kept = V.post_filter(scored, {"label": [1, 3, 5], "unknown": 7})
    return kept.orderBy(F.desc("score"), "vid").limit(20).select("vid", "label", F.round("score", 6).alias("score"))


@query(
    "v05_hybrid_context",
    f"""SELECT t.doc_id, round(t.score, 6) AS score, 'title: ' || source || chr(10) || 'number: ' || t.doc_id || chr(10) || 'topic: ' || lang || chr(10) || 'parties: N/A' || chr(10) ||
          'abstract: ' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS context FROM
        (SELECT doc_id, max(score) AS score FROM (SELECT * FROM ({_bm25('documents', 'doc_id', ['the', 'thing'])})
           UNION ALL SELECT b.vec_id, {_COS} FROM unit a, unit b WHERE a.vec_id = 3) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) t
        JOIN documents d ON d.doc_id = t.doc_id""",
    {"unit": _UNIT},
)
def hybrid_context(spark, path):
    docs = table(spark, path, "documents")
    vec = _vectors(spark, path)
    text_hits = TI.search(_index(spark, path), "the thing", 15)
    near = V.scored_against(vec, list(vec.filter("vid = 3").first()["embedding"])).orderBy(F.desc("score"), "vid").limit(15)
    best = V.hybrid_ranking(text_hits, near.select(F.col("vid").alias("doc_id"), "score"), "doc_id", 15)
    none = F.lit(None).cast("string")
    ctx = V.context_text(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), none, F.col("text"), none)
    return best.join(docs, "doc_id").select("doc_id", F.round("score", 6).alias("score"), ctx.alias("context"))


@query(
    "u01_union_distinct",
    "SELECT item_id FROM party WHERE party_type = 'BUILDING' UNION SELECT item_id FROM topic WHERE topic_parent = 'PROMO'",
)
def union_distinct(spark, path):
    g = OrdersBinding(spark, path)
    a = g.relation("party").filter("party_type = 'BUILDING'").select("item_id")
    b = g.relation("topic").filter("topic_parent = 'PROMO'").select("item_id")
    return sets.union_distinct(a, b)


@query("u02_concatenate", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT page_id, html FROM pages")
def concatenate(spark, path):
    return sets.concatenate(
        table(spark, path, "documents").select(F.col("doc_id").alias("id"), "text"),
        table(spark, path, "benchmark").select(F.col("item_id").alias("id"), "text"),
        table(spark, path, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")),
    )


@query(
    "u03_merge_results",
    """SELECT o_custkey AS k, o_totalprice AS price, 0 AS source FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
       UNION ALL SELECT o_custkey, price, 1 FROM (SELECT o_custkey, min(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
       WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')""",
)
def merge_results(spark, path):
    orders = table(spark, path, "orders").withColumn("k", F.col("o_custkey")).withColumn("price", F.col("o_totalprice"))
    a = orders.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("k", "price")
    b = orders.filter("o_orderstatus = 'O'").select("k", "price")
    return sets.merge_results(a, b, "k", "price")


_SETS = """SELECT o_custkey AS qid, o_orderpriority AS v FROM orders"""


@query(
    "u04_over_retrieval",
    """SELECT q.qid, gold_size, relaxed_size, over_retrieved, round(relaxed_size / nullif(gold_size, 0), 6) AS inflation FROM
       (SELECT qid, CAST(count(DISTINCT CASE WHEN st = 'F' THEN v END) AS BIGINT) AS gold_size, CAST(count(DISTINCT v) AS BIGINT) AS relaxed_size,
          CAST(count(DISTINCT v) - count(DISTINCT CASE WHEN st = 'F' THEN v END) AS BIGINT) AS over_retrieved
        FROM (SELECT o_custkey AS qid, o_orderpriority AS v, o_orderstatus AS st FROM orders) GROUP BY 1) q""",
)
def over_retrieval(spark, path):
    orders = table(spark, path, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("v"), "o_orderstatus")
    out = sets.over_retrieval(orders.select("qid", "v"), orders.filter("o_orderstatus = 'F'").select("qid", "v"), ["qid"], "v")
    return out.withColumn("inflation", F.round("inflation", 6))


@query(
    "u05_jaccard",
    """SELECT qid, CAST(sum(a * b) AS BIGINT) AS intersection, count(*) AS union_size, round(sum(a * b) / count(*), 6) AS jaccard FROM
       (SELECT o_custkey AS qid, o_orderpriority AS v, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a,
          max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS b FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) GROUP BY 1""",
)
def jaccard(spark, path):
    orders = table(spark, path, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("v"), "o_orderstatus")
    out = sets.jaccard(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), ["qid"], "v")
    return out.withColumn("jaccard", F.round("jaccard", 6))


@query("u06_union_columns", "SELECT doc_id, lang, n_chars, quality FROM documents d JOIN labels USING (doc_id)")
def union_columns(spark, path):
    docs = table(spark, path, "documents")
    left = docs.select("doc_id", "lang", "n_chars")
    right = docs.select("doc_id", "n_chars").join(table(spark, path, "labels").select("doc_id", "quality"), "doc_id")
    return sets.union_columns(left, right, "doc_id")


@query(
    "h04_tagged_spans",
    r"SELECT page_id, CAST(n - 1 AS INTEGER) AS n, md5(s[n]) AS digest FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS s, unnest(range(1, len(s) + 1)) AS n FROM pages)",
)
def tagged_spans(spark, path):
    out = S.tagged_spans(table(spark, path, "pages").select("page_id", F.col("html").alias("text")), "page_id", "p")
    return out.select("page_id", "n", F.md5(F.col("span").cast("binary")).alias("digest"))


@query(
    "h05_custom_encoder",
    "SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS es FROM documents",
)
def custom_encoder(spark, path):
    def encoder(batch):
        return batch.map(lambda t: [float(len(t)), float(t.count("e"))])

    vec = S.encode(_docs(spark, path), "doc_id", encoder)
    return vec.select("doc_id", F.col("embedding")[0].alias("chars"), F.col("embedding")[1].alias("es"))
