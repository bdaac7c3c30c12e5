"""Sources, sinks and the graph build, round trips through files in the shared folder."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.base import query, table
from loomgraph.functions import presets as P
from loomgraph.operators.aggregate import edge_histogram
from loomgraph.operators.datasets import split
from loomgraph.operators.ranking import rank_items
from loomgraph.plans import graph_build as B
from loomgraph.runtime import scratch_path
from loomgraph.sources import readers as R
from loomgraph.sources import sinks as S
from loomgraph.sources import statements as T


@query(
    "io01_folder_scan",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, source FROM documents WHERE source <> 'src3'",
)
def folder_scan(spark, path):
    folder = scratch_path(spark, "io01")
    docs = table(spark, path, "documents").select(F.when(F.col("source") != "src3", F.col("doc_id").cast("string")).alias("doc_id"), "text", "source")
    whole = docs.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    whole.option("header", True).option("escape", '"').csv(folder)
    back = R.folder_scan(spark, folder, ["doc_id", "text", "source"], "doc_id", multi_line=True)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "source")


@query(
    "io02_topic_from_file",
    "SELECT lang, CASE lang WHEN 'en' THEN '物理储氢' WHEN 'fr' THEN '储氢技术' WHEN 'de' THEN '无机储氢' ELSE '氢能技术' END AS topic, count(*) AS n FROM documents GROUP BY 1",
)
def topic_from_file(spark, path):
    name = (
        F.when(F.col("lang") == "en", "9 物理储氢 x.xlsx").when(F.col("lang") == "fr", "储氢-2.xlsx").when(F.col("lang") == "de", "2.6.2.3无机储氢-2.xlsx").otherwise("else.xlsx")
    )
    from loomgraph.functions.text import topic_from_file as topic

    return table(spark, path, "documents").select("lang", topic(name).alias("topic")).groupBy("lang", "topic").agg(F.count("*").alias("n"))


@query("io03_header_normalisation", "SELECT c_custkey AS seq_no, c_name AS application_no, c_mktsegment AS title_cn FROM customer")
def headers(spark, path):
    folder = scratch_path(spark, "io03")
    raw = table(spark, path, "customer").select(
        F.col("c_custkey").alias(" 序号 (no)"), F.col("c_name").alias('"申请号"'), F.col("c_mktsegment").alias("标题  (中文)")
    )
    raw.write.parquet(folder)
    back = spark.read.parquet(folder)
    names = {k: P.SHEET_COLUMNS[k] for k in ("序号", "申请号", "标题 (中文)")}
    fields = R.header_map(back.columns, names)
    return back.select(*[F.col(f"`{c}`").alias(f) for c, f in fields.items()])


@query("io04_dataset_scan", "SELECT doc_id AS id, lang AS name FROM documents UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def dataset_scan(spark, path):
    a, b = scratch_path(spark, "io04") + ".parquet", scratch_path(spark, "io04") + ".json"
    table(spark, path, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("name")).write.parquet(a)
    rows = table(spark, path, "benchmark").select(F.struct(F.col("item_id").alias("id"), F.lit("benchmark").alias("name")).alias("r"))
    # JSON arrays: every file of the folder is one array
    packed = rows.groupBy(F.floor(F.col("r.id") / 10).alias("f")).agg(F.to_json(F.collect_list("r")).alias("value"))
    packed.write.partitionBy("f").text(b)
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    return R.dataset_scan(spark, [a, b], schema)


@query("io05_run_logs", "SELECT 'sft' AS kind, 'm_sft_1' AS run, count(*) AS n FROM events WHERE event_type = 'view' UNION ALL SELECT 'rl', 'm_rl_1', count(*) FROM events WHERE event_type = 'error'")
def run_logs(spark, path):
    root = scratch_path(spark, "io05")
    ev = table(spark, path, "events").select("event_id", "event_type")
    for kind, run in (
        ("view", "m_sft_1"), ("click", "m_sft_2"), ("signup", "m_sft_3"), ("error", "m_rl_1"), ("purchase", "m_rl_2")
    ):
        ev.filter(F.col("event_type") == kind).write.json(f"{root}/{run}/raw.jsonl")
    schema = StructType([StructField("event_id", LongType()), StructField("event_type", StringType())])
    logs = R.run_logs(spark, f"{root}/*/raw.jsonl", schema)
    return logs.groupBy("kind", "run").agg(F.count("*").alias("n"))


def _script(spark, path):
    """The status and party edges of the orders as a graph script."""
    g = OrdersBinding(spark, path)
    item = F.concat(F.lit("MATCH (p:Patent {application_no: '"), F.col("item_id").cast("string"), F.lit("'}) "))
    status = g.relation("status").select(
        F.concat(item, F.lit("MATCH (l:LegalStatus {name: 'O\\'"), "status_name", F.lit("'}) MERGE (p)-[:HAS_STATUS]->(l);")).alias("value")
    )
    lit = g.relation("litigation", distinct=True).select(
        F.concat(item, F.lit("MATCH (e:Organization {name: '"), "party_name", F.lit("'}) MERGE (p)-[:LITIGATED_WITH {role: '"), "role", F.lit("'}]->(e);")).alias("value")
    )
    nodes = table(spark, path, "supplier").select(F.concat(F.lit("MERGE (o:Organization {name: '"), "s_name", F.lit("'}) SET o.entity_type = 'x';")).alias("value"))
    notes = table(spark, path, "nation").select(F.concat(F.lit("// "), "n_name").alias("value"))
    folder = scratch_path(spark, "io06")
    status.unionByName(lit).unionByName(nodes).unionByName(notes).write.text(folder)
    return R.script_statements(spark, folder)


@query(
    "io06_script_edges",
    """SELECT CAST(item_id AS VARCHAR) AS src_key, 'HAS_STATUS' AS rel_type, 'LegalStatus' AS dst_label, 'O''' || status_name AS dst_key, NULL AS role FROM status
       UNION ALL SELECT CAST(item_id AS VARCHAR), 'LITIGATED_WITH', 'Organization', party_name, role FROM litigation""",
)
def script_edges(spark, path):
    return R.script_edges(_script(spark, path)).select("src_key", "rel_type", "dst_label", "dst_key", "role")


@query("io06_script_nodes", "SELECT 'Organization' AS label, s_name AS key, 'SET o.entity_type = ''x''' AS properties FROM supplier")
def script_nodes(spark, path):
    return R.script_nodes(_script(spark, path))


@query(
    "io07_graph_sink",
    """SELECT 'edges' AS phase, rel_type AS part, count(*) AS rows FROM edges GROUP BY 2 UNION ALL SELECT 'items', 'item', count(*) FROM items
       UNION ALL SELECT 'dimension_nodes', 'party', count(*) FROM parties UNION ALL SELECT 'dimension_nodes', 'topic', count(*) FROM topics""",
)
def graph_sink(spark, path):
    g = OrdersBinding(spark, path)
    return S.write_graph({"party": g.parties(), "topic": g.topics(), "item": g.items()}, g.edges(), scratch_path(spark, "io07"))


@query(
    "io07_statement_sink",
    "SELECT rel_type, dst_label, count(*) AS statements, true AS in_batches FROM edges WHERE dst_name IS NOT NULL GROUP BY 1, 2",
)
def statement_sink(spark, path):
    """Every edge as a statement, written in files of 5,000 and read back."""
    target = scratch_path(spark, "io07s")
    T.write_statements(T.edge_statements(OrdersBinding(spark, path).edges()), target)
    per_file = T.read_statements(spark, target).groupBy(
        F.regexp_extract("statement", r"\[:(\w+)\]->", 1).alias("rel_type"), F.regexp_extract("statement", r"MATCH \(e:(\w+)", 1).alias("dst_label"), "file"
    ).agg(F.count("*").alias("n"))
    sums = per_file.groupBy("rel_type", "dst_label").agg(F.sum("n").alias("statements"), (F.max("n") <= S.BATCH_ROWS).alias("in_batches"))
    return sums


@query(
    "io08_instruction_sink",
    """SELECT count(*) FILTER (rn <= floor(n * 0.8 + 1e-9)) AS train_size, count(*) - count(*) FILTER (rn <= floor(n * 0.8 + 1e-9)) AS test_size, count(*) AS total_size,
       round(count(*) FILTER (rn <= floor(n * 0.8 + 1e-9)) / count(*), 2) AS train_ratio FROM (SELECT row_number() OVER () AS rn, count(*) OVER () AS n FROM documents)""",
)
def instruction_sink(spark, path):
    docs = split(table(spark, path, "documents").select("doc_id", F.col("text").alias("question"), F.col("source").alias("cypher")), "doc_id", 0.8)
    return S.write_instructions(docs, scratch_path(spark, "io08"), "Answer with a query.")


@query(
    "io09_training_rows",
    "SELECT lang AS split, count(*) AS rows, count(*) FILTER (l.quality = 1) AS matched FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1",
)
def training_rows(spark, path):
    docs = table(spark, path, "documents").select(
        F.col("doc_id").alias("qid"),
        F.col("text").alias("question"),
        F.col("source").alias("cypher"),
        F.lit("count").alias("category"),
        F.lit(1).alias("complexity"),
        F.col("lang").alias("split"),
        F.col("doc_id").alias("index"),
    )
    answers = table(spark, path, "labels").select(
        F.col("doc_id").alias("qid"), F.lit("[]").alias("rows_json"), F.col("toxic").cast("bigint").alias("row_count"), (F.col("quality") == 1).alias("success")
    )
    rows = S.training_rows(docs, answers, "graph", "text2query", "You write queries.")
    return S.write_training_rows(rows, scratch_path(spark, "io09"))


@query("io10_comparison_report", "SELECT event_type AS model, CAST(count(*) AS VARCHAR) AS total FROM events GROUP BY 1")
def comparison(spark, path):
    folder = scratch_path(spark, "io10")
    S.write_comparison(table(spark, path, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("total")), folder)
    return spark.read.option("header", True).csv(folder)


@query("io11_stage_resume", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def stage_resume(spark, path):
    folder = scratch_path(spark, "io11")
    S.stage(spark, folder, "counts", lambda: table(spark, path, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")))

    def never():
        raise RuntimeError("a finished stage must not be built again")

    return S.stage(spark, folder, "counts", never)


def _sheet(spark, path):
    """Orders as raw sheet rows: parties in multi-value cells, codes, states, counters as text."""
    g = OrdersBinding(spark, path)
    # one set per item, cut into its relations afterwards
    act = g.relation("activity").groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("rel_type", "party_name"))).alias("acts"))

    def names(rel):
        return F.array_join(F.transform(F.filter("acts", lambda x: x.rel_type == rel), lambda x: x.party_name), ";")

    acts = act.select(
        "item_id",
        names("OWNED_BY").alias("current_rights_holders"),
        names("TRANSFERRED_FROM").alias("transferors"),
        names("TRANSFERRED_TO").alias("transferees"),
        names("LICENSED_FROM").alias("licensors"),
        names("LICENSED_TO").alias("licensees"),
        names("PLEDGED_TO").alias("pledgees"),
    )
    party = g.relation("party", place=True).select("item_id", F.concat_ws(" ", "party_name", "place_name").alias("applicants"), F.col("place_country").alias("publication_country"))
    base = g.items(counters=True).join(party, "item_id").join(acts, "item_id", "left").join(g.relation("status"), "item_id")
    given = {
        "application_no": F.concat(F.lit("NO"), F.col("item_id").cast("string")),
        "application_date": F.col("item_date"),
        "patent_type": F.col("item_type"),
        "legal_status": F.col("status_name"),
        "title_cn": F.col("title"),
        "ipc_main": F.lit("H01M8/10"),
        **{c: F.col(c) for c in ("applicants", "publication_country", "current_rights_holders", "transferors", "transferees", "licensors", "licensees", "pledgees")},
        **{c: F.col(c).cast("string") for c in B.COUNTS},
    }
    cols = [given.get(f, F.lit(None).cast("string")).cast("string").alias(f) for f in P.SHEET_COLUMNS.values()]
    return base.select(*cols, F.lit("2.6.4氢制冷.xlsx").alias("file_name"), F.lit("氢制冷").alias("tech_domain"))


@query(
    "gb01_graph_build_edges",
    """SELECT rel_type, count(*) AS count FROM edges WHERE dst_label <> 'Person' AND rel_type NOT IN ('LITIGATED_WITH', 'HAS_LITIGATION_TYPE', 'IN_FAMILY', 'BELONGS_TO', 'CLASSIFIED_AS') GROUP BY 1
       UNION ALL SELECT unnest(['BELONGS_TO', 'CLASSIFIED_AS']), n FROM (SELECT count(*) AS n FROM orders)""",
)
def graph_build_edges(spark, path):
    graph = B.build_graph(spark, _sheet(spark, path), scratch_path(spark, "gb01"), threshold=1.0)
    return edge_histogram(graph._edges)


@query(
    "gb02_rank_on_built_graph",
    "SELECT party_name || ' ' || place_name AS name, '公司' AS party_type, count(DISTINCT item_id) AS value FROM party WHERE place_country = 'ASIA' GROUP BY 1, 2 ORDER BY value DESC, name LIMIT 10",
)
def rank_on_built_graph(spark, path):
    graph = B.build_graph(spark, _sheet(spark, path), scratch_path(spark, "gb02"), threshold=1.0)
    return rank_items(graph, "org", {"country": "ASIA", "domain": "氢制冷", "ipc_prefix": "H01"}, 10)
