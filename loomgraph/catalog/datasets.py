"""Dataset building over the driver's documents, conversations, orders and events."""

from pyspark.sql import functions as F

from loomgraph.binding import OrdersBinding
from loomgraph.catalog.base import query, table
from loomgraph.catalog.rewards import responses
from loomgraph.operators import datasets as D


def _uniform(*parts: str) -> str:
    """The operators' seeded uniform number as SQL."""
    text = " || ':' || ".join(["'42'", *parts])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(
    "d01_sample_by_frequency",
    f"""SELECT DISTINCT name FROM cum JOIN (SELECT {_uniform('j')} * (SELECT max(hi) FROM cum) AS u FROM range(1, 101) r(j)) ON u >= lo AND u < hi""",
    {
        "cum": """SELECT name, hi, hi - n AS lo FROM (SELECT name, n, sum(n) OVER (ORDER BY n DESC, name ROWS UNBOUNDED PRECEDING) AS hi FROM
            (SELECT party_name AS name, count(*) AS n FROM party GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, name LIMIT 200))"""
    },
)
def sample_by_frequency(spark, path):
    return D.sample_by_frequency(OrdersBinding(spark, path).relation("party"), "party_name", 100, 5)


@query(
    "d02_sample_values",
    "SELECT value FROM (SELECT DISTINCT place_province AS value FROM party) ORDER BY md5('7:' || value), value LIMIT 10",
)
def sample_values(spark, path):
    return D.sample_values(OrdersBinding(spark, path).relation("party", place=True), "place_province", 10, 7)


@query("d02_transferees", "SELECT party_name AS name, count(*) AS n FROM activity WHERE rel_type = 'TRANSFERRED_TO' GROUP BY 1 ORDER BY n DESC, name LIMIT 40")
def transferees(spark, path):
    rel = OrdersBinding(spark, path).relation("activity", distinct=True).filter("rel_type = 'TRANSFERRED_TO'")
    return rel.groupBy(F.col("party_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(40)


def _patterns(spark, path):
    """Two patterns per part type, with the parameters of a topic and of a year range."""
    types = table(spark, path, "part").select("p_type").distinct()
    topic = F.struct(F.lit("topic").alias("name"), F.lit("topic").alias("type"))
    start = F.struct(F.lit("year_start").alias("name"), F.lit("year").alias("type"))
    end = F.struct(F.lit("year_end").alias("name"), F.lit("year").alias("type"))
    one = types.select(
        F.concat(F.lit("topic_"), "p_type").alias("pattern_id"),
        F.concat(F.lit("ITEMS OF "), "p_type", F.lit(" WHERE topic = $topic")).alias("template"),
        F.lit("{topic}").alias("context"),
        F.array(topic).alias("params"),
    )
    two = types.select(
        F.concat(F.lit("range_"), "p_type").alias("pattern_id"),
        F.concat(F.lit("ITEMS OF "), "p_type", F.lit(" FROM $year_start TO $year_end")).alias("template"),
        F.lit("{year_start} to {year_end}").alias("context"),
        F.array(start, end).alias("params"),
    )
    return one.unionByName(two)


def _values(spark, path):
    g = OrdersBinding(spark, path)
    topics = g.topics().filter("topic_level = 3").select(F.col("topic_name").alias("value"))
    years = g.items().select(F.substring("item_date", 1, 4).alias("value")).distinct()
    return topics.select(F.lit("topic").alias("type"), "value").unionByName(years.select(F.lit("year").alias("type"), "value"))


def _instances(spark, path):
    return D.instantiate(_patterns(spark, path), _values(spark, path), 20)


_FILLED = {
    "pool": """SELECT type, value, row_number() OVER (PARTITION BY type ORDER BY value) - 1 AS at, count(*) OVER (PARTITION BY type) AS n FROM
        (SELECT DISTINCT 'topic' AS type, topic_name AS value FROM topics WHERE topic_level = 3
         UNION ALL SELECT DISTINCT 'year', substr(item_date, 1, 4) FROM items)""",
    "need": """SELECT DISTINCT pattern_id, copy, name, type, p_type FROM
        (SELECT 'topic_' || p_type AS pattern_id, 'topic' AS name, 'topic' AS type, p_type FROM part
         UNION ALL SELECT 'range_' || p_type, unnest(['year_start', 'year_end']), 'year', p_type FROM part), range(1, 21) c(copy)""",
    "drawn_values": f"""SELECT pattern_id, copy, name, p_type, p.value FROM
        (SELECT *, {_uniform('pattern_id', 'copy', 'name')} AS u FROM need) d JOIN pool p ON p.type = d.type AND p.at = floor(u * p.n)""",
    "filled": """SELECT pattern_id, copy, 'topic' AS category, 'ITEMS OF ' || p_type || ' WHERE topic = ' || chr(39) || value || chr(39) AS text,
            value AS context FROM drawn_values WHERE name = 'topic'
        UNION ALL SELECT pattern_id, copy, 'range',
            'ITEMS OF ' || p_type || ' FROM ' || chr(39) || min(value) || chr(39) || ' TO ' || chr(39) || max(value) || chr(39),
            min(value) || ' to ' || max(value) FROM drawn_values WHERE name <> 'topic' GROUP BY pattern_id, copy, p_type""",
}


@query("d03_instantiate", "SELECT pattern_id, copy::INT AS copy, text, context FROM filled", _FILLED)
def instantiate(spark, path):
    return _instances(spark, path).select("pattern_id", "copy", "text", "context")


@query(
    "d04_quota_generation",
    """SELECT text, category, pattern_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || text), text) AS rank FROM
       (SELECT DISTINCT text, category, pattern_id FROM filled)) WHERE rank <= CASE category WHEN 'topic' THEN 34 ELSE 16 END""",
    _FILLED,
)
def quota_generation(spark, path):
    inst = _instances(spark, path).withColumn("category", F.split("pattern_id", "_")[0]).select("text", "category", "pattern_id")
    return D.take_quotas(inst, "text", "category", D.quotas(50, {"topic": 0.65, "range": 0.33}))


@query(
    "d05_question_from_template",
    "SELECT doc_id, 'How many ' || lang || ' texts from ' || source || '? {n}' AS question, 'n' AS unreplaced FROM documents",
)
def question(spark, path):
    params = F.array(F.struct(F.lit("src").alias("name"), F.col("source").alias("value")))
    q = D.question_from_template(F.lit("How many {context} texts from {src}? {n}"), F.col("lang"), params)
    return table(spark, path, "documents").select("doc_id", q.alias("q")).select("doc_id", "q.question", F.array_join("q.unreplaced", ",").alias("unreplaced"))


def _executed(spark, path):
    """Every customer is a query; its result rows are its orders, latest first."""
    from pyspark.sql import Window

    queries = table(spark, path, "customer").select(
        F.col("c_custkey").alias("qid"),
        F.col("c_mktsegment").alias("category"),
        (F.col("c_acctbal") > 0).alias("ok"),
        F.when(F.col("c_acctbal") < -900, "SyntaxError").when(F.col("c_acctbal") < -500, "timeout").otherwise("boom").alias("error"),
    )
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", " ").otherwise(F.col("o_orderstatus"))
    rows = table(spark, path, "orders").select(
        F.col("o_custkey").alias("qid"), F.row_number().over(w).alias("row_no"), F.array(status, F.when(F.col("o_orderpriority") == "2-HIGH", "").otherwise("x")).alias("values")
    )
    return queries, rows


_STATUS = """SELECT c_custkey AS qid, c_mktsegment AS category, coalesce(n, 0) AS result_count, CASE WHEN c_acctbal <= 0 AND c_acctbal < -900 THEN 'syntax_error'
      WHEN c_acctbal <= 0 AND c_acctbal < -500 THEN 'timeout' WHEN c_acctbal <= 0 THEN 'execution_error' WHEN coalesce(n, 0) < 1 THEN 'empty_result'
      WHEN n > 15 THEN 'too_many_results' WHEN bf > 0 THEN 'empty_result' WHEN n > 1 AND bt > 0 THEN 'empty_result' ELSE 'valid' END AS status FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, count(*) FILTER (rn = 1 AND o_orderpriority = '2-HIGH') AS bf, count(*) FILTER (rn <= 3 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS bt FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) GROUP BY 1) ON o_custkey = c_custkey"""


@query("d06_validation_status", "SELECT qid, status, result_count FROM st", {"st": _STATUS})
def validation_status(spark, path):
    return D.validation_status(*_executed(spark, path), maximum=15)


@query("d07_accounting", "SELECT category, status, count(*) AS n FROM st GROUP BY 1, 2", {"st": _STATUS})
def accounting(spark, path):
    queries, rows = _executed(spark, path)
    return D.accounting(queries.select("qid", "category"), D.validation_status(queries, rows, maximum=15))


@query(
    "d08_stratified_split",
    """SELECT doc_id, lang, CASE WHEN rn <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM
       (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)""",
)
def stratified_split(spark, path):
    return D.split(table(spark, path, "documents").select("doc_id", "lang"), "doc_id", 0.8, "lang")


@query(
    "d08_random_split",
    """SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.9 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM
       (SELECT *, row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""",
)
def random_split(spark, path):
    return D.split(table(spark, path, "orders").select("o_orderkey"), "o_orderkey", 0.9, seed=3)


@query(
    "d09_head_tail",
    """SELECT doc_id, 'train' AS split FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= round_even(n * 0.75, 0)
       UNION ALL SELECT doc_id, 'test' FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn > n - round_even(n * 0.25, 0)""",
)
def head_tail(spark, path):
    return D.head_tail(table(spark, path, "documents").select("doc_id"), "doc_id")


@query(
    "d10_preference_rows",
    "SELECT lang AS prompt, 0 AS n, source AS response FROM documents UNION ALL SELECT lang, 1, CAST(n_chars AS VARCHAR) FROM documents",
)
def preference_rows(spark, path):
    docs = table(spark, path, "documents")
    return D.preference_to_instructions(docs.select(F.col("lang").alias("prompt"), F.col("source").alias("chosen"), F.col("n_chars").cast("string").alias("rejected")))


@query(
    "d11_dedup_nested",
    "SELECT role, chars, conv_id FROM (SELECT role, length(text) AS chars, conv_id, row_number() OVER (PARTITION BY role, length(text) ORDER BY conv_id, turn) AS rn FROM conversations) WHERE rn = 1",
)
def dedup_nested(spark, path):
    prompt = F.array(F.struct("role", F.length("text").alias("chars")))
    rows = table(spark, path, "conversations").select(prompt.alias("prompt"), "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("o"))
    out = D.dedup_nested(rows, "prompt", "o")
    return out.select(F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["chars"].alias("chars"), "conv_id")


@query("d12_cap_rows_first", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 150")
def cap_first(spark, path):
    return D.cap_rows(table(spark, path, "documents").select("doc_id"), 150, "doc_id")


@query("d12_cap_rows_random", "SELECT doc_id FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 150")
def cap_random(spark, path):
    return D.cap_rows(table(spark, path, "documents").select("doc_id"), 150, "doc_id", 5)


@query(
    "d13_drop_long_prompts",
    r"SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) <= 200",
)
def drop_long(spark, path):
    return D.drop_long(table(spark, path, "documents"), "text", 200).select("doc_id")


@query(
    "d14_chat_rows",
    """SELECT doc_id AS index, 'src' AS data_source, md5(text || ' Answer after ####.') AS content, CAST(n_chars AS VARCHAR) AS ground_truth, lang AS split FROM documents""",
)
def chat_rows(spark, path):
    answer = F.concat("source", F.lit(" #### "), F.format_number("n_chars", 0))
    docs = table(spark, path, "documents").withColumn("answer", answer)
    cols = D.chat_row(
        "src",
        [D.message("user", F.concat("text", F.lit(" Answer after ####.")))],
        "math",
        D.final_solution(F.col("answer")),
        F.col("doc_id"),
        F.col("lang"),
        answer=F.col("answer"),
    )
    rows = docs.select(*cols)
    return rows.select(
        F.col("extra_info.index").alias("index"),
        "data_source",
        F.md5(F.col("prompt")[0]["content"].cast("binary")).alias("content"),
        F.col("reward_model.ground_truth").alias("ground_truth"),
        F.col("extra_info.split").alias("split"),
    )


@query(
    "d15_multiple_choice",
    """SELECT doc_id, array_to_string(list_transform(o, lambda x: x.t), '|') AS options, chr(64 + list_position(list_transform(o, lambda x: x.r), 1)) AS gold FROM
       (SELECT doc_id, list_sort([{'h': md5('42:' || doc_id || ':' || lang), 't': lang, 'r': 1}, {'h': md5('42:' || doc_id || ':' || source), 't': source, 'r': 0},
          {'h': md5('42:' || doc_id || ':' || n_chars), 't': CAST(n_chars AS VARCHAR), 'r': 0}, {'h': md5('42:' || doc_id || ':none'), 't': 'none', 'r': 0}]) AS o FROM documents)""",
)
def multiple_choice(spark, path):
    made = D.shuffled_options(F.col("doc_id").cast("string"), F.col("lang"), [F.col("source"), F.col("n_chars").cast("string"), F.lit("none")])
    return table(spark, path, "documents").select("doc_id", made.alias("m")).select("doc_id", F.array_join("m.options", "|").alias("options"), "m.gold")


@query(
    "d15_clean_endings",
    r"SELECT page_id, md5(replace(regexp_replace(replace(regexp_replace(html, '^\s+|\s+$', '', 'g'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ')) AS digest FROM pages",
)
def clean_endings(spark, path):
    return table(spark, path, "pages").select("page_id", F.md5(D.clean_ending(F.col("html")).cast("binary")).alias("digest"))


@query(
    "d16_turns_to_messages",
    """SELECT conv_id, string_agg(role || '/' || md5(text) || '/' || CASE role WHEN 'assistant' THEN 1 ELSE 0 END, ',' ORDER BY turn) AS messages FROM conversations GROUP BY 1""",
)
def turns_to_messages(spark, path):
    out = D.turns_to_messages(table(spark, path, "conversations"), "conv_id", "turn", "role", "text")
    shown = F.transform("messages", lambda m: F.concat_ws("/", m.role, F.md5(m.content.cast("binary")), m.loss_mask.cast("string")))
    return out.select("conv_id", F.array_join(shown, ",").alias("messages"))


@query(
    "d16_append_completion",
    "SELECT conv_id, turn, 'system,user,assistant' AS roles, 4 + length(text) + length(role) AS chars FROM conversations",
)
def append_completion(spark, path):
    made = D.append_completion("help", F.array(D.message("user", F.col("text"))), F.col("role"))
    rows = table(spark, path, "conversations").select("conv_id", "turn", made.alias("p"))
    return rows.select("conv_id", "turn", F.array_join("p.role", ",").alias("roles"), F.aggregate("p", F.lit(0), lambda s, m: s + F.length(m.content)).cast("bigint").alias("chars"))


@query(
    "d17_collapse",
    "SELECT doc_id, CASE WHEN n_chars > 1000 THEN source WHEN n_chars > 300 THEN lang ELSE '' END AS ground_truth, n_chars AS extra_chars FROM documents",
)
def collapse(spark, path):
    rows = table(spark, path, "documents").select(
        "doc_id",
        "n_chars",
        F.when(F.col("n_chars") > 1000, F.col("source")).otherwise("").alias("first"),
        F.when(F.col("n_chars") > 300, F.col("lang")).alias("second"),
    )
    out = D.collapse(rows, ["doc_id"], ["first", "second"])
    return out.select("doc_id", "ground_truth", F.col("extra_info.n_chars").alias("extra_chars"))


_IDX = "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders"


@query("d18_repeat_interleaved", "SELECT o_orderkey, c AS copy, i * 3 + c AS position FROM ix, (VALUES (0), (1), (2)) v(c)".replace("FROM ix,", "FROM ix CROSS JOIN"), {"ix": _IDX})
def repeat_interleaved(spark, path):
    return D.repeat_rows(table(spark, path, "orders").select("o_orderkey"), "o_orderkey", 3)


@query("d18_repeat_tiled", "SELECT o_orderkey, c AS copy, c * n + i AS position FROM ix CROSS JOIN (VALUES (0), (1)) v(c)", {"ix": _IDX})
def repeat_tiled(spark, path):
    return D.repeat_rows(table(spark, path, "orders").select("o_orderkey"), "o_orderkey", 2, False)


@query("d18_repeat_by_count", "SELECT n_nationkey, unnest(range(1, n_regionkey + 1)) AS copy FROM nation")
def repeat_by_count(spark, path):
    rows = D.repeat_by_count(table(spark, path, "nation"), "n_regionkey")
    return rows.select("n_nationkey", F.col("copy").cast("bigint").alias("copy"))


@query("d19_chunk", "SELECT o_orderkey, i // (n // 5) AS chunk FROM ix", {"ix": _IDX})
def chunk(spark, path):
    return D.chunk_rows(table(spark, path, "orders").select("o_orderkey"), "o_orderkey", 5)


@query("d19_split_by_size", "SELECT o_orderkey, i // 700 AS part FROM ix", {"ix": _IDX})
def split_by_size(spark, path):
    return D.split_rows(table(spark, path, "orders").select("o_orderkey"), "o_orderkey", 700)


@query("d19_pad", "SELECT o_orderkey, 0 AS padding FROM ix UNION ALL SELECT o_orderkey, 1 FROM ix WHERE i < (7 - n % 7) % 7", {"ix": _IDX})
def pad(spark, path):
    return D.pad_rows(table(spark, path, "orders").select("o_orderkey"), "o_orderkey", 7)


_SNAKE = """SELECT doc_id, n_chars, doc_id // 50 AS batch, CASE WHEN i % 16 < 8 THEN i % 16 ELSE 15 - i % 16 END AS part, row_number() OVER (ORDER BY doc_id) - 1 AS pos,
    count(*) OVER () AS n FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS i FROM documents)"""


@query("d20_serpentine", "SELECT doc_id, part FROM snake", {"snake": _SNAKE})
def serpentine(spark, path):
    docs = table(spark, path, "documents").select("doc_id", "n_chars")
    return D.serpentine(docs, D.workload(F.col("n_chars")), "doc_id", 8).select("doc_id", "part")


@query("d20_differencing_per_batch")
def differencing(spark, path):
    docs = table(spark, path, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 50).alias("batch"))
    return D.balance_batches(docs, "batch", "doc_id", "n_chars", 4)


@query(
    "d20_imbalance",
    """SELECT a.mn AS min, a.mx AS max, a.mx - a.mn AS minmax_diff, b.mn AS balanced_min, b.mx AS balanced_max, round(b.t / 8, 6) AS mean FROM
       (SELECT min(s) AS mn, max(s) AS mx FROM (SELECT CAST(sum(n_chars) AS BIGINT) AS s FROM snake GROUP BY pos // (n // 8))) a CROSS JOIN
       (SELECT min(s) AS mn, max(s) AS mx, CAST(sum(s) AS BIGINT) AS t FROM (SELECT CAST(sum(n_chars) AS BIGINT) AS s FROM snake GROUP BY part)) b""",
    {"snake": _SNAKE},
)
def imbalance(spark, path):
    docs = table(spark, path, "documents").select("doc_id", "n_chars")
    dealt = D.serpentine(docs, D.workload(F.col("n_chars")), "doc_id", 8)
    return D.imbalance(dealt, "doc_id", "n_chars", "part", 8).withColumn("mean", F.round("mean", 6))


@query(
    "d21_resample_by_score",
    f"""SELECT d.event_id AS draw, l.event_id AS pos, l.score FROM
        (SELECT event_id, floor({_uniform('event_id')} * (SELECT sum(u)::DOUBLE FROM line)) AS p FROM responses) d JOIN line l ON p >= lo AND p < lo + u""",
    {
        "line": """SELECT event_id, score, u, sum(u) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) - u AS lo FROM
            (SELECT event_id, score, greatest(round((score * score + 1e-8) * 1e8), 1)::HUGEINT AS u FROM responses)"""
    },
)
def resample(spark, path):
    return D.resample_by_score(responses(spark, path).select("pos", "uid", "score"), "score", "pos").select("draw", "pos", "score")


# serpentine deal into k batches, batches placed by load with the light ones at both ends
def _micro_sql(batches: str) -> str:
    return f"""WITH size AS (SELECT {batches} AS k FROM (SELECT count(*) AS n, sum(n_chars)::BIGINT AS s FROM documents)),
        rows AS (SELECT doc_id, (24576::HUGEINT * n_chars + n_chars::HUGEINT * n_chars) AS w, row_number() OVER (ORDER BY doc_id) - 1 AS original_idx FROM documents),
        dealt AS (SELECT *, (row_number() OVER (ORDER BY w DESC, doc_id) - 1) % (2 * k) AS step FROM rows, size),
        parts AS (SELECT *, CASE WHEN step < k THEN step ELSE 2 * k - 1 - step END AS part FROM dealt),
        loads AS (SELECT part, k, row_number() OVER (ORDER BY sum(w) DESC, min(original_idx) DESC) - 1 AS r FROM parts GROUP BY part, k)
        SELECT doc_id, original_idx, CASE WHEN r % 2 = 0 THEN (l.k + 1) // 2 - 1 - r // 2 ELSE (l.k + 1) // 2 + r // 2 END AS micro_batch
        FROM parts p JOIN loads l ON p.part = l.part"""


@query("d22_micro_batches", _micro_sql("least(n, (s + 199999) // 200000)"))
def micro_batches(spark, path):
    out = D.micro_batches(table(spark, path, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 200_000)
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("original_idx", "micro_batch")])


@query("d22_micro_batches_minimum", _micro_sql("(least(n, greatest(30, (s + 999999) // 1000000)) + 7) // 8 * 8"))
def micro_batches_minimum(spark, path):
    docs = table(spark, path, "documents").select("doc_id", "n_chars")
    out = D.micro_batches(docs, "doc_id", "n_chars", 1_000_000, minimum=30, divisor=8)
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("original_idx", "micro_batch")])

# the number of batches and the bound of largest differencing: no two parts of a block differ by more than its heaviest row
@query(
    "d22_differenced_micro_batches",
    """SELECT count(*) AS rows, sum(n_chars)::BIGINT AS tokens, least(count(*), (sum(n_chars)::BIGINT + 199999) // 200000) AS batches,
       true AS balanced FROM documents""",
)
def differenced_micro_batches(spark, path):
    docs = table(spark, path, "documents").select("doc_id", "n_chars")
    out = D.micro_batches(docs, "doc_id", "n_chars", 200_000, difference=True)
    w = D.workload(F.col("n_chars"))
    load = out.groupBy("micro_batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"), F.sum(w).alias("w"), F.max(w).alias("top"))
    # parts of two blocks differ by one row of the deal and one of each block at most
    balanced = F.max("w") - F.min("w") <= 3 * F.max("top")
    return load.agg(F.sum("n").alias("rows"), F.sum("s").alias("tokens"), F.count("*").alias("batches"), balanced.alias("balanced"))


@query(
    "d22_fitting_micro_batches",
    """SELECT count(*) AS rows, sum(n_chars)::BIGINT AS tokens, 0::BIGINT AS over, true AS enough FROM documents""",
)
def fitting_micro_batches(spark, path):
    docs = table(spark, path, "documents").select("doc_id", "n_chars")
    out = D.micro_batches(docs, "doc_id", "n_chars", 200_000, difference=True, fit=True)
    report = D.micro_batch_report(out, "n_chars", 200_000)
    enough = F.count("*") * 200_000 >= F.sum("tokens")
    return report.agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.count_if(~F.col("fits")).alias("over"), enough.alias("enough"))


@query(
    "d20_differencing_spread",
    """SELECT doc_id // 50 AS batch, count(*) AS rows, sum(24576::HUGEINT * n_chars + n_chars::HUGEINT * n_chars)::BIGINT AS work, true AS balanced
       FROM documents GROUP BY 1""",
)
def differencing_spread(spark, path):
    """Parts of a batch differ by no more than its heaviest row."""
    docs = table(spark, path, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 50).alias("batch"))
    out = D.balance_batches(docs, "batch", "doc_id", "n_chars", 4).withColumn("w", D.workload(F.col("n_chars")))
    part = out.groupBy("batch", "part").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.max("w").alias("top"))
    whole = part.groupBy("batch").agg(
        F.sum("n").alias("rows"), F.sum("w").alias("work"), (F.max("w") - F.when(F.count("*") < 4, 0).otherwise(F.min("w"))).alias("d"), F.max("top").alias("top")
    )
    return whole.select("batch", "rows", "work", (F.col("d") <= F.col("top")).alias("balanced"))
