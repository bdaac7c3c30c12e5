"""The corpus operators as queries over the given tables, with SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat, decontaminate, html_text, language_model, line_dedup, mixing, pii, pipelined_search, prefix_trie, simhash, toxicity, vector_dedup
from loomgraph.llm.common import crc_mod, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def toxicity_model(spark: SparkSession, path: str) -> toxicity.Classifier:
    """Fitted on labelled documents outside the held-out fold."""
    training = crc_mod(F.col("doc_id"), 5) != 0
    return toxicity.fit_in_task(toxicity.labelled_rows(table(spark, path, "documents"), table(spark, path, "labels"), training))


@query
def op1_toxicity(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, path))
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query
def op2_pseudonyms(spark: SparkSession, path: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, path, "documents").select("doc_id", "text"), key="loomgraph demonstration key")
    return done.select(
        "doc_id",
        F.size("found").cast("long").alias("n_found"),
        F.transform("found", lambda f: f["kind"]).alias("kinds"),
        "masked",
    )


@query
def op3_embedding_dedup(spark: SparkSession, path: str) -> DataFrame:
    return vector_dedup.embedding_groups(table(spark, path, "embeddings"), min_cosine=0.93)


@query
def op4_chat_format(spark: SparkSession, path: str) -> DataFrame:
    case = spark.createDataFrame(
        [(chat.SPLIT_CASE, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(["user", "assistant"])],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, path, "conversations").select("conv_id", "turn", "role", "text").unionByName(case)
    done = chat.format_chats(rows)
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.under_mask(F.col("formatted"), F.col("mask"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.array_join(loss, "").alias("_loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLES["op4_chat_format"] = r"""
WITH all_rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
    SELECT *, length(regexp_replace(text, '([\[<])(\\*(?:/?INST\]|/?s>))', '\1\\\2', 'g'))
        + CASE WHEN role = 'assistant' THEN 7
               ELSE 14 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([\[<])(\\*(?:/?INST\]|/?s>))', '\1\\\2', 'g')) END AS chars
    FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


@query
def op5_decontaminate(spark: SparkSession, path: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, path, "documents"), table(spark, path, "benchmark"))


@query
def op6_mix_sources(spark: SparkSession, path: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, path, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_sql(docs: str) -> str:
    return rf"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}),
totals AS (
    SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source),
staged AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER earlier, 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS among
    FROM totals
    WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
    SELECT rest, among FROM staged WHERE rest * weight <= among * 3 * source_size
    ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
targets AS (
    SELECT source, source_size,
        least((level.rest * weight)::DOUBLE / level.among::DOUBLE, (3 * source_size)::DOUBLE) AS target FROM staged, level),
placed AS (
    SELECT doc_id, s.source, size, source_size, target, floor(target)::BIGINT AS budget,
        coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
    (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
     + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM placed"""


ORACLES["op6_mix_sources"] = mix_sql("documents")


@query
def op7_page_text(spark: SparkSession, path: str) -> DataFrame:
    done = html_text.extract_text(table(spark, path, "pages"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op8_kneser_ney(spark: SparkSession, path: str) -> DataFrame:
    return language_model.language_model_scores(table(spark, path, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


@query
def op9_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    done = line_dedup.drop_frequent_lines(table(spark, path, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def line_dedup_ctes(docs: str) -> str:
    """CTEs up to `line_kept(r, doc_id, text, lang, source, n_chars, n_lines, n_dropped)`."""
    key = f"trim({LOWER.format('line')}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
numbered AS (SELECT row_number() OVER () AS r, * FROM {docs}),
lines AS (
    SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM numbered),
keyed AS (SELECT r, pos, line, {key} AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
line_kept AS (
    SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '') AS kept,
        count(*) AS n_lines, count(f.k) AS n_dropped
    FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY r)"""


ORACLES["op9_line_dedup"] = f"""WITH {line_dedup_ctes('documents')}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM line_kept JOIN numbered USING (r)"""


@query
def op10_simhash(spark: SparkSession, path: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, path, "documents"))
    printed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return groups.select("doc_id", printed.alias("fingerprint"), "component_id", "kept")


@query
def op11_ranked_search(spark: SparkSession, path: str) -> DataFrame:
    return pipelined_search.ranked_search(table(spark, path, "documents"), table(spark, path, "benchmark"), top=50)


ORACLES["op11_ranked_search"] = rf"""
WITH terms AS (
    SELECT r, doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
counts AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scores AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (r), totals GROUP BY item_id, r, doc_id),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""


@query
def op12_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = bpe.round_trip(table(spark, path, "documents").select("doc_id", "text"), vocabulary)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_prefix_trie(spark: SparkSession, path: str) -> DataFrame:
    turns = prefix_trie.turn_keys(table(spark, path, "conversations"))
    return prefix_trie.prefix_trie(rebuilt_turns(turns))


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """Conversation c starts with the first h turns of conversation c - c % 20 and goes on with its own turns after its first h."""
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    placed = turns.filter("conv_id IS NOT NULL").withColumn("turn", F.row_number().over(in_order) - 1)

    def head(c):
        return F.crc32(c.cast("string").cast("binary")) % 4

    heir = F.transform(F.sequence(F.lit(-19), F.lit(19)), lambda i: F.col("conv_id") + i)
    heir = F.filter(heir, lambda c: (c - c % 20 == F.col("conv_id")) & (head(c) > F.col("turn")))
    turn, words = F.col("turn").cast("long").alias("turn"), F.col("words").alias("words")
    lent = F.transform(heir, lambda c: F.struct(c.alias("conv_id"), turn, F.col("key").alias("key"), words))
    kept = F.when(F.col("turn") >= head(F.col("conv_id")), F.col("key")).alias("key")
    own = F.array(F.struct("conv_id", turn, kept, words))
    lends = (F.col("conv_id") % 20 == 0) & (F.col("turn") < 3)
    rows = placed.select(F.inline(F.when(lends, F.concat(own, lent)).otherwise(own)))
    there = turns.select("conv_id").distinct()
    return rows.join(there, "conv_id", "left_semi")


# crc32 of the digits of a number, bit by bit
CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))))"""

ORACLES["op13_prefix_trie"] = rf"""
WITH turns AS (
    SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM turns),
heads AS (SELECT c, {CRC.format('c')} % 4 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
    SELECT h.c, p.pos, p.k, p.text FROM heads h JOIN placed p ON p.c = h.c - h.c % 20 AND p.pos < h.h
    UNION ALL SELECT h.c, p.pos, p.k, p.text FROM heads h JOIN placed p ON p.c = h.c AND p.pos >= h.h),
paths AS (
    SELECT c, text, row_number() OVER w AS depth, string_agg(k, '') OVER w AS node
    FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
every AS (
    SELECT c, depth, node, len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM paths
    UNION ALL SELECT c, 0, '', 0 FROM heads),
last AS (SELECT c, max(depth) AS depth FROM every GROUP BY c),
nodes AS (
    SELECT e.node, any_value(e.depth) AS depth, min(e.c) AS conv_id, count(*) AS n_convs, any_value(e.words) AS words,
        sha256(coalesce(string_agg(e.c::VARCHAR, ',' ORDER BY e.c) FILTER (l.depth = e.depth), '')) AS ends_sha256
    FROM every e JOIN last l USING (c) GROUP BY e.node),
children AS (SELECT n.*, n.node[:-33] AS parent, (SELECT count(*) FROM nodes m WHERE m.depth = n.depth + 1 AND m.node[:-33] = n.node) AS n_children FROM nodes n),
below AS (
    SELECT left(node, 32 * d::INT) AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS d FROM children) GROUP BY top)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM children c JOIN below ON below.top = c.node LEFT JOIN children p ON c.depth > 0 AND p.node = c.parent"""
