"""Corpus-wide line deduplication [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE, digest, lower_ascii


def line_keys(text: Column) -> Column:
    """The key of every line: stripped of ASCII white space, A-Z in lower case."""
    return F.transform(F.split(lower_ascii(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """`(h)`: digests of the keys of at least `min_chars` code points in at least `min_docs` documents.

    Repeats inside a document go before the lines are exploded; the count is
    combined map-side, so a line that every document has costs one row a task.
    """
    keys = F.filter(line_keys(F.coalesce("text", F.lit(""))), lambda k: F.char_length(k) >= min_chars)
    one_per_doc = F.explode(F.array_distinct(F.transform(keys, digest))).alias("h")
    return docs.select(one_per_doc).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """`docs` with columns `kept` (the text without frequent lines), `n_lines` and `n_dropped`.

    A line is dropped, in every document, when its key has `min_chars` code
    points and is found in `min_docs` documents. A row is a document: repeated
    rows count one each, whatever their ids, and null ids are kept. A null or
    empty text is one empty line, which has no key and stays. The columns
    `kept`, `n_lines` and `n_dropped` replace columns of those names; all others
    stay untouched. An empty table gives an empty table.

    Lines are exploded with their positions and met with the frequent digests
    by a semi-join; the positions found are gathered per distinct text and the
    text is reassembled from the others. Which lines go depends on the text
    alone, so the text's digest is the key of a row: copies share one entry, no
    row id is needed, and both joins are plain equi-joins whose hot keys (a
    common line, a text with thousands of copies) are split at run time.
    """
    clash = [c for c in docs.columns if c.lower() in ("kept", "n_lines", "n_dropped", "_row", "_gone")]
    docs = docs.drop(*clash)
    text = F.coalesce("text", F.lit(""))
    frequent = frequent_lines(docs, min_docs, min_chars)
    placed = docs.select(digest(text).alias("_row"), F.posexplode(line_keys(text)).alias("_pos", "_key"))
    placed = placed.filter(F.char_length("_key") >= min_chars).select("_row", "_pos", digest(F.col("_key")).alias("h"))
    gone = placed.join(frequent, "h", "left_semi").groupBy("_row").agg(F.collect_set("_pos").alias("_gone"))
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    rebuilt = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return (
        docs.withColumn("_row", digest(text))
        .join(gone, "_row", "left")
        .withColumn("kept", F.when(F.col("_gone").isNull(), text).otherwise(rebuilt))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
        .drop("_row", "_gone")
    )
