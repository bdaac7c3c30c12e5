"""Documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, line_dedup, mixing, near_copies, queries, toxicity
from loomgraph.llm.common import keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay as they are."""
    scored = toxicity.score_toxicity(docs.select(*COLUMNS), queries.toxicity_model(spark, sf_dir))
    return scored.filter("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; `n_chars` follows the text, documents without lines left stay, empty."""
    done = line_dedup.drop_frequent_lines(docs.select(*COLUMNS))
    changed = F.col("n_dropped") > 0
    return done.select(
        "doc_id",
        F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at Jaccard similarity 0.8 over five-word shingles stays, the one with the smallest id."""
    return near_copies.drop_near_copies(docs.select(*COLUMNS), words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with their text, size and words taken."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS))
    return mixed.filter("taken > 0").select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# toxicity, MinHash and the edit distance search have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
