"""Vector search over an inverted file: exact and probed top k, filters and hybrid ranking."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import let
from loomgraph.operators import vector_index
from loomgraph.runtime import top_k_per_group


def unit(c: Column) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    v = F.transform(c, lambda x: x.cast("double"))

    def scale(p: Column) -> Column:
        norm = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(p, lambda x: F.when(n > 0, x / n).otherwise(x)))

    return let(v, scale)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k_cosine(queries: DataFrame, vectors: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """Exact top k by cosine of every query: `queries(qid, embedding)`, `vectors(vid, embedding)`, bigint ids.

    The vectors are indexed by cell; a query meets only the cells that can hold one of its best. Keep the index with
    `vector_index.build_index` where many searches follow.
    """
    return vector_index.search(vector_index.build_index(vectors), queries, k, exact=True, drop_self=drop_self)


def scored_against(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """`vectors` with their cosine to one query as `score`; filter and cut it like any other column."""
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    target = F.array(*[F.lit(x / norm) for x in query])
    return vectors.withColumn("score", cosine(unit(F.col("embedding")), target))


def candidate_pairs(vectors: DataFrame, k: int = 8, threshold: float = 0.45) -> DataFrame:
    """Nearest-neighbour pairs `(a, b, score)` among each vector's best `k`, each kept once with a < b."""
    asked = vectors.select(F.col("vid").alias("qid"), "embedding")
    near = vector_index.search(vector_index.build_index(vectors), asked, k, exact=True, drop_self=True, least=threshold)
    near = near.filter(F.col("vid") > F.col("qid"))
    return near.select(F.col("qid").alias("a"), F.col("vid").alias("b"), "score")


def post_filter(hits: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Equality or membership on metadata; an unknown key or a missing value passes."""
    for key, value in filters.items():
        if key in hits.columns:
            wanted = F.col(key).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(key) == F.lit(value)
            hits = hits.filter(F.col(key).isNull() | wanted)
    return hits


def index_search(
    index: vector_index.VectorIndex,
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    filters: Mapping[str, object] | None = None,
    probes: int = vector_index.PROBES,
    exact: bool = False,
) -> DataFrame:
    """Top k of every query with the columns of `vectors`: twice as many from the index, then the filter, then the cut."""
    hits = vector_index.search(index, queries, 2 * k, probes, exact).drop("rank")
    named = hits.join(vectors.drop("embedding"), "vid")
    return top_k_per_group(post_filter(named, filters or {}), ["qid"], [F.desc("score"), F.col("vid")], k)


def hybrid_ranking(text_hits: DataFrame, vector_hits: DataFrame, key: str, k: int) -> DataFrame:
    """Union of text and vector hits, each item with its best score."""
    both = text_hits.select(key, "score").unionByName(vector_hits.select(key, "score"))
    return both.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def context_text(title: Column, number: Column, topic: Column, parties: Column, abstract: Column, status: Column) -> Column:
    """Readable context of a hit; the abstract is cut at 500 characters."""
    short = F.when(F.length(abstract) > 500, F.concat(F.substring(abstract, 1, 500), F.lit("..."))).otherwise(abstract)

    def line(label: str, c: Column) -> Column:
        return F.concat(F.lit(label), F.coalesce(c, F.lit("N/A")))

    return F.concat_ws(
        "\n",
        line("title: ", title),
        line("number: ", number),
        line("topic: ", topic),
        line("parties: ", parties),
        F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(F.lit("abstract: "), short)),
        F.when(F.coalesce(status, F.lit("")) != "", F.concat(F.lit("status: "), status)),
    )
