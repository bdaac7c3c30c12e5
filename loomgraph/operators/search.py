"""Full-text search as DataFrame aggregates, and its combinations with the graph filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loomgraph.binding import GraphBinding
from loomgraph.operators.filters import FLAG_KEYS, FULLTEXT_KEYS, filtered_items
from loomgraph.operators.joins import with_neighbours
from loomgraph.operators.sets import merge_results
from loomgraph.runtime import with_once, with_scalars

# fixed values: BM25 parameters
BM25_K1 = 1.2
BM25_B = 0.75
TOKEN_PATTERN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.array_remove(F.split(F.lower(text), TOKEN_PATTERN), "")


def keywords_of(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def _occurrences(words: str, term: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, term))


def _bm25(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def text_search(texts: DataFrame, query: str, key: str = "item_id", minimum: float = 0.0) -> DataFrame:
    """Documents that hold a query word, with their BM25 score above `minimum`.

    One search over texts that are not indexed: term frequencies are computed row by row, only the collection
    statistics (one row) are aggregated, and a shuffle below `texts` serves both. Many searches over the same texts
    should use `text_index`.
    """
    words = keywords_of(query)
    docs = with_once(texts.select(key, "text"), "w", tokens(F.col("text")))
    counts = F.struct(F.size("w").alias("length"), *[_occurrences("w", t).alias(f"tf{i}") for i, t in enumerate(words)])
    docs = with_once(docs.select(key, "w"), "c", counts).select(key, "c.*")
    stats = docs.agg(
        F.count("*").alias("n"),
        F.avg("length").alias("mean"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))],
    )
    hit = F.lit(False)
    for i in range(len(words)):
        hit = hit | (F.col(f"tf{i}") > 0)
    scored = with_scalars(docs.filter(hit), stats)
    score = F.lit(0.0)
    for i in range(len(words)):
        score = score + _bm25(F.col(f"tf{i}"), F.col(f"g.df{i}"), F.col("g.n"), F.col("length"), F.col("g.mean"))
    return scored.select(key, score.alias("score")).filter(F.col("score") > minimum)


def contains_search(texts: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Fallback: the first keyword as a substring, every score 1.0."""
    first = query.split()[0] if query.split() else ""
    hits = texts.filter(F.col("text").contains(first)).select(key, F.lit(1.0).alias("score"))
    return hits.orderBy(key).limit(k)


def search_items(graph: GraphBinding, query: str, k: int = 20, minimum: float = 0.5) -> DataFrame:
    """Best items of a text query with their topic and at most three parties."""
    hits = text_search(graph.texts(), query, "item_id", minimum).orderBy(F.desc("score"), "item_id").limit(k)
    found = hits.join(graph.items().select("item_id", "title", "item_date"), "item_id")
    found = with_neighbours(found, graph.relation("topic"), "topic_name", "topics", 1)
    return with_neighbours(found, graph.relation("party"), "party_name", "applicants", 3)


def search_then_filter(
    graph: GraphBinding,
    query: str,
    filters: Mapping[str, object],
    minimum: float = 0.0,
    keep: str | None = None,
    hits: DataFrame | None = None,
) -> DataFrame:
    """Text hits first, then the structured filters that act on this path; others are ignored.

    `hits(item_id, score)` come from an index where there is one, else the texts of the graph are searched.
    """
    active = {k: v for k, v in filters.items() if k in FULLTEXT_KEYS}
    for key in FLAG_KEYS:
        if active.get(key) is False and key != "has_transfer":
            active.pop(key)
    flags = any(active.get(k) is not None for k in FLAG_KEYS)
    if hits is None:
        hits = text_search(graph.texts(), query, "item_id", minimum)
    base = graph.items(counters=flags).join(hits, "item_id")
    return filtered_items(graph, active, keep=keep, base=base)


# filter keys whose values become keywords of a supplementary search
SUPPLEMENT_KEYS = [
    "org",
    "domain",
    "keywords",
    "region",
    "inventor",
    "transferor",
    "transferee",
    "licensor",
    "licensee",
    "pledgor",
    "pledgee",
    "rights_holder",
    "litigation_party",
    "litigation_type",
]


def supplement_keywords(filters: Mapping[str, object]) -> list[str]:
    return [str(filters[k]) for k in SUPPLEMENT_KEYS if filters.get(k)]


def supplement(original: DataFrame, extra: Sequence[DataFrame], key: str, minimum: int, limit: int = 10) -> DataFrame:
    """Add the extra hits, in their order, only when there are fewer than `minimum` results.

    The condition is a scalar subquery over at most `minimum` rows, so the
    decision is part of the one plan.
    """
    short = original.select(key).limit(minimum).agg((F.count("*") < minimum).alias("b")).select("b").scalar()
    merged = None
    for i, hits in enumerate(extra):
        tagged = hits.select(key, F.lit(i).alias("strategy"), F.col("score"))
        merged = tagged if merged is None else merged.unionByName(tagged)
    best = merged.groupBy(key).agg(F.min(F.struct("strategy", (-F.col("score")).alias("neg"))).alias("b"))
    fresh = best.join(original.select(key), key, "left_anti")
    fresh = fresh.orderBy("b.strategy", "b.neg", key).limit(limit).select(key)
    return merge_results(original.select(key), fresh.filter(short), key, key)


def whole_documents(texts: DataFrame, key: str) -> DataFrame:
    """`(key, w)` with the words of every document; rows of one key are one document. The texts move once."""
    parts = texts.select(key, "text").repartition(key).groupBy(key).agg(F.collect_list(tokens(F.col("text"))).alias("w"))
    return parts.withColumn("w", F.flatten("w"))


def term_counts(documents: DataFrame) -> DataFrame:
    """The columns of `documents(w, ...)` but `w`, and `term, tf`: runs in the sorted words, one document at a time."""
    kept = [c for c in documents.columns if c != "w"]
    docs = with_once(documents.filter(F.size("w") > 0), "s", F.sort_array("w"))
    new = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    docs = with_once(docs.select(*kept, "s"), "at", F.concat(new, F.array(F.size("s"))))
    runs = F.transform(
        F.slice("at", F.lit(1), F.size("at") - 1),
        lambda start, j: F.struct(F.get("s", start).alias("term"), (F.get("at", j + 1) - start).cast("long").alias("tf")),
    )
    return docs.select(*kept, F.inline(runs))


def tfidf_weights(texts: DataFrame, key: str) -> DataFrame:
    """`(key, term, weight)`: the TF-IDF weights in long form, over the whole vocabulary.

    `weight` is tf * ln((n + 1) / (df + 1)). The texts move once, their counts once to meet the
    document frequencies, which are counted map-side: a common word costs one row a task.
    """
    words = term_counts(whole_documents(texts, key))
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("n"))
    weight = F.col("tf") * F.log((F.col("g.n") + 1) / (F.col("df") + 1))
    return with_scalars(words.join(df, "term"), total).select(key, "term", weight.alias("weight"))


def tfidf_vectors(texts: DataFrame, key: str, features: int = 5000, dims: int = 1024) -> DataFrame:
    """TF-IDF reduced by principal components and padded with zeros to `dims`.

    The only driver-side state is the feature Gram matrix, bounded by `features` squared.
    """
    rank = min(dims, features - 1)
    stages = Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="w", pattern=TOKEN_PATTERN, toLowercase=True),
            CountVectorizer(inputCol="w", outputCol="tf", vocabSize=features),
            IDF(inputCol="tf", outputCol="tfidf"),
        ]
    )
    weighted = stages.fit(texts).transform(texts)
    size = weighted.select(F.size(vector_to_array("tfidf"))).first()
    rank = min(rank, size[0] - 1 if size else rank)
    reduced = PCA(k=rank, inputCol="tfidf", outputCol="v").fit(weighted).transform(weighted)
    padded = F.concat(vector_to_array("v"), F.array_repeat(F.lit(0.0), dims - rank))
    return reduced.select(key, padded.alias("embedding"))


def encode(texts: DataFrame, key: str, encoder: Callable[[pd.Series], pd.Series] | None = None, dims: int = 1024) -> DataFrame:
    """`(key, embedding)` from a batch encoder; TF-IDF vectors without one."""
    if encoder is None:
        return tfidf_vectors(texts, key, dims=dims)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batch: pd.Series) -> pd.Series:
        return encoder(batch)

    return texts.select(key, run("text").alias("embedding"))


def tagged_spans(texts: DataFrame, key: str, tag: str = "answer") -> DataFrame:
    """Every tagged span of every text as its own row."""
    spans = F.regexp_extract_all("text", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return texts.select(key, F.posexplode(spans).alias("n", "span"))
