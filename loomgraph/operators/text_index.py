"""Stored postings for many searches: posting lists by term and shard, with the best score that a list can give.

Documents are dealt out in shards of about the same size, short texts apart from long ones. A row of the index is the
posting list of a term in a shard. Its bound is the largest term weight in it before the rarity factor, so the bounds of
a query's terms add up to a bound for the shard. A search scores the most promising shards first; the k-th best score
found there tells which of the others cannot matter, and their lists are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.search import BM25_B, BM25_K1, keywords_of, term_counts, tokens, whole_documents
from loomgraph.runtime import cut_lineage, scratch_path, top_k_per_group

SHARD_DOCS = 512  # documents of a shard, about
BUCKETS = 64  # folders of the lists; a search reads those of its terms
FIRST_SHARDS = 8  # shards scored before the others are judged
ROUNDING = 1e-6  # sums of equal terms may differ in their last digits


@dataclass
class TextIndex:
    path: str
    key: str
    key_type: str
    docs: int
    mean: float

    def lists(self, spark: SparkSession) -> DataFrame:
        """`(bucket, term, shard, bound, n, postings(key, part))`."""
        columns = f"term string, shard bigint, bound double, n bigint, postings array<struct<key: {self.key_type}, part: double>>, bucket int"
        return spark.read.schema(columns).parquet(f"{self.path}/lists")

    def terms(self, spark: SparkSession) -> DataFrame:
        """`(term, df)`."""
        return spark.read.parquet(f"{self.path}/terms")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_text_index(texts: DataFrame, key: str = "item_id", path: str | None = None) -> TextIndex:
    """Index `texts(key, text)` below `path`, a new folder of the shared one by default.

    Rows of one key are one document; a null key is a document too. A null or empty text has no terms but counts as a
    document. Two shuffles: the texts by key, and the postings by term and shard; a task holds one list at a time with at
    most a few shards' worth of documents.
    """
    spark = texts.sparkSession
    path = path or scratch_path(spark, "text-index")
    split = texts.select(F.col(key).alias("key"), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("w"))
    split.groupBy("key").agg(F.sum(F.size("w")).alias("length")).write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs").withColumn("level", F.length(F.bin(F.col("length"))))
    n, mean = docs.agg(F.count("*"), F.avg("length")).first()
    # one row for each power of two that a text can be long
    shards = {r["level"]: max(1, round(r["count"] / SHARD_DOCS)) for r in docs.groupBy("level").count().collect()}
    many = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.col("level")) if shards else F.lit(1)
    shard = F.shiftleft(F.col("level").cast("long"), 40) + F.pmod(F.xxhash64("key"), many)
    # the texts move once, by key; the words of a document are counted where they are
    whole = whole_documents(texts.select(F.col(key).alias("key"), "text"), "key")
    whole = whole.withColumn("length", F.size("w")).withColumn("level", F.length(F.bin(F.col("length"))))
    counts = term_counts(whole.select("key", "length", shard.alias("shard"), "w"))
    part = F.col("tf") / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(mean or 1.0)))
    # the postings move once, to the folder that they are written to
    found = counts.select(bucket_of(F.col("term")).alias("bucket"), F.pmod(F.xxhash64("shard"), F.lit(16)).alias("deal"), "term", "shard", "key", part.alias("part"))
    lists = found.repartition("bucket", "deal").groupBy("bucket", "deal", "term", "shard").agg(
        F.max("part").alias("bound"), F.count("*").alias("n"), F.collect_list(F.struct("key", "part")).alias("postings")
    )
    lists.drop("deal").sortWithinPartitions("bucket", "term", "shard").write.partitionBy("bucket").parquet(f"{path}/lists")
    index = TextIndex(path, key, texts.schema[key].dataType.simpleString(), n, mean or 0.0)
    stored = index.lists(spark).groupBy("term").agg(F.sum("n").alias("df"))
    stored.write.parquet(f"{path}/terms")
    return index


def search_many(index: TextIndex, queries: DataFrame, k: int, minimum: float = 0.0) -> DataFrame:
    """`(qid, key, score, rank)`: the best `k` documents of every row of `queries(qid, query)` with a score above `minimum`.

    BM25, scores equal to nine digits by key. Words of a query count once; rows of one `qid` are one query. Shards are skipped where the
    bounds of a query's terms stay below its k-th best score so far, which loses nothing.
    """
    asked = queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).distinct()
    return _search(index, asked, k, minimum, None)


def search(index: TextIndex, query: str, k: int | None = None, minimum: float = 0.0) -> DataFrame:
    """`(key, score)` of one query: its best `k` documents, or all with a score above `minimum`."""
    words = keywords_of(query)
    spark = SparkSession.active()
    asked = spark.createDataFrame([(w,) for w in words], "term string").withColumn("qid", F.lit(0))
    hits = _search(index, asked, k, minimum, words)
    return hits.select(F.col("key").alias(index.key), "score")


def _search(index: TextIndex, asked: DataFrame, k: int | None, minimum: float, words: list[str] | None) -> DataFrame:
    spark = asked.sparkSession

    def stored() -> DataFrame:
        lists = index.lists(spark)
        if words is None:
            return lists
        wanted = spark.createDataFrame([(w,) for w in words or [""]], "t string").select(bucket_of(F.col("t"))).distinct()
        buckets = [r[0] for r in wanted.collect()]  # one for each word of the query
        return lists.filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))

    rarity = F.log(1 + (index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # a few rows for each query, stored so that Spark sees how few
    path = scratch_path(spark, "asked")
    asked.join(index.terms(spark), "term").select("qid", "term", rarity.alias("idf")).write.parquet(path)
    weighed = spark.read.parquet(path)
    bounds = stored().select("term", "shard", "bound").join(weighed, "term")
    bounds = bounds.groupBy("qid", "shard").agg(F.sum(F.col("idf") * F.col("bound")).alias("most")).filter(F.col("most") >= minimum - ROUNDING)
    bounds = cut_lineage(bounds)

    def scored(pairs: DataFrame) -> DataFrame:
        """The lists of a shard come together and are scored there, so that no single part of a score moves."""
        here = pairs.groupBy("shard").agg(F.collect_set(F.struct("qid")).alias("qs"))
        found = stored().select("term", "shard", "postings").repartition("shard").join(here, "shard")
        one = found.join(weighed, "term").filter(F.array_contains("qs", F.struct("qid"))).select("qid", "shard", "idf", F.inline("postings"))
        return one.groupBy("qid", "shard", "key").agg(F.sum(F.col("idf") * F.col("part")).alias("score")).filter(F.col("score") > minimum)

    order = [F.round("score", 9).desc(), F.col("key")]
    if k is None:
        return scored(bounds).drop("shard")

    def best(pairs: DataFrame) -> DataFrame:
        at_shard = F.row_number().over(Window.partitionBy("qid", "shard").orderBy(*order))
        few = scored(pairs).withColumn("n", at_shard).filter(F.col("n") <= k)
        return top_k_per_group(few.select("qid", "key", "score"), ["qid"], order, k)

    best_first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("most"), "shard"))
    start = best(bounds.withColumn("n", best_first).filter(F.col("n") <= FIRST_SHARDS))
    kth = start.groupBy(F.col("qid").alias("of")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    left = bounds.join(kth, F.col("qid").eqNullSafe(F.col("of")), "left").filter(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - ROUNDING))
    return best(left)
