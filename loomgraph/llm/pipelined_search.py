"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks: a posting list per block and term. Terms have owners by their weight, the rarest ones
with the first owner. A bundle of items starts at every block with nothing; at each owner in turn a cogroup brings it
together with that owner's postings of the block, whose integer contributions are added to the sparse accumulators
(document, score) that the bundle carries on. Common terms come last, so accumulators stay few while they travel; those
that the terms still to come cannot lift into the block's best are left behind, which changes no result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import keep, lower_ascii
from loomgraph.runtime import scratch_path

OWNERS = 4  # stages of the pipeline
BUNDLE = 64  # items of a bundle, about
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 400_000  # bounds of a block
FILTER_BITS = 1 << 23  # size of the term filter: a megabyte, whatever the number of items
REMEMBERED = 1 << 18  # terms of which a worker remembers whether the filter passes them
UNIT = 1_000_000  # a term adds less than its weight times this to a score

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# bytes of a text: A-Z to a-z, ASCII that is neither letter nor digit to a space
TO_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), 0)


class TermFilter:
    """Bitmap of the terms asked for, of fixed size: it may pass others, never stops one of them."""

    def __init__(self, item_terms: DataFrame):
        bit = F.xxhash64("term").bitwiseAND(FILTER_BITS - 1) + 1
        rows = item_terms.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        whole = bytearray(FILTER_BITS // 8)
        for bucket, bits in rows.collect():  # at most FILTER_BITS / 32768 rows of 4 kB
            whole[(bucket - 1) * len(bits) : bucket * len(bits)] = bits
        self.bits = bytes(whole)

    def passes(self, term: bytes) -> bool:
        bit = xxhash.xxh64_intdigest(term, 42) & (FILTER_BITS - 1)
        return self.bits[bit >> 3] >> (bit & 7) & 1 == 1


class Passing(dict):
    """What the filter said of a term, remembered."""

    def __init__(self, terms: TermFilter):
        self.terms = terms

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        self[term] = self.terms.passes(term)
        return self[term]


class Block:
    """Documents on their way into posting lists."""

    def __init__(self, name: str):
        self.name, self.docs, self.size = name, [], 0
        self.terms: dict[bytes, int] = {}

    def add(self, doc_id, n: int, found: dict[bytes, int]) -> None:
        numbers = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in found), np.int32, len(found))
        self.docs.append((doc_id, n, numbers, np.fromiter(found.values(), np.int32, len(found))))
        self.size += len(found)

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        """One row of the documents in order of their ids, null last, then one of each posting list."""
        self.docs.sort(key=lambda d: (d[0] is None, d[0]))
        sizes = np.array([len(d[2]) for d in self.docs])
        lengths = np.array([d[1] for d in self.docs], np.int64)
        term, tf = (np.concatenate([d[i] for d in self.docs]) for i in (2, 3))
        doc = np.repeat(np.arange(len(self.docs), dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        edges = np.searchsorted(term, np.arange(len(self.terms) + 1))
        n = lengths[doc]
        cut = [(a, b) for a, b in zip(edges, edges[1:])]
        rows = [
            [self.name] * (len(cut) + 1),
            [None, *(t.decode() for t in self.terms)],
            [None, *(doc[a:b].tobytes() for a, b in cut)],
            [None, *(tf[a:b].tobytes() for a, b in cut)],
            [None, *(n[a:b].tobytes() for a, b in cut)],
            [int((lengths > 0).sum()), *(b - a for a, b in cut)],
            [int(lengths.sum()), *([None] * len(cut))],
            [[d[0] for d in self.docs], *([None] * len(cut))],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


def index_documents(docs: DataFrame, terms: TermFilter) -> DataFrame:
    """Blocks of the documents: `(block, term, docs, tfs, lengths, n, n_terms, doc_ids)`, written to the shared folder.

    A row with a term is a posting list of offsets in the block, occurrences and document lengths; the row without one
    names the documents by offset. Terms that the filter stops count in the lengths only.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("block", T.StringType()), T.StructField("term", T.StringType())]
    fields += [T.StructField(c, T.BinaryType()) for c in ("docs", "tfs", "lengths")]
    fields += [T.StructField(c, T.LongType()) for c in ("n", "n_terms")] + [T.StructField("doc_ids", T.ArrayType(kind))]
    out = T.StructType(fields)

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, passing = to_arrow_schema(out), Passing(terms)
        task, made = TaskContext.get().partitionId(), 0
        block = Block(f"{task}-0")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(TO_TERMS).split()
                block.add(doc_id, len(tokens), {t: c for t, c in Counter(tokens).items() if passing[t]})
                if len(block.docs) >= BLOCK_DOCS or block.size >= BLOCK_POSTINGS:
                    yield block.rows(schema)
                    made += 1
                    block = Block(f"{task}-{made}")
        if block.docs:
            yield block.rows(schema)

    return keep(docs.select("doc_id", "text").mapInArrow(run, out), "search-index")


def routes(item_terms: DataFrame, found: DataFrame, n_docs: int, bundles: int) -> DataFrame:
    """`(term, bundle, owner, weight, items(item, rest))`: where a term's postings go, and what the later owners can
    still add to each of the items that ask for it."""
    most = max(1, math.floor(1000 * math.log((2 * n_docs + 2) / 3)))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    placed = item_terms.join(found.groupBy("term").agg(F.sum("n").alias("df")), "term").withColumn("weight", weight)
    owner = F.floor(OWNERS * (1 - F.col("weight") / most))
    placed = placed.withColumn("owner", F.greatest(F.lit(0), F.least(F.lit(OWNERS - 1), owner)).cast("int"))
    sums = placed.groupBy("item", "owner").agg(F.sum("weight").alias("w"))
    later = Window.partitionBy("item").orderBy(F.col("owner").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("item").alias("of"), F.col("owner").alias("at"), (F.coalesce(F.sum("w").over(later), F.lit(0)) * UNIT).alias("rest"))
    placed = placed.join(sums, F.col("item").eqNullSafe(F.col("of")) & (F.col("owner") == F.col("at"))).drop("of", "at")
    bundle = F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle")
    return placed.groupBy("term", bundle, "owner", "weight").agg(F.collect_list(F.struct("item", "rest")).alias("items"))


def impacts(tf: np.ndarray, length: np.ndarray, weight: int, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the score of each document, in integers."""
    if 50 * int(length.max(initial=0)) * n_docs >= 1 << 63:
        length = length.astype(object)
    m = 50 + (50 * length * n_docs) // n_terms
    return weight * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m.astype(np.int64)))


STATE = pa.schema([("block", pa.string()), ("bundle", pa.int32()), ("item", pa.string()), ("docs", pa.binary()), ("scores", pa.binary())])
BEST = pa.schema([("block", pa.string()), ("item", pa.string()), ("docs", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64()))])


def visit(n_docs: int, n_terms: int, top: int, last: bool):
    """The work of an owner: a bundle's accumulators for a block and the owner's postings of it give the accumulators."""

    def run(key, carried: pa.Table, postings: pa.Table) -> pa.Table:
        more, rest = defaultdict(list), defaultdict(int)
        for row in carried.select(["item", "docs", "scores"]).to_pylist():
            more[row["item"]].append((np.frombuffer(row["docs"], np.int32), np.frombuffer(row["scores"], np.int64)))
        for row in postings.select(["docs", "tfs", "lengths", "weight", "items"]).to_pylist():
            docs = np.frombuffer(row["docs"], np.int32)
            adds = impacts(np.frombuffer(row["tfs"], np.int32), np.frombuffer(row["lengths"], np.int64), row["weight"], n_docs, n_terms)
            for item in row["items"]:
                more[item["item"]].append((docs, adds))
                rest[item["item"]] = item["rest"]
        out = []
        for item, parts in more.items():
            sums = np.zeros(1 + max(int(docs[-1]) for docs, _ in parts), np.int64)
            for docs, adds in parts:
                sums[docs] += adds
            docs = np.flatnonzero(sums).astype(np.int32)
            scores = sums[docs]
            if len(docs) > top:
                least = np.partition(scores, -top)[-top]
                # an item that this owner did not touch waits for a later one
                stay = scores + rest[item] >= least if last or item in rest else slice(None)
                docs, scores = docs[stay], scores[stay]
            if last:
                best = np.lexsort((docs, -scores))[:top]
                out.append((item, docs[best], scores[best]))
            elif len(docs):
                out.append((item, docs.tobytes(), scores.tobytes()))
        block, bundle = key[0].as_py(), key[1].as_py()
        items, docs, scores = (list(c) for c in zip(*out)) if out else ([], [], [])
        if last:
            return pa.Table.from_arrays([pa.array([block] * len(items)), pa.array(items, pa.string()), pa.array(docs, BEST.types[2]), pa.array(scores, BEST.types[3])], schema=BEST)
        columns = [[block] * len(items), [bundle] * len(items), items, docs, scores]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, STATE)], schema=STATE)

    return run


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the `top` documents of each item with a score above 0, equal scores by `doc_id`.

    `docs(doc_id, text)`, `items(item_id, text)`; other columns are ignored. Terms are runs of letters and digits and of
    anything beyond ASCII, only A-Z lower-cased; a null or empty text has none. Rows of one `item_id`, null included, are
    one item; every row of `docs` is a document of its own, so repeated ids can be ranked twice, a null id comes last
    among equal scores. Empty tables give no rows. A task holds a block's postings for a bundle of items.
    """
    asked = items.select(F.col("item_id").cast("string").alias("item"), F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    index = index_documents(docs, TermFilter(asked))
    found, blocks = index.filter("term IS NOT NULL"), index.filter("term IS NULL")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    bundles = max(1, -(-asked.select("item").distinct().count() // BUNDLE))
    routed = found.drop("n", "n_terms", "doc_ids").join(routes(asked, found, n_docs, bundles), "term")
    place = scratch_path(docs.sparkSession, "search-postings")
    routed.write.partitionBy("owner").parquet(place)
    routed = docs.sparkSession.read.schema(routed.schema).parquet(place)
    state = docs.sparkSession.createDataFrame([], "block string, bundle int, item string, docs binary, scores binary")
    for owner in range(OWNERS):
        last = owner == OWNERS - 1
        out = "block string, item string, docs array<int>, scores array<bigint>" if last else state.schema
        own = routed.filter(F.col("owner") == owner).groupBy("block", "bundle")
        state = state.groupBy("block", "bundle").cogroup(own).applyInArrow(visit(n_docs, max(1, n_terms), top, last), out)
    named = state.join(blocks.select("block", "doc_ids"), "block")
    one = F.explode(F.arrays_zip("docs", "scores")).alias("one")
    hits = named.select("item", "doc_ids", one).select("item", F.element_at("doc_ids", F.col("one.docs") + 1).alias("doc_id"), F.col("one.scores").alias("score"))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= top) & (F.col("score") > 0))
    return ranked.select(F.col("item").cast(items.schema["item_id"].dataType).alias("item_id"), F.col("rank").cast("int"), "doc_id", "score")
