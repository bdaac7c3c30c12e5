"""Near copies by Jaccard similarity of word shingles: SimHash links, MinHash bands, sketch filter, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import digest, keep
from loomgraph.llm.simhash import linked_fingerprints, text_fingerprint
from loomgraph.operators.graph import connected_components

BLOCK = 1 << 12  # shingles worked on at once
HASHES, BANDS, ROWS = 256, 16, 5
DEVIATIONS = 4  # of the sketch's binomial spread


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    tokens = text.lower().split()
    spans = range(max(1, len(tokens) - words + 1)) if tokens else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), 42) for i in spans], np.uint64))


def minima(hashes: np.ndarray, salts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least value of each of `HASHES` hash functions over the lower halves."""
    low = hashes.astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), BLOCK):
        least = np.minimum(least, ((low[at : at + BLOCK, None] ^ salts) * factors).min(axis=0))
    return least


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """`(doc_id, row, node, fp, grams, bands, sketch)`: the digest of each document's shingle set, the SimHash fingerprint
    of its shingles, the set and its MinHash forms.

    `grams` are the upper halves of the hashes, which the MinHash does not use:
    a false link takes a collision in both.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240301)
        salts, factors = rng.integers(0, 1 << 32, (2, HASHES), dtype=np.uint32)
        factors |= np.uint32(1)
        for whole in batches:
            for b in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                node, fp, grams, bands, sketch = [], [], [], [], []
                for text in b.column("text").cast(pa.binary()).to_pylist():
                    hashes = shingle_hashes(text or b"", words)
                    least = minima(hashes, salts, factors)
                    fp.append(text_fingerprint(text or b"", words))
                    node.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    grams.append((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    parts = least[: BANDS * ROWS].reshape(BANDS, ROWS)
                    bands.append(np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], np.uint64).view(np.int64))
                    # a bit from the middle of a product: the values themselves are small
                    mixed = (least ^ least >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
                    sketch.append(np.packbits((mixed >> np.uint32(31)).astype(np.uint8)).view(np.int64))
                lists = []
                for arrays, kind in ((grams, pa.int32()), (bands, pa.int64()), (sketch, pa.int64())):
                    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays), kind)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("row"), pa.array(node, pa.binary()), pa.array(fp, pa.int64()), *lists],
                    ["doc_id", "row", "node", "fp", "grams", "bands", "sketch"],
                )

    rows = docs.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, row binary, node binary, fp long, grams array<int>, bands array<long>, sketch array<long>")


def most_bits(similarity: float) -> int:
    """Sketch bits that may differ at `similarity`: mean and `DEVIATIONS` spreads."""
    p = (1 - similarity) / 2
    return int(HASHES * p + DEVIATIONS * (HASHES * p * (1 - p)) ** 0.5) + 1


def near(a: str, b: str, similarity: float):
    """Whether sizes and sketches of two bucket rows leave room for `similarity`."""
    apart = sum(F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in range(HASHES // 64))
    sizes = F.least(f"{a}.n", f"{b}.n") >= similarity * F.greatest(f"{a}.n", f"{b}.n") - 1e-9
    return (F.col(f"{a}.node") < F.col(f"{b}.node")) & sizes & (apart <= most_bits(similarity))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs `(a, b)` whose shingle sets have the similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    union = F.size(F.array_distinct("a_grams")) + F.size(F.array_distinct("b_grams")) - shared
    return both.filter(shared >= similarity * union - 1e-9).select("a", "b")


def simhash_candidates(rows: DataFrame) -> DataFrame:
    """`(a, b)`: sets with one fingerprint meet the smallest of them, and so do the smallest of fingerprints two bits apart."""
    prints = rows.select("fp", "node").distinct()
    heads = keep(prints.groupBy("fp").agg(F.min("node").alias("head")), "near_copies")
    same = prints.join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    left, right = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head")) for c in "ab")
    linked = linked_fingerprints(heads).join(left, "a").join(right, "b")
    linked = linked.select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))
    return same.unionByName(linked).filter("a <> b").distinct()


def near_copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`(doc_id, row, component_id, kept)` for every document row.

    Documents are linked whose sets of `words`-word shingles (ASCII lower case)
    have a Jaccard similarity of `similarity` or more; every link is verified
    on the sets. Candidates have SimHash fingerprints at two differing bits or
    fewer; as that finds few pairs near 0.8, others share one of 16 bands of 5 MinHash values, which
    at 0.8 misses a pair with probability 0.002, and more the further below
    that `similarity` is. Component ids, `kept`, null ids, null texts and empty
    tables are as in `simhash_groups`; documents without words are one group.

    Equal sets are one node. Each bucket is first linked to its smallest
    member; after that only members in different components are compared, so a
    bucket of true copies costs its members, not its pairs.
    """
    rows = keep(shingle_sets(docs, words), "near_copies")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    nodes = keep(rows.groupBy("node").agg(F.min(first).alias("first")), "near_copies")
    one = rows.join(nodes, "node").filter(F.col("doc_id").eqNullSafe(F.col("first.i")) & (F.col("row") == F.col("first.r")))
    sets = one.select("node", "grams", "bands", "sketch").dropDuplicates(["node"])
    sets = keep(sets, "near_copies")
    # sizes and sketches join the members of shared buckets only: most buckets have one member
    members = sets.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = members.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("node").alias("head")).filter("m > 1").drop("m")
    forms = sets.select("node", F.size("grams").alias("n"), "sketch")
    buckets = keep(members.join(shared, ["band", "key"]).join(forms, "node"), "near_copies")

    heads = buckets.filter("node = head").alias("x")
    met = heads.hint("merge").join(buckets.alias("y"), ["band", "key"]).filter(near("x", "y", similarity))
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).unionByName(simhash_candidates(rows)).distinct()
    stars = keep(verified(met, sets, similarity), "near_copies")
    placed = connected_components(nodes.select("node"), stars)
    open_rows = keep(buckets.drop("head").join(placed, "node"), "near_copies")
    met = open_rows.alias("x").hint("merge").join(open_rows.alias("y"), ["band", "key"])
    met = met.filter(near("x", "y", similarity) & (F.col("x.component") != F.col("y.component")))
    rest = keep(verified(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), sets, similarity), "near_copies")

    placed = connected_components(nodes.select("node"), stars.unionByName(rest)).join(nodes, "node")
    groups = placed.select("node", "component").join(placed.groupBy("component").agg(F.min("first").alias("head")), "component")
    out = rows.select("doc_id", "row", "node").join(groups.select("node", "head"), "node")
    kept = F.col("doc_id").eqNullSafe(F.col("head.i")) & (F.col("row") == F.col("head.r"))
    return out.select("doc_id", "row", F.col("head.i").alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of near copies, all columns kept.

    Rows that agree in id and text are one document: a single one stays.
    """
    groups = near_copy_groups(docs, words, similarity)
    chosen = groups.filter("kept").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    keyed = docs.withColumn("_text", digest(F.coalesce("text", F.lit(""))))
    met = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_row")))
    return met.dropDuplicates(["doc_id", "_text"]).select(*docs.columns)
