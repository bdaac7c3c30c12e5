"""SimHash near-duplicates by a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import digest, keep
from loomgraph.operators.graph import connected_components

BLOCK = 1 << 16
SEGMENT = 2  # bits; 32 segments of counts 0..2


def text_fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words.

    `bytes.lower` and `bytes.split` touch ASCII letters and white space only.
    Long texts are counted in blocks, so memory follows the text, not its bits.
    """
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate((len(t) + 1 for t in tokens)))
    starts = [0, *ends[:-1]]
    hash_of = xxhash.xxh64_intdigest
    spans = list(zip(starts, ends[words - 1 :])) or [(0, ends[-1])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), BLOCK):
        hashes = np.array([hash_of(joined[s : e - 1], seed) for s, e in spans[at : at + BLOCK]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """`(doc_id, row, fp)`: id, digest of the text and fingerprint of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fp = pa.array([text_fingerprint(t or b"", words) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), fp], ["doc_id", "row", "fp"])

    rows = docs.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, row binary, fp long")


def grid_cells(prints: DataFrame) -> DataFrame:
    """`(cell, fp)`: the grid cells within Manhattan distance 1 of each fingerprint's embedding.

    The embedding counts the bits of every segment, so a bit that differs moves
    it by 1 at most: Manhattan distance is a lower bound of Hamming distance.
    Two points at distance 2 or less have a lattice point within 1 of both, so
    each pair in reach meets in some cell. A cell's name is a linear hash of
    its counts; a collision only adds a candidate.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 64 // SEGMENT
        name = np.random.default_rng(20240229).integers(1, 1 << 63, n, dtype=np.uint64) * 2 + 1
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = bits.reshape(len(fp), n, SEGMENT).sum(axis=2, dtype=np.uint64)
            base = (counts * name).sum(axis=1, dtype=np.uint64)
            up, down = base[:, None] + name, base[:, None] - name
            i, j = np.nonzero(counts < SEGMENT)
            k, m = np.nonzero(counts > 0)
            cell = np.concatenate([base, up[i, j], down[k, m]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([fp, fp[i], fp[k]]))], ["cell", "fp"])

    return prints.select("fp").mapInArrow(work, "cell long, fp long")


def linked_fingerprints(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """`(a, b)`: all pairs of distinct fingerprints at `max_bits` (0 to 2) or fewer differing bits.

    Candidates meet in a grid cell and are verified exactly inside the join.
    The distinct fingerprints within 2 bits of one are at most 2,080, so the
    pairs are linear in the fingerprints however large a group of copies is.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    cells = grid_cells(prints)
    left, right = cells.select("cell", F.col("fp").alias("a")), cells.select("cell", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # the cells are many times the rows that the planner can see: never broadcast them
    met = left.hint("merge").join(right, "cell").filter((F.col("a") < F.col("b")) & near)
    return met.select("a", "b").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """`(doc_id, row, fp, component_id, kept)` for every document row.

    Fingerprints that differ in `max_bits` bits or fewer are linked;
    `component_id` is the smallest id reachable over links, the document's own
    included. Null and empty texts have fingerprint 0 and are linked like any
    other. Null ids are never a component's id unless it has no other (then it
    is null). `kept` marks one document of each component: the smallest id
    (nulls last), among equal ids the smallest text digest; rows that agree in
    both are marked alike. Extra columns are ignored; an empty table gives an
    empty table.

    Equal fingerprints are one node from the start, so copies cost nothing
    beyond their own rows; the joins back to the documents are on the
    fingerprint, whose hot values are split at run time.
    """
    rows = keep(fingerprints(docs, words), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    nodes = keep(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash")
    pairs = linked_fingerprints(nodes, max_bits)
    roots = connected_components(nodes.select(F.col("fp").alias("node")), pairs)
    placed = roots.withColumnRenamed("node", "fp").join(nodes, "fp")
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    groups = placed.select("fp", "component").join(heads, "component").select("fp", "head")
    out = rows.join(groups, "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("head.i")) & (F.col("row") == F.col("head.r"))
    return out.select("doc_id", "row", "fp", F.col("head.i").alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """`docs` with one row of each SimHash component, all columns kept.

    Rows that agree in id and text are one document: a single one stays.
    """
    groups = simhash_groups(docs, words, max_bits)
    chosen = groups.filter("kept").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    keyed = docs.withColumn("_text", digest(F.coalesce("text", F.lit(""))))
    met = keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_row")))
    return met.dropDuplicates(["doc_id", "_text"]).select(*docs.columns)
