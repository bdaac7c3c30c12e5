"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keep
from loomgraph.operators.graph import connected_components

BLOCK_DIMS = 8
GRID_DIMS = 2  # coordinates of a block that its grid uses
CHUNK = 8192  # vectors of a cell that meet in one task
TILE = 512
SLACK = 1e-9  # covers rounding in the filters; the last test is exact
CELL_ROW = "label {label}, dims int, block int, cell binary, node long, weight long, shift int, chunk int, vector array<float>"


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix: it spreads a vector's length evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_slices(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def rotated(vectors: list | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no over- or underflow in the squares
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x @ rotation(x.shape[1])


def budget(dims: int, block: slice, min_cosine: float) -> float:
    """A block's share of the squared distance of two unit vectors at that cosine."""
    return 2 * (1 - min_cosine) * (block.stop - block.start) / dims + SLACK


def usable(vector: Column, label: Column) -> Column:
    """Neither null nor empty nor zero, every component finite, label not null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def grid_rows(nodes: DataFrame, min_cosine: float) -> DataFrame:
    """Every vector in every grid cell of each block where it can meet a partner.

    Cells are twice the block's radius wide. A vector stands in its own cell
    and in those below it that it can reach (`shift` has a bit for each
    coordinate where it comes from above). Two vectors in reach of each other
    meet in the cell that has the smaller coordinate of both, and only there
    have they no shift in common: each pair is seen once per block.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                rows = b.take(pa.array(at))
                x = rotated(rows.column("vector").to_pylist())
                for k, part in enumerate(block_slices(int(d))):
                    radius = budget(int(d), part, min_cosine) ** 0.5
                    g = min(GRID_DIMS, part.stop - part.start)
                    y = x[:, part.start : part.start + g] / (2 * radius)
                    home = np.floor(y).astype(np.int32)
                    near = y - home <= 0.5 + SLACK  # in reach of the cell below
                    for shift in range(1 << g):
                        bits = np.array([shift >> i & 1 for i in range(g)], bool)
                        use = np.flatnonzero(near[:, bits].all(axis=1))
                        if not len(use):
                            continue
                        cells = np.ascontiguousarray(home[use] - bits)
                        taken = rows.take(pa.array(use))
                        n = len(use)
                        yield pa.RecordBatch.from_arrays(
                            [
                                taken.column("label"),
                                taken.column("dims"),
                                pa.array(np.full(n, k, np.int32)),
                                pa.array([c.tobytes() for c in cells], pa.binary()),
                                taken.column("node"),
                                taken.column("weight"),
                                pa.array(np.full(n, shift, np.int32)),
                                pa.array(np.zeros(n, np.int32)),
                                taken.column("vector"),
                            ],
                            ["label", "dims", "block", "cell", "node", "weight", "shift", "chunk", "vector"],
                        )

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("label", "dims", "node", "weight", "vector").mapInArrow(work, CELL_ROW.format(label=kind))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def cell_links(table: pa.Table, min_cosine: float) -> pa.Table:
    """Links inside one cell (or one pair of its chunks), as counts and connecting edges.

    Pairs within the block's budget are verified by their cosine. A link is
    counted by the first block whose budget it keeps, so the counts of all
    blocks add up without duplicates. The edges connect what is linked: a node
    gets an edge only when it learns of a smaller one, not one for each link.
    """
    k, dims = table.column("block")[0].as_py(), table.column("dims")[0].as_py()
    ci, cj = table.column("ci")[0].as_py(), table.column("cj")[0].as_py()
    node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
    shift, chunk = table.column("shift").to_numpy(), table.column("chunk").to_numpy()
    x = rotated(table.column("vector").to_pylist())
    parts = block_slices(dims)
    budgets = [budget(dims, p, min_cosine) for p in parts]
    order = np.argsort(node)
    left, right = order[chunk[order] == ci], order[chunk[order] == cj]
    count, label = np.zeros(len(node), np.int64), node.copy()
    old, new = [], []
    for a0 in range(0, len(left), TILE):
        a = left[a0 : a0 + TILE]
        for b0 in range(a0 if ci == cj else 0, len(right), TILE):
            b = right[b0 : b0 + TILE]
            near = squared(x[a][:, parts[k]], x[b][:, parts[k]]) <= budgets[k]
            near &= (shift[a][:, None] & shift[b]) == 0
            if ci == cj:
                near &= node[a][:, None] < node[b]
            r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(r):
                continue
            ra, cb = a[r], b[c]
            linked = near[np.ix_(r, c)] & (x[ra] @ x[cb].T >= min_cosine)
            if not linked.any():
                continue
            first = linked.copy()
            for e in range(k):
                first &= ~(squared(x[ra][:, parts[e]], x[cb][:, parts[e]]) <= budgets[e])
            np.add.at(count, ra, first @ weight[cb])
            np.add.at(count, cb, first.T @ weight[ra])
            top = np.iinfo(np.int64).max
            while True:  # spread the smallest label over the tile's links
                to_a = np.minimum(label[ra], np.where(linked, label[cb], top).min(1))
                to_b = np.minimum(label[cb], np.where(linked, to_a[:, None], top).min(0))
                ch_a, ch_b = to_a < label[ra], to_b < label[cb]
                if not ch_a.any() and not ch_b.any():
                    break
                for rows, to, ch in ((ra, to_a, ch_a), (cb, to_b, ch_b)):
                    old.append(label[rows[ch]])
                    new.append(to[ch])
                # a node can be on both sides of a tile: labels only ever fall
                label[ra] = np.minimum(label[ra], to_a)
                label[cb] = np.minimum(label[cb], to_b)
    edges = np.unique(np.stack([np.concatenate(old), np.concatenate(new)], 1), axis=0) if old else np.zeros((0, 2), np.int64)
    some = np.flatnonzero(count)
    n = len(edges)
    return pa.table(
        {
            "a": pa.array(np.concatenate([edges[:, 0], node[some]])),
            "b": pa.array(np.concatenate([edges[:, 1], np.zeros(len(some), np.int64)]), mask=np.arange(n + len(some)) >= n),
            "links": pa.array(np.concatenate([np.zeros(n, np.int64), count[some]])),
        }
    )


def embedding_groups(vectors: DataFrame, min_cosine: float = 0.93) -> DataFrame:
    """`(vec_id, n_links, component_id, kept)` for every row of `vectors(vec_id, embedding, label)`.

    Two vectors are linked when their labels are equal and not null, their
    lengths are equal, and their cosine in double precision is `min_cosine`
    or more. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing. `component_id` is the smallest id reachable
    over links; `kept` says whether it is the row's own. Ids are expected to be
    distinct and not null; rows that repeat an id are rows of their own with
    the same component, a null id has a null component. Extra columns are
    ignored; an empty table gives an empty table.

    Equal vectors of a label are one node with a weight. Unit vectors within
    the squared distance D of each other are within D/m in one of m equal
    blocks of a rotation of the space, so a grid join of each block under its
    share finds every link, and candidates are verified in the task that finds
    them. Cells with over `CHUNK` vectors are cut by hash into chunks, and each
    pair of chunks is a task of its own.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("vector"), "label")
    rows = rows.withColumn("ok", usable(F.col("vector"), F.col("label")))
    same = rows.filter("ok").groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))
    # the smallest id names a node; without any id a hash does, away from the ids of others
    name = F.coalesce(F.col("first").cast("long"), -1 - F.abs(F.xxhash64("label", "vector") / 2).cast("long"))
    nodes = keep(same.withColumn("dims", F.size("vector")).withColumn("node", name), "vector-nodes")
    cells = grid_rows(nodes, min_cosine)
    key = ["label", "dims", "block", "cell"]
    chunks = cells.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    placed = cells.join(chunks, key).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = placed.withColumn("other", other).withColumn("ci", F.least("chunk", "other")).withColumn("cj", F.greatest("chunk", "other"))
    found = placed.drop("chunks", "other").groupBy(*key, "ci", "cj").applyInArrow(
        lambda t: cell_links(t, min_cosine), "a long, b long, links long"
    )
    found = keep(found, "vector-links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    pairs = found.filter("b is not null").select("a", "b")
    parts = connected_components(nodes.select("node"), pairs)
    head = parts.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    summary = nodes.join(parts, "node").join(head, "component").join(counts, F.col("node") == F.col("a"), "left")
    links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    summary = summary.select("label", "vector", links.alias("n_links"), "component_id")
    known = rows.filter("ok").join(summary, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    out = known.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
