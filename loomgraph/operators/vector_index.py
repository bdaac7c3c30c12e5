"""Inverted vector file: k-means cells, residual codes stored by cell, multi-probe search, exact re-rank.

A vector belongs to its nearest cell and is stored there as an 8-bit code of its residual, with the length of what the
code leaves out. Distances to the coded point therefore bound the true distance from both sides, so a search by codes
loses none of the best vectors of the cells it visits; the few that remain are scored exactly. An exact search deals the
cells out in tiles of bounded size: a query meets the tile of its nearest cell, then every tile that holds a cell whose
radius leaves room for a better vector. A tile scores its vectors in place and passes on its best `k` of each query, so a
query travels once per tile, however many cells there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.runtime import scratch_path, top_k_per_group

PROBES = 16  # cells that a search visits
SAMPLE = 65_536  # vectors that the cells are fitted on
CELL_VALUES = 1 << 20  # most numbers in all centroids together: 8 MB travel with the tasks
LIST_PART, QUERY_PART = 4_096, 2_048  # sides of the largest block that a task scores
TILE, TILE_QUERIES = 32_768, 16_384  # vectors and queries that a task of an exact search holds
GLANCE = 2_048  # vectors of a tile that give a first bound for its k-th best
ROWS = 128  # queries scored at once inside a block
SLACK = 1e-6  # for rounding in bounds
MIX = np.uint64(0x9E3779B97F4A7C15)  # spreads ids over the parts of a list


@dataclass
class VectorIndex:
    """`path` holds the lists; the centroids, their radii and list sizes are bounded by `CELL_VALUES`."""

    path: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def lists(self, spark: SparkSession) -> DataFrame:
        """`(cell, part, vid, code, scale, err, unit)`."""
        return spark.read.parquet(f"{self.path}/lists")


def directed(vectors: DataFrame, key: str, dims: int | None = None) -> DataFrame:
    """`(key, unit)`: vectors scaled to length one. Those that are null, zero, of other dimension or hold null or
    non-finite numbers have no direction and are left out."""
    numbers = vectors.select(key, F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sized = numbers.withColumn("norm", F.sqrt(square))
    fine = F.col("norm").isNotNull() & ~F.isnan("norm") & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    if dims is not None:
        fine &= F.size("v") == dims
    return sized.filter(fine).select(key, F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), np.float64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def fit_cells(units: DataFrame, cells: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of a k-means over a bounded sample, drawn by a hash of the id, and the share of the sample in each cell."""
    sample = units.orderBy(F.xxhash64("vid", F.lit(seed)), "vid").limit(SAMPLE)
    data = sample.select(array_to_vector("unit").alias("features")).cache()
    try:
        model = KMeans(k=cells, seed=seed, maxIter=4, initMode="random").fit(data)
        sizes = np.array(model.summary.clusterSizes, float)
        return np.array(model.clusterCenters()).reshape(-1, dims), sizes / sizes.sum()
    finally:
        data.unpersist()


def build_index(vectors: DataFrame, cells: int | None = None, path: str | None = None, seed: int = 42) -> VectorIndex:
    """Index all of `vectors(vid, embedding)`; bigint ids. About the square root of their number of cells by default.

    The lists are written by cell below `path`, a new folder of the shared one by default; a cell with many vectors has
    several parts, so that no task holds a whole one. Repeated ids are indexed as often as they occur.
    """
    spark = vectors.sparkSession
    path = path or scratch_path(spark, "vector-index")
    first = directed(vectors, "vid").select(F.size("unit").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if first is None:
        return VectorIndex(path, np.empty((0, 0)), np.empty(0), np.empty(0, np.int64))
    dims, n = first["n"], first["count"]
    units = directed(vectors, "vid", dims)
    cells = max(1, min(cells or round(math.sqrt(n)), CELL_VALUES // dims, n))
    centroids, shares = fit_cells(units, cells, dims, seed)
    # the parts of a list only bound the work of a task, so the sample's estimate of its length will do
    parts = np.maximum(1, np.ceil(shares * n / LIST_PART)).astype(np.uint64)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            u = _matrix(pdf["unit"])
            cell = _squared(u, centroids).argmin(1)
            residual = u - centroids[cell]
            scale = np.abs(residual).max(1) / 127
            codes = np.rint(residual / np.where(scale == 0, 1, scale)[:, None]).astype(np.int8)
            err = np.linalg.norm(residual - codes * scale[:, None], axis=1)
            yield pd.DataFrame(
                {
                    "cell": cell.astype(np.int32),
                    "part": ((pdf["vid"].to_numpy().astype(np.uint64) * MIX >> np.uint64(33)) % parts[cell]).astype(np.int32),
                    "vid": pdf["vid"],
                    "code": [c.tobytes() for c in codes],
                    "scale": scale,
                    "err": err,
                    "away": np.linalg.norm(residual, axis=1),
                    "unit": pdf["unit"],
                }
            )

    coded = units.mapInPandas(code, "cell int, part int, vid bigint, code binary, scale double, err double, away double, unit array<double>")
    coded.repartition("cell", "part").sortWithinPartitions("cell", "part", "vid").write.parquet(f"{path}/lists")
    told = spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
    radii, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for row in told.collect():  # one row a cell
        radii[row["cell"]], sizes[row["cell"]] = row["radius"], row["n"]
    spark.createDataFrame(
        pd.DataFrame({"cell": range(len(centroids)), "centroid": centroids.tolist(), "radius": radii, "n": sizes})
    ).coalesce(1).write.parquet(f"{path}/cells")
    return VectorIndex(path, centroids, radii, sizes)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index written by `build_index` at `path`."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").toPandas()  # bounded by CELL_VALUES
    return VectorIndex(path, _matrix(rows["centroid"]), rows["radius"].to_numpy(), rows["n"].to_numpy())


def _visits(index: VectorIndex, asked: DataFrame, choose) -> DataFrame:
    """`(qid, unit, bound, cell)`: the cells that `choose(distances, bounds)` marks for each query."""
    full = index.sizes > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), ROWS):
                part = pdf.iloc[start : start + ROWS]
                away = np.sqrt(_squared(_matrix(part["unit"]), index.centroids))
                row, cell = np.nonzero(choose(away, part["bound"].to_numpy(float)) & full[None, :])
                yield part.iloc[row].assign(cell=cell.astype(np.int32))

    return asked.mapInPandas(run, "qid bigint, unit array<double>, bound double, cell int")


def _scan(index: VectorIndex, visits: DataFrame, k: int, drop_self: bool) -> DataFrame:
    """Candidates `(qid, vid, unit, vec)` of the visited cells: all that the bounds of their codes leave among a list's best.

    Queries of a cell and vectors of a cell meet in blocks of bounded size on both sides.
    """
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_PART).cast("int").alias("chunks"))
    spark = visits.sparkSession
    listed = index.lists(spark).select("cell", "part").distinct()
    v = visits.join(asked, "cell").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
    v = v.join(listed, "cell").select("cell", "part", "chunk", "qid", "unit", "bound")
    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    codes = index.lists(spark).join(asked, "cell").select("cell", "part", chunk, "vid", "code", "scale", "err")
    # names of its own, since the visits carry columns of the same lists
    codes = codes.withColumnsRenamed({"cell": "in_cell", "part": "in_part", "chunk": "for_chunk"})
    centroids = index.centroids

    def block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"qid": [], "vid": [], "cell": [], "part": []}
        if len(left) and len(right):
            code = np.frombuffer(b"".join(right["code"]), np.int8).reshape(len(right), -1)
            points = centroids[key[0]] + code * right["scale"].to_numpy()[:, None]
            err, vids = right["err"].to_numpy() + SLACK, right["vid"].to_numpy()
            for start in range(0, len(left), ROWS):
                part = left.iloc[start : start + ROWS]
                qids = part["qid"].to_numpy()
                away = np.sqrt(_squared(_matrix(part["unit"]), points))
                far = away + err
                if drop_self:
                    far[qids[:, None] == vids[None, :]] = np.inf
                kth = np.partition(far, k - 1, axis=1)[:, k - 1] if len(vids) > k else np.full(len(qids), np.inf)
                near = away - err <= np.minimum(kth, part["bound"].to_numpy(float))[:, None]
                row, col = np.nonzero(near & np.isfinite(far))
                found["qid"].append(qids[row])
                found["vid"].append(vids[col])
        if not found["qid"]:
            return pd.DataFrame({"qid": [], "vid": [], "cell": [], "part": []})
        qid, vid = np.concatenate(found["qid"]), np.concatenate(found["vid"])
        return pd.DataFrame({"qid": qid, "vid": vid, "cell": np.full(len(qid), key[0]), "part": np.full(len(qid), key[1])})

    lists = codes.groupBy("in_cell", "in_part", "for_chunk")
    return v.groupBy("cell", "part", "chunk").cogroup(lists).applyInPandas(block, "qid bigint, vid bigint, cell int, part int")


def _scored(index: VectorIndex, candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Exact cosine of candidates; distinct, since a repeated id is found once per copy."""
    vec = index.lists(candidates.sparkSession).select("cell", "part", "vid", F.col("unit").alias("vec")).dropDuplicates(["cell", "part", "vid", "vec"])
    both = candidates.distinct().join(vec, ["cell", "part", "vid"]).join(asked.select("qid", "unit"), "qid")
    dot = F.aggregate(F.zip_with("unit", "vec", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("qid", "vid", dot.alias("score"))


def _tiles(index: VectorIndex) -> tuple[np.ndarray, np.ndarray]:
    """First tile of each cell and the number of its tiles. Cells that lie side by side share tiles of about `TILE`
    vectors; a larger cell has tiles of its own, over which its parts are dealt."""
    centred = index.centroids - index.centroids.mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    first, count = np.zeros(index.cells, np.int32), np.ones(index.cells, np.int32)
    tile, held = 0, 0
    for cell in np.argsort(along, kind="stable"):
        n = int(index.sizes[cell])
        if held and held + n > TILE:
            tile, held = tile + 1, 0
        first[cell], count[cell] = tile, max(1, -(-n // TILE))
        held += n
        if count[cell] > 1:
            tile, held = tile + int(count[cell]), 0
    return first, count


def _uncopied(units: np.ndarray, vids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` smallest ids of each distinct vector; no other copy can be among a query's best."""
    rows = np.ascontiguousarray(units).view(np.dtype((np.void, units.shape[1] * 8))).ravel()
    kind = np.unique(rows, return_inverse=True)[1].ravel()
    order = np.lexsort((vids, kind))
    kind, vids = kind[order], vids[order]
    again = np.zeros(len(order), bool)
    again[1:] = (kind[1:] == kind[:-1]) & (vids[1:] == vids[:-1])
    order, kind = order[~again], kind[~again]
    return order[np.arange(len(order)) - np.searchsorted(kind, kind) < most]


def _with_home(index: VectorIndex, asked: DataFrame) -> DataFrame:
    """`(qid, unit, home)`: the nearest cell that is not empty."""
    full, centroids = index.sizes > 0, index.centroids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                away = np.where(full[None, :], _squared(_matrix(pdf["unit"]), centroids), np.inf)
                yield pdf.assign(home=away.argmin(1).astype(np.int32))

    return asked.mapInPandas(run, "qid bigint, unit array<double>, home int")


def _tile_scan(index: VectorIndex, asked: DataFrame, at_home: bool, k: int, drop_self: bool, least: float) -> DataFrame:
    """`(qid, vid, score)`: the best `k` of each query of `asked(qid, unit, bound, home)` in each tile of its home cell,
    or in each other tile that holds a cell within its bound."""
    spark = asked.sparkSession
    first, count = _tiles(index)
    full, radii, centroids = index.sizes > 0, index.radii, index.centroids
    holds = np.zeros((index.cells, int((first + count).max())), np.float32)
    for cell in range(index.cells):
        holds[cell, first[cell] : first[cell] + count[cell]] = full[cell]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), ROWS):
                part = pdf.iloc[start : start + ROWS]
                tiles = holds[part["home"].to_numpy()] > 0
                if not at_home:
                    away = np.sqrt(_squared(_matrix(part["unit"]), centroids))
                    room = away - radii[None, :] - SLACK <= part["bound"].to_numpy(float)[:, None]
                    tiles = ~tiles & (room.astype(np.float32) @ holds > 0)
                row, tile = np.nonzero(tiles)
                yield part.iloc[row].assign(tile=tile.astype(np.int32))

    visits = asked.mapInPandas(visit, "qid bigint, unit array<double>, bound double, home int, tile int")
    chunks = visits.groupBy("tile").agg(F.ceil(F.count("*") / TILE_QUERIES).cast("int").alias("chunks"))
    left = visits.join(chunks, "tile").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
    placed = spark.createDataFrame(pd.DataFrame({"cell": range(index.cells), "first": first, "count": count}))
    tile = (F.col("first") + F.col("part") % F.col("count")).cast("int").alias("tile")
    listed = index.lists(spark).join(placed, "cell").select(tile, "cell", "vid", "unit").join(chunks, "tile")
    listed = listed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # names of its own, since both sides carry columns of the same counts
    right = listed.select(F.col("tile").alias("in_tile"), F.col("chunk").alias("for_chunk"), "cell", "vid", "unit")

    def block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            units, vids = _matrix(right["unit"]), right["vid"].to_numpy()
            mine = _uncopied(units, vids, k + 1)
            cells = right["cell"].to_numpy()[mine]
            order = np.argsort(cells, kind="stable")
            units, vids, cells = units[mine[order]], vids[mine[order]], cells[order]
            here, of = np.unique(cells, return_inverse=True)
            left = left.sort_values("home", kind="stable")  # neighbours want the same cells
            asked_units, qids, bounds = _matrix(left["unit"]), left["qid"].to_numpy(), left["bound"].to_numpy(float)
            for start in range(0, len(left), ROWS):
                rows = slice(start, start + ROWS)
                part, asks, bound = asked_units[rows], qids[rows], bounds[rows]
                away = np.sqrt(_squared(part, centroids[here]))
                near = (away - radii[here][None, :] - SLACK <= bound[:, None]).any(0)[of]
                points, ids = (units, vids) if near.all() else (units[near], vids[near])
                if not len(ids):
                    continue
                scores = part @ points.T
                if drop_self:
                    scores[asks[:, None] == ids[None, :]] = -np.inf
                lowest = np.maximum(least, 1 - bound * bound / 2) - SLACK
                glance = scores[:, :: max(1, len(ids) // GLANCE)]
                if glance.shape[1] > k:
                    lowest = np.maximum(lowest, np.partition(glance, -k, axis=1)[:, -k] - SLACK)
                row, col = np.nonzero((scores >= lowest[:, None]) & np.isfinite(scores))
                # summed in order, so that equal vectors have equal scores wherever they lie
                exact = np.zeros(len(row))
                for d in range(part.shape[1]):
                    exact += part[row, d] * points[col, d]
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                found.append(pd.DataFrame({"qid": asks[row[best]], "vid": ids[col[best]], "score": exact[best]}))
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "vid": [], "score": []})

    lists = right.groupBy("in_tile", "for_chunk")
    return left.select("qid", "unit", "bound", "home", "tile", "chunk").groupBy("tile", "chunk").cogroup(lists).applyInPandas(block, "qid bigint, vid bigint, score double")


def _exact(index: VectorIndex, asked: DataFrame, k: int, drop_self: bool, least: float) -> DataFrame:
    """Top k over all cells: the tiles of a query's home first, then those within the distance of its k-th best there."""
    spark = asked.sparkSession
    placed = scratch_path(spark, "vector-asked")
    _with_home(index, asked.select("qid", "unit")).withColumn("bound", F.lit(_widest(least))).write.parquet(placed)
    asked = spark.read.parquet(placed)
    wanted = F.col("score") >= least
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.filter(wanted).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    near = _tile_scan(index, asked, True, k, drop_self, least)
    first, count = _tiles(index)
    tiles = int((first + count).max())
    if tiles == 1:
        return ranked(near)
    path = scratch_path(spark, "vector-hits")
    ranked(near).drop("rank").write.parquet(path)
    near = spark.read.parquet(path)
    # the distance that a vector must not exceed: that of the k-th best so far, if there are so many
    kth = near.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("lowest"))
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("lowest"))) + SLACK
    bound = F.when(F.col("n") >= k, F.least(far, F.col("bound"))).otherwise(F.col("bound")).alias("bound")
    bounded = asked.join(kth, "qid", "left").select("qid", "unit", bound, "home")
    return ranked(near.unionByName(_tile_scan(index, bounded, False, k, drop_self, least)))


def _widest(least: float) -> float:
    """Greatest distance of a wanted vector; 2 is the greatest of all."""
    return math.sqrt(max(0.0, 2 - 2 * max(least, -1.0))) + SLACK


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False, drop_self: bool = False, least: float = -1.0) -> DataFrame:
    """`(qid, vid, score, rank)`: the `k` vectors of greatest cosine of every row of `queries(qid, embedding)`.

    The `probes` nearest cells are searched, which loses neighbours in other cells; `exact=True` visits every cell that
    can hold one of the best `k`, whatever `probes` is. Equal scores go by id. Queries without a direction find nothing;
    an id asked twice should ask with one vector. `drop_self` leaves out the vector with the query's own id, `least` is
    the smallest score wanted.
    """
    spark = queries.sparkSession
    if not index.cells:
        return spark.createDataFrame([], "qid bigint, vid bigint, score double, rank int")
    dims = index.centroids.shape[1]
    asked = directed(queries, "qid", dims).dropDuplicates(["qid"])
    if exact:
        return _exact(index, asked, k, drop_self, least)
    asked = asked.withColumn("bound", F.lit(_widest(least) if least > -1 else float("inf")))

    def nearest(away: np.ndarray, bound: np.ndarray) -> np.ndarray:
        away = np.where(index.sizes > 0, away, np.inf)
        kth = np.partition(away, probes - 1, axis=1)[:, probes - 1] if away.shape[1] > probes else np.full(len(away), np.inf)
        return away <= kth[:, None]

    near = _scored(index, _scan(index, _visits(index, asked, nearest), k, drop_self), asked)
    return top_k_per_group(near.filter(F.col("score") >= least), ["qid"], [F.desc("score"), F.col("vid")], k)
