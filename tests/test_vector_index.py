"""The inverted vector file against all pairs, and its recall without the exact second pass."""

import numpy as np
import pytest

from loomgraph.operators import vector_index as I
from loomgraph.operators import vectors as V
from pyspark.sql import functions as F


def frame(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(data)], "vid bigint, embedding array<double>")


def brute(data, asked, k, drop_self=False, least=-2.0):
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = unit @ unit.T
    out = {}
    for q in asked:
        order = sorted((j for j in range(len(data)) if not (drop_self and j == q)), key=lambda j: (-round(scores[q, j], 9), j))
        out[q] = [(j, round(scores[q, j], 6)) for j in order[:k] if scores[q, j] >= least]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["vid"], round(r["score"], 6)))
    return out


def scores_of(hits):
    return {q: [s for _, s in h] for q, h in hits.items() if h}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 12))
    data = np.concatenate([centres[rng.integers(9)] + rng.normal(size=12) * 0.4 for _ in range(500)]).reshape(500, 12)
    data[100:260] = data[100]  # a group of copies with a third of all rows
    return data


@pytest.mark.parametrize("part", [I.LIST_PART, 20])
def test_exact_search_equals_all_pairs(spark, monkeypatch, clustered, part):
    monkeypatch.setattr(I, "LIST_PART", part)
    monkeypatch.setattr(I, "QUERY_PART", part)
    vec = frame(spark, clustered)
    asked = vec.select(F.col("vid").alias("qid"), "embedding")
    index = I.build_index(vec, cells=25)
    got = by_query(I.search(index, asked, 4, probes=2, exact=True, drop_self=True).collect())
    assert scores_of(got) == scores_of(brute(clustered, range(500), 4, True))
    got = by_query(I.search(index, asked, 5, probes=1, exact=True, least=0.97).collect())
    assert scores_of(got) == scores_of(brute(clustered, range(500), 5, least=0.97))
    again = I.load_index(spark, index.path)
    assert np.allclose(again.centroids, index.centroids) and list(again.sizes) == list(index.sizes)


def test_vectors_without_direction_and_other_dimensions(spark):
    data = [[1, 0], [0, 0], None, [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 0, 0], [0.9, 0.1], [], [-1, 0]]
    vec = frame(spark, data)
    hits = by_query(V.top_k_cosine(vec.select(F.col("vid").alias("qid"), "embedding"), vec, 2).collect())
    assert {q: [v for v, _ in h] for q, h in hits.items()} == {0: [0, 7], 7: [7, 0], 9: [9, 7]}
    none = frame(spark, [[0, 0]])
    assert V.top_k_cosine(none.select(F.col("vid").alias("qid"), "embedding"), none, 2).count() == 0


def test_recall_of_the_default_probes(spark):
    vec = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("vid"), "embedding")
    rows = vec.toPandas()
    data = np.array(rows["embedding"].tolist(), float)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    index = I.build_index(vec)
    asked = vec.filter("vid % 100 = 0").select(F.col("vid").alias("qid"), "embedding")
    got = by_query(I.search(index, asked, 10).collect())
    at = {v: i for i, v in enumerate(rows["vid"])}
    found = []
    for q, hits in got.items():
        scores = unit @ unit[at[q]]
        tenth = np.sort(scores)[-10]
        found.append(np.mean([s >= tenth - 1e-6 for _, s in hits]))
    assert index.cells > I.PROBES * 2
    assert len(found) == asked.count() and np.mean(found) >= 0.9


def test_post_filter_after_the_search(spark, clustered):
    vec = frame(spark, clustered).withColumn("label", F.col("vid") % 3)
    asked = vec.filter("vid < 5").select(F.col("vid").alias("qid"), "embedding")
    rows = V.index_search(I.build_index(vec), vec, asked, 3, {"label": [1], "other": 2}, exact=True).collect()
    wide = brute(clustered, range(5), 6)
    for q in range(5):
        mine = [r["vid"] for r in rows if r["qid"] == q]
        assert len(mine) == min(3, sum(j % 3 == 1 for j, _ in wide[q])) and all(v % 3 == 1 for v in mine)


@pytest.mark.parametrize("tile, queries", [(60, 40), (1 << 15, 1 << 14)])
def test_exact_search_passes_on_the_best_of_a_tile_only(spark, monkeypatch, clustered, tile, queries):
    monkeypatch.setattr(I, "TILE", tile)
    monkeypatch.setattr(I, "TILE_QUERIES", queries)
    monkeypatch.setattr(I, "GLANCE", 8)
    vec = frame(spark, clustered)
    asked = vec.select(F.col("vid").alias("qid"), "embedding")
    index = I.build_index(vec, cells=25)
    got = by_query(I.search(index, asked, 4, exact=True, drop_self=True).collect())
    want = brute(clustered, range(500), 4, True)
    assert scores_of(got) == scores_of(want)
    assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in range(100, 260))  # copies go by id
    # a query and a tile leave k rows, not one for each near vector or cell
    first, count = I._tiles(index)
    home = I._with_home(index, I.directed(asked, "qid")).withColumn("bound", F.lit(3.0))
    rows = I._tile_scan(index, home, False, 4, True, -1.0).groupBy("qid").count().agg(F.max("count")).first()
    assert rows[0] is None or rows[0] <= 4 * int((first + count).max())
