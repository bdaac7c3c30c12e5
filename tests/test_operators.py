"""Operators against brute force on small fixtures, with blocks and salts small enough to matter."""

import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import runtime as U
from loomgraph.operators import datasets as D
from loomgraph.operators import graph as G
from loomgraph.operators import ranking as W
from loomgraph.operators import resolution as X
from loomgraph.operators import resultsets as E
from loomgraph.operators import vectors as V


def skewed(spark, n=900, seed=0):
    """A third of the rows share one key."""
    rng = random.Random(seed)
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(1, 12), rng.randrange(50), float(rng.random())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, k bigint, v bigint, x double")


def test_global_and_group_index(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["idx"] for r in U.with_global_index(df, [F.desc("v"), F.col("id")], partitions=5).collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [got[r[0]] for r in want] == list(range(len(rows)))
    pos = {r["id"]: r["pos"] for r in U.with_group_index(df, ["k"], [F.col("v"), F.col("id")]).collect()}
    for k, grp in itertools.groupby(sorted(rows, key=lambda r: (r[1], r[2], r[0])), key=lambda r: r[1]):
        assert [pos[r[0]] for r in grp] == list(range(len([r for r in rows if r[1] == k])))


def test_running_sum_and_hash_rank(spark):
    rows, df = skewed(spark)
    run = {r["id"]: r["run"] for r in U.with_group_running_sum(df, ["k"], [F.col("id")], F.col("v"), "run", 7).collect()}
    sums = {}
    for i, k, v, _ in rows:
        assert run[i] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    ranked = U.with_hash_rank(df, ["k"], U.seeded_digest(1, "id"), [F.col("id")]).collect()
    for k in {r[1] for r in rows}:
        mine = [r for r in ranked if r["k"] == k]
        assert sorted(r["rank"] for r in mine) == list(range(1, len(mine) + 1))
        assert {r["group_size"] for r in mine} == {len(mine)}


def test_top_k_and_keep_first(spark):
    rows, df = skewed(spark)
    top = U.top_k_per_group(df, ["k"], [F.desc("x")], 3, salts=4).collect()
    for k in {r[1] for r in rows}:
        want = sorted((r[3] for r in rows if r[1] == k), reverse=True)[:3]
        assert sorted((r["x"] for r in top if r["k"] == k), reverse=True) == want
    first = {r["k"]: r["id"] for r in U.keep_first(df, ["k"], [F.col("v"), F.col("id")]).collect()}
    assert first == {k: min((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))[0] for k in first}


def test_trailing_mean_over_block_borders(spark):
    rows, df = skewed(spark, 200)
    out = {r["id"]: r["moving_avg"] for r in W.trailing_mean(df, ["k"], "id", "x", width=4, block=7).collect()}
    want = {}
    for k in {r[1] for r in rows}:
        xs = [r for r in rows if r[1] == k]
        for j in range(3, len(xs)):
            want[xs[j][0]] = sum(r[3] for r in xs[j - 3 : j + 1]) / 4
    assert out.keys() == want.keys()
    assert all(out[i] == pytest.approx(want[i]) for i in want)


NAMES = ["Acme Steel", "Acme Steels", "Acme Stele Co., Ltd.", "Acne Steel", "Beta Gas", "Beta Gases GmbH", "Bela Gas", "acme steel", "Ac", "Zeta", "Zetta", "Zebra"]


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.95])
def test_blocked_similarity_equals_all_pairs(spark, threshold):
    rng = random.Random(1)
    more = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    names = sorted(set(NAMES + more))
    df = spark.createDataFrame([(n,) for n in names], "name string")
    norm = {r["name"]: r["norm"] for r in X._blocked(df).collect()}
    want = set()
    for a, b in itertools.combinations(names, 2):
        if norm[a][:2] == norm[b][:2] and SequenceMatcher(None, norm[a], norm[b]).ratio() >= threshold:
            want.add((a, b))
    assert {(r["a"], r["b"]) for r in X.similar_in_block(df, threshold).collect()} == want


def test_similarity_across_blocks(spark):
    names = ["abcdef", "acbdef", "acbdeg", "bxcdef", "bxcdeg"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["a"], r["b"]) for r in X.similar_across_blocks(df, 0.8).collect()}
    blocks = {}
    for n in sorted(names):
        blocks.setdefault(n[:2], []).append(n)
    keys = sorted(blocks)
    want = {
        (a, b)
        for i in range(len(keys) - 1)
        for a in blocks[keys[i]][:10]
        for b in blocks[keys[i + 1]][:10]
        if SequenceMatcher(None, a, b).ratio() >= 0.8
    }
    assert got == want and want


@pytest.mark.parametrize("seed", [0, 1])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    n = 120
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)] + [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(90, 110)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.range(n).select(F.col("id").alias("node"))
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in G.connected_components(nodes, edges).collect()}
    assert got == {i: find(i) for i in range(n)}


def results(spark, gold, pred):
    rows = []
    for side, table in (("gold", gold), ("pred", pred)):
        for qid, rs in table.items():
            rows += [(qid, side, i, [str(v) for v in r]) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "qid string, side string, row_no int, values array<string>")


def test_execution_accuracy(spark):
    gold = {
        "same": [(1, 2), (3, 4)],
        "swap": [(1, "a"), (2, "b")],
        "bag": [(1,), (1,), (2,)],
        "mixed": [(1, 2), (2, 1)],
        "order": [(1,), (2,)],
        "short": [(1,)],
        "width": [(1, 2)],
        "cross": [(1, 1), (2, 2)],
        "text": [(1,)],
        "failed": [(1,)],
    }
    pred = {
        "same": [(3, 4), (1, 2)],
        "swap": [("b", 2), ("a", 1)],
        "bag": [(1,), (2,), (2,)],
        "mixed": [(2, 1), (1, 2)],
        "order": [(2,), (1,)],
        "width": [(1,)],
        "cross": [(1, 2), (2, 1)],
        "text": [(9,)],
        "failed": [(1,)],
    }
    want = {"same": 1, "swap": 1, "bag": 0, "mixed": 1, "order": 0, "short": 0, "width": 0, "cross": 0, "text": 1, "failed": 0, "empty": 1}
    q = [(k, f"g {k}" + (" ORDER BY x" if k == "order" else ""), "g text" if k == "text" else "p", True, k != "failed") for k in want]
    queries = spark.createDataFrame(q, "qid string, gold_text string, pred_text string, gold_ok boolean, pred_ok boolean")
    got = {r["qid"]: r["ex"] for r in E.execution_accuracy(queries, results(spark, gold, pred)).collect()}
    assert got == want


def test_lenient_match_equals_greedy(spark):
    rng = random.Random(5)
    gold, pred, want = {}, {}, {}
    for q in range(40):
        g = [(rng.randrange(3), rng.randrange(3)) for _ in range(rng.randrange(1, 5))]
        p = [(*r, rng.randrange(3)) for r in g] if q % 2 else [tuple(rng.randrange(3) for _ in range(3)) for _ in g]
        rng.shuffle(p)
        gold[str(q)], pred[str(q)] = g, p
        free, ok = [set(map(str, r)) for r in p], 1
        for r in g:
            hit = next((i for i, t in enumerate(free) if set(map(str, r)) <= t), None)
            if hit is None:
                ok = 0
                break
            free.pop(hit)
        want[str(q)] = ok
    got = {r["qid"]: r["match"] for r in E.lenient_match(results(spark, gold, pred)).collect()}
    assert got == want and len(set(want.values())) == 2


def test_semantic_match_edges(spark):
    res = results(spark, {"a": [(1, 2)], "b": [(1,)]}, {"a": [(2, 1, 5)], "c": [(1,)]})
    qs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "qid string")
    got = {r["qid"]: (r["recall"], r["precision"], r["semantic_match"]) for r in E.semantic_match(res, qs).collect()}
    assert got == {"a": (1.0, 1.0, 1), "b": (0.0, 0.0, 0), "c": (1.0, 0.0, 1), "d": (1.0, 1.0, 1)}


def test_repeat_and_padding(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("abc")], "i int, c string")
    order = lambda d: "".join(r["c"] for r in d.orderBy("position").collect())
    assert order(D.repeat_rows(df, "i", 2)) == "aabbcc"
    assert order(D.repeat_rows(df, "i", 2, False)) == "abcabc"
    padded = D.pad_rows(df, "i", 8)
    assert padded.count() == 8 and D.unpad_rows(padded).count() == 3
    assert sorted(r["c"] for r in padded.collect()) == sorted("abcabcab")


def test_chunking_refuses_a_remainder(spark):
    df = spark.range(7).withColumnRenamed("id", "i")
    with pytest.raises(Exception, match="equal chunks"):
        D.chunk_rows(df, "i", 2).collect()


def test_micro_batches_restore_the_rows(spark):
    df = spark.createDataFrame([(i, 100) for i in range(20)], "i int, n int")
    out = D.micro_batches(df, "i", "n", 300).orderBy("original_idx").collect()
    assert [r["i"] for r in out] == list(range(20))
    sizes = {}
    for r in out:
        sizes[r["micro_batch"]] = sizes.get(r["micro_batch"], 0) + r["n"]
    assert len(sizes) == 7 and sorted(sizes) == list(range(7)) and max(sizes.values()) <= 300


def test_differencing_in_blocks(spark):
    """Blocks of three parts and tasks of six rows: no two parts of a block differ by more than its heaviest row."""
    rng = random.Random(3)
    rows = [(i, int(rng.paretovariate(1.2) * 10)) for i in range(400)] + [(400 + i, 7) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, n long")
    got = D.differenced(df, F.col("n"), "id", 8, parts=3, rows=6).collect()
    assert sorted((r["id"], r["n"]) for r in got) == rows
    for block in range(3):
        sums = {p: 0 for p in range(8) if p // 3 == block}
        heaviest = 0
        for r in got:
            if r["part"] in sums:
                sums[r["part"]] += r["n"]
                heaviest = max(heaviest, r["n"])
        assert max(sums.values()) - min(sums.values()) <= heaviest
    empty = D.differenced(df.limit(0), F.col("n"), "id", 4)
    assert empty.count() == 0 and "part" in empty.columns


def test_micro_batches_fit_their_budget(spark):
    rows = [(i, 60 if i % 3 else 35) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, n long")
    got = D.micro_batches(df, "id", "n", 100, divisor=2, difference=True, fit=True)
    report = D.micro_batch_report(got, "n", 100).collect()
    assert all(r["fits"] for r in report) and sum(r["rows"] for r in report) == 100
    assert [r["id"] for r in got.orderBy("original_idx").collect()] == list(range(100))


def test_differencing_is_balanced():
    weights = [8, 7, 6, 5, 4]
    parts = D.differencing(weights, 2, False)
    sums = [sum(w for w, p in zip(weights, parts) if p == j) for j in range(2)]
    assert sum(sums) == 30 and abs(sums[0] - sums[1]) <= 2
    even = D.differencing([5, 5, 1, 1, 9, 9], 3, True)
    assert sorted(even.count(j) for j in range(3)) == [2, 2, 2]
    assert D.greedy_parts([3, 3, 2], 2, False) == [0, 1, 0]


def test_split_sizes_per_stratum(spark):
    rows, df = skewed(spark)
    out = D.split(df, "id", 0.8, "k").groupBy("k", "split").count().collect()
    got = {(r["k"], r["split"]): r["count"] for r in out}
    for k in {r[1] for r in rows}:
        n = sum(r[1] == k for r in rows)
        assert got[(k, "train")] == int(n * 0.8)


@pytest.mark.parametrize("method", ["pow", "max_min", "max_random"])
def test_resampling_follows_the_weights(spark, method):
    scores = [0.0, 1.0, 2.0, 4.0]
    df = spark.createDataFrame([(i, scores[i % 4]) for i in range(4000)], "i bigint, s double")
    out = D.resample_by_score(df, "s", "i", method)
    got = {r["s"]: r["count"] for r in out.groupBy("s").count().collect()}
    w = {"pow": [0, 1, 4, 16], "max_min": [1, 0, 0, 1], "max_random": [0.1, 0.1, 0.1, 0.4]}[method]
    assert sum(got.values()) == 4000
    for s, x in zip(scores, w):
        assert got.get(s, 0) / 4000 == pytest.approx(x / sum(w), abs=0.04)


def test_frequency_sampling_prefers_the_frequent(spark):
    rows = [(f"n{i}",) for i in range(60) for _ in range(200 if i < 5 else 6)]
    out = D.sample_by_frequency(spark.createDataFrame(rows, "name string"), "name", 30, 5)
    names = {r["name"] for r in out.collect()}
    assert {f"n{i}" for i in range(5)} <= names and len(names) <= 30


def test_template_ranges_are_ordered(spark):
    p = "pattern_id string, template string, context string, params array<struct<name:string,type:string>>"
    pat = spark.createDataFrame([("r", "d >= $year_start AND d <= $year_end", "{year_start}-{year_end}", [("year_start", "y"), ("year_end", "y")])], p)
    vals = spark.createDataFrame([("y", str(x)) for x in range(2000, 2020)], "type string, value string")
    for r in D.instantiate(pat, vals, 30).collect():
        a, b = r["context"].split("-")
        assert a <= b and r["text"] == f"d >= '{a}' AND d <= '{b}'"


def test_quotas():
    assert D.quotas(10, {"a": 0.25, "b": 0.55}) == {"a": 2, "b": 8}


def test_large_pages_equal_small_ones(spark, monkeypatch):
    rows, df = skewed(spark)
    order = lambda: [F.desc("v"), F.col("id")]
    small = [r["id"] for r in U.first_rows(df, order(), 50, 30).collect()]
    monkeypatch.setattr(U, "SORTED_LIMIT", 10)
    assert {r["id"] for r in U.first_rows(df, order(), 50, 30).collect()} == set(small)


def test_percentiles_equal_numpy(spark):
    rows, df = skewed(spark)
    got = {r["k"]: (r["a"], r["b"]) for r in W.exact_percentiles(df, ["k"], "x", {"a": 0.5, "b": 0.99}).collect()}
    for k in {r[1] for r in rows}:
        xs = [r[3] for r in rows if r[1] == k]
        assert got[k] == pytest.approx(tuple(np.percentile(xs, [50, 99])))
