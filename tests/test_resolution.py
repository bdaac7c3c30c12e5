"""The segment index of names against the ratio of all pairs."""

import random
from difflib import SequenceMatcher

import pytest

import __spark_entry__ as entry
from loomgraph.functions.text import comparison_name
from loomgraph.operators import resolution as R


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(6)
    out = {f"Customer#{rng.randrange(300):09d}" for _ in range(60)} | {"a", "b", "ab", "ba", "abc", "", "..", "x" * 60, "x" * 57 + "y"}
    for _ in range(40):
        word = "".join(rng.choices("abcde ", k=rng.randint(1, 24)))
        out.add(word)
        for _ in range(3):
            p = rng.randrange(len(word) + 1)
            word = rng.choice([word[:p] + rng.choice("abcz") + word[p:], word[:p] + word[p + 1 :], word[:p] + "q" + word[p + 1 :]])
            out.add(word)
    df = spark.createDataFrame([(n,) for n in out] + [(None,), ("abc",)], "name string")
    norms = {r[0]: r[1] for r in df.select("name", comparison_name(df.name)).distinct().collect() if r[0] is not None and r[1]}
    return df, norms


def plain(norms, threshold, allowed):
    out = {}
    for a in norms:
        for b in norms:
            if a < b and allowed(norms[a], norms[b]):
                ratio = SequenceMatcher(None, norms[a], norms[b]).ratio()
                if ratio >= threshold:
                    out[a, b] = round(ratio, 9)
    return out


@pytest.mark.parametrize("threshold", [0.97, 0.85, 0.6])
def test_all_pairs_with_and_without_blocks(names, threshold):
    df, norms = names
    got = {(r["a"], r["b"]): round(r["ratio"], 9) for r in R.similar_in_block(df, threshold, prefix=0).collect()}
    assert got == plain(norms, threshold, lambda x, y: True)
    if threshold > 0.8:
        got = {(r["a"], r["b"]): round(r["ratio"], 9) for r in R.similar_in_block(df, threshold).collect()}
        assert got == plain(norms, threshold, lambda x, y: x[:2] == y[:2])


def test_neighbour_blocks(names):
    df, norms = names
    blocks = {b: i for i, b in enumerate(sorted({x[:2] for x in norms.values()}))}
    near = lambda x, y: abs(blocks[x[:2]] - blocks[y[:2]]) == 1
    got = {(r["a"], r["b"]): round(r["ratio"], 9) for r in R.similar_across_blocks(df, 0.6, head=None).collect()}
    assert got == plain(norms, 0.6, near)
    first = {n for b in blocks for n in sorted(n for n, x in norms.items() if x[:2] == b)[:2]}
    got = {(r["a"], r["b"]) for r in R.similar_across_blocks(df, 0.5, head=2).collect()}
    assert got == set(plain({n: x for n, x in norms.items() if n in first}, 0.5, near))


def test_names_of_one_length_and_of_the_same_side_do_not_meet(spark):
    df = spark.createDataFrame([(f"Customer#{i:09d}",) for i in range(300)] + [("CUSTOMER 000000007",), ("cvstomer#000000007",)], "name string")
    rows = R._blocked(df, 0).withColumn("side", R.F.lit(0))
    # at 0.97 and one length no character may differ, so there is nothing to index
    assert R._length_pairs(rows, 0.97, False).count() == 0
    near = R.similar_in_block(df, 0.97, prefix=0).collect()
    norms = {r[0]: r[1] for r in df.select("name", comparison_name(df.name)).collect()}
    assert {(r["a"], r["b"]): r["ratio"] for r in near} == plain(norms, 0.97, lambda x, y: True)
    # the two blocks hold names of one length, the customers among themselves are no candidates
    got = {(r["a"], r["b"]): round(r["ratio"], 9) for r in R.similar_across_blocks(df, 0.9, head=None).collect()}
    assert got == plain(norms, 0.9, lambda x, y: x[:2] != y[:2])


@pytest.mark.parametrize("name", ["j12_blocked_similarity", "j12_neighbour_blocks", "g03_resolve_words"])
def test_names_are_not_worked_out_anew_for_each_use(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "parquet" not in plan
