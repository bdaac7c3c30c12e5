"""Literal cases and loop equivalence of the reward operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import rewards as R
from loomgraph.operators import rollout as M
from loomgraph.operators import scoring as S


def frame(spark, groups, scores):
    rows = [(i, g, float(s), 1 + i % 5) for i, (g, s) in enumerate(zip(groups, scores))]
    return spark.createDataFrame(rows, "pos bigint, uid bigint, score double, length bigint")


def test_group_statistics_literal(spark):
    rows = R.group_stats(frame(spark, [0, 1, 0], [1, 2, 3])).orderBy("pos").collect()
    assert [r["mean"] for r in rows] == [2, 0, 2]
    assert [r["count"] for r in rows] == [2, 1, 2]
    assert rows[0]["std"] == pytest.approx(math.sqrt(2)) and rows[1]["std"] == 1


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_advantages_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    groups = [rng.randrange(6) for _ in range(40)] + list(range(6))
    scores = [rng.random() for _ in groups]
    df = frame(spark, groups, scores)
    by = {}
    for g, s in zip(groups, scores):
        by.setdefault(g, []).append(s)
    grpo = {r["pos"]: r["advantage"] for r in R.grpo(df).collect()}
    rloo = {r["pos"]: r["advantage"] for r in R.rloo(df).collect()}
    passk = {r["pos"]: r["advantage"] for r in R.passk(df.filter(F.col("uid") >= 0)).collect()} if min(map(len, by.values())) > 1 else {}
    for i, (g, s) in enumerate(zip(groups, scores)):
        v = np.array(by[g])
        n = len(v)
        mean, std = (v.mean(), v.std(ddof=1)) if n > 1 else (0.0, 1.0)
        assert grpo[i] == pytest.approx((s - mean) / (std + 1e-6), rel=1e-6)
        assert rloo[i] == pytest.approx(n / (n - 1) * (s - v.mean()) if n > 1 else s, rel=1e-6)
        if passk:
            top = sorted(v)[-2:]
            assert passk[i] == pytest.approx((top[1] - top[0]) / (std + 1e-6) if s == top[1] else 0.0)


def test_rloo_singleton_variants(spark):
    one = frame(spark, [1], [0.7])
    assert R.rloo(one).first()["advantage"] == 0.7
    assert R.rloo(one, singleton_keeps_score=False).first()["advantage"] == 0


def test_passk_rejects_singletons(spark):
    with pytest.raises(Exception, match="two responses"):
        R.passk(frame(spark, [1], [0.7])).collect()


def test_gae_ignores_masked_values(spark):
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rng = random.Random(0)
    rewards = [rng.random() for _ in mask]
    base = [rng.random() for _ in mask]
    other = [b if m else rng.random() for b, m in zip(base, mask)]
    schema = "rewards array<double>, values array<double>, mask array<double>"
    m = [float(x) for x in mask]
    out = [R.gae(spark.createDataFrame([(rewards, v, m)], schema), 0.99, 0.95).first() for v in (base, other)]
    for t, on in enumerate(mask):
        if on:
            assert out[0]["advantages"][t] == pytest.approx(out[1]["advantages"][t])
            assert out[0]["returns"][t] == pytest.approx(out[1]["returns"][t])


def test_majority_value(spark):
    rows = [("u", 0, "A", 0.9), ("u", 1, "B", 0.8), ("u", 2, "A", 0.7), ("t", 0, "A", 0.9), ("t", 1, "B", 0.8), ("t", 2, "B", 0.7), ("t", 3, "A", 0.6)]
    df = spark.createDataFrame(rows, "uid string, pos int, pred string, val double")
    got = {r["uid"]: r["value"] for r in M.majority_value(df, ["uid"], "pred", "val", "pos").collect()}
    assert got == {"u": 0.9, "t": 0.9}


def test_validation_mean(spark):
    df = spark.createDataFrame([("s1", "a", 0.8), ("s1", "a", 0.9), ("s2", "b", 0.7)], "source string, uid string, score double")
    got = {(r["source"], r["n"]): r["mean_at_n"] for r in M.validation_metrics(df).collect()}
    assert got[("s1", 2)] == pytest.approx(0.85)


def test_bootstrap_is_close_to_the_expectation(spark):
    df = spark.createDataFrame([("g", i, float(i + 1)) for i in range(5)], "g string, idx bigint, score double")
    got = {r["n"]: r for r in M.bootstrap_extremes(df, ["g"], draws=1000).collect()}
    assert sorted(got) == [2, 4, 5]
    for n, r in got.items():
        want = sum(v * ((v / 5) ** n - ((v - 1) / 5) ** n) for v in range(1, 6))
        assert r["best_mean"] == pytest.approx(want, abs=0.15)


def test_pairwise_accuracy_equals_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), float(rng.randrange(5)), rng.choice([0, 1, 1.5])) for i in range(80)] + [(90, 9, 1.0, 1.0)]
    df = spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "pos bigint, uid bigint, score double, label double")
    got = {r["uid"]: r["accuracy"] for r in R.pairwise_accuracy(df).collect()}
    for g in {r[1] for r in rows}:
        mem = [r for r in rows if r[1] == g]
        hit = tot = 0.0
        for i in range(len(mem)):
            for j in range(i + 1, len(mem)):
                d = mem[i][3] - mem[j][3]
                tot += abs(d)
                hit += abs(d) * ((mem[i][2] > mem[j][2]) == (d > 0))
        assert got[g] == pytest.approx(hit / tot if tot else 0.5)


def test_estimator_registry_refuses_a_second_function():
    R.register_estimator("grpo", R.grpo)
    with pytest.raises(ValueError):
        R.register_estimator("grpo", R.rloo)


@pytest.mark.parametrize(
    "text,truth,score",
    [
        (r"so \boxed{\frac12}", r"\frac{1}{2}", 1.0),
        (r"\boxed{0.5}", r"\frac{1}{2}", 1.0),
        (r"\boxed{x=3}", "3", 1.0),
        (r"\boxed{\sqrt3}", r"\sqrt{3}", 1.0),
        (r"\boxed{3/4}", r"\frac{3}{4}", 1.0),
        (r"\boxed{1} then \boxed{\{2\}}", r"\{2\}", 1.0),
        (r"\boxed{10\text{ cm}}", "10", 1.0),
        (r"\boxed{.5}", "0.5", 1.0),
        (r"\boxed{1", "1", 0.0),
        ("none", "1", 0.0),
    ],
)
def test_boxed_answers(spark, text, truth, score):
    df = spark.createDataFrame([(text, truth)], "t string, g string")
    assert df.select(S.boxed_score(F.col("t"), F.col("g"))).first()[0] == score


@pytest.mark.parametrize(
    "text,truth,score",
    [
        ("Answer: 1,000", "1000", 1.0),
        ("answer : 5 an hours\nAnswer: 7", "7", 1.0),
        (r"Answer: $\frac12$", r"\frac{1}{2}", 1.0),
        (r"Answer: \text{yes}", "yes", 1.0),
        ("no mark", "1", -1.0),
    ],
)
def test_final_answers(spark, text, truth, score):
    df = spark.createDataFrame([(text, truth)], "t string, g string")
    assert df.select(S.final_answer_score(F.col("t"), F.col("g"))).first()[0] == score


def test_unknown_source_is_an_error(spark):
    df = spark.createDataFrame([("nowhere", "1", "1")], "s string, t string, g string")
    with pytest.raises(Exception, match="no reward"):
        df.select(S.routed_score(F.col("s"), F.col("t"), F.col("g"))).collect()
