"""Token recurrences and weighted inversions against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import rewards as R


def plain_returns(r, m, g):
    run, back = 0.0, [0.0] * len(r)
    for t in range(len(r) - 1, -1, -1):
        back[t] = run = r[t] + g * run
        run *= m[t]
    return back


def plain_gae(r, v, m, g, lam):
    adv, nxt, last = [0.0] * len(r), 0.0, 0.0
    for t in range(len(r) - 1, -1, -1):
        if m[t]:
            last = r[t] + g * nxt - v[t] + g * lam * last
            nxt = v[t]
        adv[t] = last
    return adv


def test_recurrences(spark):
    rng = random.Random(1)
    rows = []
    for i, n in enumerate([0, 1, 2, 3, 4, 7, 8, 9, 31, 64, 256, 257, 1200]):
        rows.append((i, [rng.gauss(0, 1) for _ in range(n)], [rng.gauss(0, 1) for _ in range(n)], [float(rng.random() < 0.7) for _ in range(n)]))
    df = spark.createDataFrame(rows, "i int, r array<double>, v array<double>, m array<double>")
    out = df.select(
        "i",
        R.discounted_returns(F.col("r"), F.col("m"), 0.9).alias("back"),
        R.gae_advantages(F.col("r"), F.col("v"), F.col("m"), 0.95, 0.8).alias("adv"),
    )
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for row in out.collect():
        _, r, v, m = rows[row["i"]]
        assert row["back"] == pytest.approx(plain_returns(r, m, 0.9), abs=1e-9)
        assert row["adv"] == pytest.approx(plain_gae(r, v, m, 0.95, 0.8), abs=1e-9)


def plain_accuracy(rows):
    right = total = 0.0
    for (sa, pa, la), (sb, pb, lb) in itertools.combinations(sorted(rows), 2):
        total += abs(la - lb)
        right += lb - la if la < lb else 0.0
    return right / total if total else 0.5


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_pairwise_accuracy_of_real_labels(spark, monkeypatch, block):
    monkeypatch.setattr(R, "RANK_BLOCK", block)
    rng = random.Random(block)
    groups = {}
    for g, n in [("big", 90), ("two", 2), ("one", 1), (None, 20), ("same", 12)] + [(f"g{i}", rng.randint(1, 9)) for i in range(30)]:
        groups[g] = [(rng.randrange(8) / 2, p, 1.5 if g == "same" else rng.choice([rng.gauss(0, 1), 0.25])) for p in range(n)]
    rows = [(g, s, p, label) for g, part in groups.items() for s, p, label in part] + [("big", 1.0, 999, None), ("none", 1.0, 0, None)]
    df = spark.createDataFrame(rows, "uid string, score double, pos long, label double")
    got = {r["uid"]: r["accuracy"] for r in R.pairwise_accuracy(df).collect()}
    assert got == pytest.approx({g: plain_accuracy(part) for g, part in groups.items()} | {"none": 0.5})
