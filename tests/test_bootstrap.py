"""Bootstraps: groups of any size give the same draws, and no table is sent to all tasks."""

import pytest
from loomgraph.operators import rollout as M


@pytest.mark.parametrize("run", ["bootstrap_extremes", "bootstrap_majority"])
def test_rows_travel_with_their_draws_or_by_a_shuffle(spark, monkeypatch, run):
    rows = [(g, i, float((7 * i + g) % 11), i % 3) for g, n in ((1, 9), (2, 5), (3, 2), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, idx long, score double, pred int")
    got = {}
    for limit in (4096, 5, 1):
        monkeypatch.setattr(M, "GROUP_ARRAY", limit, raising=False)
        out = getattr(M, run)(df, ["g"], draws=60)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        got[limit] = sorted((r["g"], r["n"], *[round(x, 9) for x in r[2:]]) for r in out.collect())
    assert got[4096] == got[5] == got[1] and {r[0] for r in got[1]} == {1, 2, 3}
