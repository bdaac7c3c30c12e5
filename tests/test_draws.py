"""Seeded draws are those of the digests, whatever the length of their texts, and empty scores count as in SQL."""

import hashlib

import duckdb
import pytest
from oracle import compare

import __spark_entry__ as entry


@pytest.mark.parametrize("prefix", ["", "42:view:1", "é中" * 3, "4" * 31, "4" * 44, "4" * 47, "é中:" * 30])
def test_draws_against_digests(monkeypatch, prefix):
    from loomgraph.functions import draws as D

    monkeypatch.setattr(D, "CHUNK", 300)
    for ns, draws, total in (([2, 4, 8, 13], 101, 13), ([2, 300], 12, 301), ([2], 1000, 2)):
        got = {(n, first + d + 1, i + 1): int(x) for n, first, idx in D.seeded_draws(prefix, ns, draws, total) for (i, d), x in _cells(idx)}
        want = {(n, d, i): int(hashlib.md5(f"{prefix}:{n}:{d}:{i}".encode()).hexdigest()[:8], 16) % total for n in ns for d in range(1, draws + 1) for i in range(1, n + 1)}
        assert got == want


def _cells(idx):
    return (((i, d), idx[i, d]) for i in range(idx.shape[0]) for d in range(idx.shape[1]))


@pytest.mark.parametrize("name", ["r17_bootstrap_extremes", "r17_bootstrap_majority"])
def test_empty_scores_and_keys_as_in_sql(spark, tmp_path, name):
    rows = []
    for i in range(160):
        kind = None if i % 41 == 0 else ("view", "click", "long " * 12)[i % 3]
        score = None if i % 4 == 1 or i % 5 == 4 else float(i * 7 % 13)
        rows.append((i, None if i % 37 == 0 else i % 5, kind, score, "{}" if i % 11 == 0 else '{"k": %d}' % (i % 7)))
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.selectExpr("*", "timestamp'2024-01-01 00:00:00' AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) is None


def test_draws_take_more_tasks_than_a_shuffle(spark):
    from loomgraph.operators import rollout as M

    df = spark.createDataFrame([(g, i, float(i)) for g in range(9) for i in range(3)], "g int, idx long, score double")
    plan = M.bootstrap_extremes(df, ["g"], draws=4)._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("MapInArrow") :].split("SortMergeJoin")[1].count("16), REPARTITION_BY_NUM") == 2
