"""Keyed streaming queues over several batches and restarts, against a plain queue."""

import random

from pyspark.sql import functions as F

from loomgraph.runtime import scratch_path
from loomgraph.streaming import queues as Q
from loomgraph.streaming import rollouts as ST

SCHEMA = "kind string, n bigint, score double, take bigint"


def test_queues_against_plain_lists(spark, monkeypatch):
    monkeypatch.setattr(Q, "ROOM", -18)  # the oldest go while the rows pass
    rng = random.Random(2)
    folder, out, cp = (scratch_path(spark, n) for n in ("q-in", "q-out", "q-cp"))
    held, counts, taken, n = {}, {}, [], 0
    for batch in range(4):
        rows = []
        for kind in ["a", None, "b"][: 1 + batch % 3]:
            fresh = []
            for _ in range(rng.randint(0, 9)):
                n += 1
                fresh.append((kind, (1 << 60) + n, rng.choice([None, 0.5]), None))
            ask = rng.choice([None, 2, 30]) if batch else None
            rows += fresh + ([(kind, None, None, ask)] if ask else [])
            if not fresh and not ask:
                continue
            queue = held.get(kind, []) + [r[1] for r in fresh]
            made, used, lost = counts.get(kind, (0, 0, 0))
            lost += max(0, len(queue) - 5)
            queue = queue[-5:]
            taken += [(kind, x) for x in queue[: ask or 0]]
            held[kind], counts[kind] = queue[ask or 0 :], (made + len(fresh), used + len(queue[: ask or 0]), lost)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        with Q.keyed_state(spark):  # a new query every time: state comes from the checkpoint
            stream = ST.file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema)
            ST.run_available(Q.bounded_queues(stream, "kind", ["n", "score"], ["n"], 5), cp, ST.to_batches(out), "update")
    rows = spark.read.parquet(out)
    assert sorted(((r["kind"], r["n"]) for r in rows.filter("event = 'taken'").collect()), key=repr) == sorted(taken, key=repr)
    last = rows.filter("event = 'state'").groupBy("kind").agg(F.max_by(F.struct("produced", "consumed", "dropped", "queue_size"), "batch").alias("s"))
    assert {r["kind"]: tuple(r["s"]) for r in last.collect()} == {k: (*c, len(held[k])) for k, c in counts.items()}
    left = {}
    for r in Q.queue_contents(spark, cp, "kind").collect():
        left.setdefault(r["kind"], []).append(r["n"])
    assert {k: sorted(v) for k, v in left.items()} == {k: v for k, v in held.items() if v}
