"""Tasks of the whole-relation queries grow in number, not in size."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph import runtime
from loomgraph.operators.graph import disambiguate_persons

PATH = "/root/testdata/sf0.001"


def test_spread_follows_the_input_size(spark, monkeypatch):
    lines = spark.read.parquet(f"{PATH}/lineitem.parquet")
    assert runtime.spread(lines, "l_orderkey").rdd.getNumPartitions() == 4
    monkeypatch.setattr(runtime, "TASK_BYTES", 5_000)
    dealt = runtime.spread(lines, "l_orderkey")
    assert dealt.rdd.getNumPartitions() > 10
    homes = dealt.select("l_orderkey", F.spark_partition_id().alias("task")).distinct()
    assert homes.count() == homes.select("l_orderkey").distinct().count()
    assert dealt.exceptAll(lines).count() == lines.exceptAll(dealt).count() == 0
    assert runtime.spread(spark.range(5).toDF("k"), "k").count() == 5


@pytest.mark.parametrize("name", ["w01_rank_inventor", "w01_rank_code", "w01_rank_domain", "a03_count_by_domain", "g04_disambiguate_persons", "g08_transfer_chain"])
def test_whole_relations_are_dealt_by_item_once(spark, monkeypatch, name):
    monkeypatch.setattr(runtime, "TASK_BYTES", 5_000)
    plan = entry.queries()[name](spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    # pairs of item and name are not shuffled again
    assert not [x for x in plan.splitlines() if "hashpartitioning(item_id" in x and "," in x.split("hashpartitioning(item_id")[1].split(")")[0].replace(", ENSURE", "").rpartition(",")[0]]


def test_groups_without_an_item_count_none(spark):
    rows = spark.createDataFrame([("a", "p", "t", None), ("a", "q", "t", 1), ("a", "q", "t", 1)], "name string, main_party string, topic string, item_id long")
    assert {(r["main_party"], r["items"], r["identities"]) for r in disambiguate_persons(rows).collect()} == {("p", 0, 2), ("q", 1, 2)}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sum_of_one_group_stays_in_many_tasks(spark, keys):
    rows = spark.range(0, 4000, 1, 8).select(F.lit("a").alias("k"), F.col("id"), (F.col("id") % 7).alias("v"))
    # neither a broadcast nor merged tasks may hide where the rows of the group meet
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        out = runtime.with_group_running_sum(rows, keys, [F.col("id")], F.col("v"), "run", 16)
        found = out.select("id", "run", F.spark_partition_id().alias("task")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {r["id"]: r["run"] for r in found} == {i: sum(j % 7 for j in range(i)) for i in range(4000)}
    assert len({r["task"] for r in found}) > 1
