"""Statement files: one copy of every row, whatever happens to the tasks that write them."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import statements as T


def test_every_statement_once_in_files_of_a_batch(spark, tmp_path):
    names = ["plain", "it's", "back\\slash", "two\nlines", "", None]
    rows = [(i, "APPLIED_BY", "Organization", names[i % 6]) for i in range(600)]
    edges = spark.createDataFrame(rows, "src_id long, rel_type string, dst_label string, dst_name string").repartition(3)
    path = str(tmp_path / "out")
    T.write_statements(T.edge_statements(edges), path, batch=70)
    got = T.read_statements(spark, path).collect()
    escaped = {"it's": "it\\'s", "back\\slash": "back\\\\slash", "two\nlines": "two\\nlines"}
    want = [
        f"MATCH (i:Item {{id: '{i}'}}) MATCH (e:Organization {{name: '{escaped.get(n, n)}'}}) MERGE (i)-[:APPLIED_BY]->(e);"
        for i, _, _, n in rows
        if n is not None
    ]
    assert sorted(r["statement"] for r in got) == sorted(want)
    per_file = {}
    for r in got:
        per_file[r["file"]] = per_file.get(r["file"], 0) + 1
    assert max(per_file.values()) <= 70
    with pytest.raises(Exception, match="already holds statements"):
        T.write_statements(T.edge_statements(edges), path)


def test_files_of_a_failed_attempt_count_for_nothing(tmp_path):
    writer = T.StatementWriter(str(tmp_path), 10)
    for prefix, n in (("part-00000-1", 2), ("part-00000-7", 1), ("part-00001-2", 1)):
        for i in range(n):
            (tmp_path / f"{prefix}-{i}.txt").write_text("x;\n")
    writer.commit([T.Written("part-00000-7", 1, 1), None, T.Written("part-00001-2", 1, 1)])
    assert sorted(os.listdir(tmp_path)) == ["manifest.json", "part-00000-7-0.txt", "part-00001-2-0.txt"]


def test_abort_leaves_nothing(tmp_path):
    (tmp_path / "part-00000-1-0.txt").write_text("x;\n")
    T.StatementWriter(str(tmp_path), 10).abort([T.Written("part-00000-1", 1, 1), None])
    assert os.listdir(tmp_path) == []


def test_writing_from_another_thread(spark, tmp_path):
    path = str(tmp_path / "other")
    rows = spark.range(5).select(F.col("id").cast("string").alias("statement"))
    with ThreadPoolExecutor(1) as pool:
        pool.submit(T.write_statements, rows, path).result()
    assert T.read_statements(spark, path).count() == 5


def test_no_statements(spark, tmp_path):
    path = str(tmp_path / "none")
    T.write_statements(spark.range(0).select(F.col("id").cast("string").alias("statement")), path)
    assert T.read_statements(spark, path).count() == 0
