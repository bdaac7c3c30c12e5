"""Sheet rows to edges: names and topics that are no nodes lose theirs, the rest is kept once."""

import re
import sys

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import presets as P
from loomgraph.functions.columns import strip
from loomgraph.operators import resolution as R
from loomgraph.plans import graph_build as B


@pytest.fixture(scope="module")
def built(spark):
    cells = {
        "application_no": ["N1", "N2", " N2 ", "N3"],
        "applicants": [" Acme Works; ACME WORKS ;李明", "Other Firm", "late", "n/a"],
        "ipc_main": ["H01M8/10", " H01M8/10", "x", "无"],
        "legal_status": ["有效", None, "x", "有效"],
    }
    fields = list(P.SHEET_COLUMNS.values())
    rows = [tuple(cells[f][i] if f in cells else None for f in fields) for i in range(4)]
    raw = spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields)).coalesce(1)
    topic = F.when(F.col("application_no") == "N3", "no such topic").otherwise(P.ROOT_TOPIC)
    records = B.clean_records(raw.withColumn("file_name", F.lit("a.xlsx")).withColumn("tech_domain", topic))
    mapping = B.entity_mapping(B.entity_names(records), 1.0)
    return records, mapping, B.build_nodes(records, mapping)


def test_edges_have_both_ends_and_are_kept_once(built):
    records, mapping, nodes = built
    # a name that the mapping leaves out stands for itself
    mapping = mapping.filter("original_name <> 'Other Firm'")
    got = sorted(tuple(r) for r in B.build_edge_table(records, mapping, nodes).select("src_id", "rel_type", "dst_label", "dst_key", "dst_name").collect())
    assert got == sorted([
        ("N1", "APPLIED_BY", "Organization", "Acme Works", "Acme Works"),
        ("N1", "APPLIED_BY", "Person", "李明", "李明"),
        ("N2", "APPLIED_BY", "Organization", "Other Firm", "Other Firm"),
        *[(n, "BELONGS_TO", "Topic", P.ROOT_TOPIC, P.ROOT_TOPIC) for n in ("N1", "N2")],
        *[(n, "CLASSIFIED_AS", "Code", "H01M8/10", "H01M8/10") for n in ("N1", "N2")],
        *[(n, "HAS_STATUS", "Status", "有效", "有效") for n in ("N1", "N3")],
    ])


def test_edges_do_not_move_to_meet_their_ends(built):
    plan = B.build_edge_table(*built)._jdf.queryExecution().optimizedPlan().toString()
    # a topic, code or status is one key for all records, so edges of records are only put together
    assert plan.startswith("Union")
    kinds = re.split(r"^[:+]- ", plan, flags=re.M)[1:]
    for rel in ("BELONGS_TO", "CLASSIFIED_AS", "PUBLISHED_IN", "HAS_STATUS"):
        of_rel = [k for k in kinds if k.startswith("Project") and f"{rel} AS rel_type" in k]
        assert len(of_rel) == 1 and "Join" not in of_rel[0]


def test_strip_takes_what_the_regular_expression_took(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or 0xFE00 <= c < 0x10000)]
    rows = spark.createDataFrame([(c, f"{chr(c)} a{chr(c)}b \r\n{chr(c)}") for c in points] + [(0, None), (-1, " \t\n"), (-2, "")], "c int, s string")
    old = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    assert rows.filter(~strip(F.col("s")).eqNullSafe(old)).collect() == []


def test_at_a_ratio_of_one_only_equal_forms_meet(spark, monkeypatch):
    names = spark.createDataFrame([("Acme Ltd",), ("ACME",), ("Acne",), ("acme, ltd",), ("Zeta",)], "name string")
    want = {tuple(r) for r in R._segment_pairs(R._blocked(names).withColumn("side", F.lit(0)), 1.0).collect()}

    def never(*args, **kwargs):
        raise AssertionError("no segment can be of use")

    monkeypatch.setattr(R, "_segment_pairs", never)
    assert {tuple(r) for r in R.similar_in_block(names, 1.0).collect()} == want and want
    assert R.similar_across_blocks(names, 1.0).collect() == []
