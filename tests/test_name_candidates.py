"""Names meet by their forms, and no place in a block keeps one from meeting those of the next."""

from difflib import SequenceMatcher

import __spark_entry__ as entry
from loomgraph.functions.text import comparison_name
from loomgraph.operators import resolution as R


def test_far_candidates_go_where_they_meet_and_all_names_of_a_form_come_back(spark):
    words = ["Katherina Miller", "katherina  miller", "KATHERINA MILLER", "Katherine Miller", "katherine miller", "Katherinas Miller", "Catherina Miller"]
    df = spark.createDataFrame([(w,) for w in words], "name string")
    norms = {r[0]: r[1] for r in df.select("name", comparison_name(df.name)).collect()}
    for near, prefix in ((R.similar_in_block(df, 0.9, prefix=0), 0), (R.similar_across_blocks(df, 0.9, head=None), 2)):
        lines = [x for x in near._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "seg#" in x]
        assert any("levenshtein" in x for x in lines)
        want = {}
        for a in words:
            for b in words:
                ratio = SequenceMatcher(None, norms[a], norms[b]).ratio()
                if a < b and ratio >= 0.9 and (prefix == 0 or norms[a][:2] != norms[b][:2]):
                    want[a, b] = round(ratio, 9)
        assert {(r["a"], r["b"]): round(r["ratio"], 9) for r in near.collect()} == want

def test_words_past_the_tenth_of_a_block_are_resolved_with_the_next(spark, tmp_path):
    first = [f"aa{c * 9}{i}" for i, c in enumerate("bcdefghijklm")] + ["aamnopqrstuvwxyz"]
    second = ["abmnopqrstuvwxyz"]
    for table, column in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name")):
        spark.createDataFrame([(f"{table} name",)], f"{column} string").write.parquet(str(tmp_path / f"{table}.parquet"))
    spark.createDataFrame([(" ".join(first + second),)], "text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["original_name"]: r["standard_name"] for r in entry.queries()["g03_resolve_words"](spark, str(tmp_path)).collect()}
    assert got["aamnopqrstuvwxyz"] == got["abmnopqrstuvwxyz"]
    assert len({got[w] for w in got}) == len(got) - 1
