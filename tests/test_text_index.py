"""Stored postings against a plain BM25."""

import math
import random
import re
from collections import Counter

import pytest

from loomgraph.operators import text_index as TI

K1, B = 1.2, 0.75


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(docs, query):
    """Scores of `{key: text}`."""
    split = {d: words(t) for d, t in docs.items()}
    mean = sum(map(len, split.values())) / len(split)
    out = Counter()
    for term in dict.fromkeys(words(query)):
        df = sum(term in w for w in split.values())
        idf = math.log(1 + (len(split) - df + 0.5) / (df + 0.5))
        for d, w in split.items():
            if tf := w.count(term):
                out[d] += idf * tf / (tf + K1 * (1 - B + B * len(w) / mean))
    return out


def best(scores, k):
    return [(d, round(s, 6)) for d, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    out = {i: " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 8, 40, 200]))) for i in range(400)}
    out |= {400: None, 401: "", 402: "W0, w59! é_w59"} | {500 + i: "w1 w2 copy" for i in range(150)}
    return out


@pytest.mark.parametrize("size", [512, 8])
def test_searches_equal_a_plain_bm25(spark, monkeypatch, docs, size):
    monkeypatch.setattr(TI, "SHARD_DOCS", size)
    monkeypatch.setattr(TI, "FIRST_SHARDS", 2)
    index = TI.build_text_index(spark.createDataFrame(list(docs.items()), "doc long, text string"), "doc")
    asked = {"a": "w59 w0", "b": "copy W1 w1", "c": "w3 w17 w40 w5", "d": "none", "e": ""}
    rows = TI.search_many(index, spark.createDataFrame(list(asked.items()), "qid string, query string"), 7).collect()
    for q, query in asked.items():
        got = [(r["key"], round(r["score"], 6)) for r in sorted((r for r in rows if r["qid"] == q), key=lambda r: r["rank"])]
        assert got == best(plain(docs, query), 7)
    full = {r["doc"]: r["score"] for r in TI.search(index, "w59 copy", minimum=1.0).collect()}
    assert full == pytest.approx({d: s for d, s in plain(docs, "w59 copy").items() if s > 1.0})
    assert len(TI.search(index, "w0", k=5).collect()) == 5


def test_rows_of_one_key_are_one_document_and_null_is_a_key(spark):
    rows = [(1, "red red"), (1, "blue"), (None, "red"), (2, "green")]
    index = TI.build_text_index(spark.createDataFrame(rows, "item_id long, text string"))
    got = {r["item_id"]: r["score"] for r in TI.search(index, "red").collect()}
    assert got == pytest.approx(plain({1: "red red blue", None: "red", 2: "green"}, "red"))


def test_empty_table(spark):
    index = TI.build_text_index(spark.createDataFrame([], "item_id long, text string"))
    assert TI.search(index, "red").count() == 0


def test_texts_and_lists_move_once(spark):
    """Neither a count by document and term nor a part of a score is shuffled."""
    from loomgraph.operators.search import tfidf_weights

    docs = spark.createDataFrame([(i, f"w{i} w{i % 3} w0") for i in range(50)], "doc long, text string")
    index = TI.build_text_index(docs, "doc")
    hits = TI.search_many(index, spark.createDataFrame([("a", "w0 w1")], "qid string, query string"), 3)

    def dealt(df):
        return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())

    assert dealt(hits) and not [d for d in dealt(hits) if "qid#" in d and "key#" in d]
    weights = dealt(tfidf_weights(docs, "doc"))
    assert weights and not [d for d in weights if "doc#" in d and "term#" in d]
