"""Pipelined search against plain scores, over many small blocks and bundles."""

import math
import random
import re
from collections import Counter

import pytest

from loomgraph.llm import pipelined_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    split = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in split)
    n_terms = sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        hits = []
        for d, c in split:
            n = sum(c.values())
            score = 0
            for t in wanted & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * n * n_docs) // n_terms)))
            if score:
                hits.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(hits)[:top])]
    return sorted(out, key=repr)


def run(spark, docs, items, top):
    left = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, score int")
    right = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in S.ranked_search(left, right, top).collect()), key=repr)


@pytest.mark.parametrize("docs_of_block,postings", [(8_192, 400_000), (7, 30)])
def test_against_plain_scores(spark, monkeypatch, docs_of_block, postings):
    monkeypatch.setattr(S, "BLOCK_DOCS", docs_of_block)
    monkeypatch.setattr(S, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(S, "BUNDLE", 3)
    rng = random.Random(postings)
    words = [f"w{i}" for i in range(80)] + ["Été", "日本", "naïve", "X9"]
    weights = [3 / (i + 1) for i in range(80)] + [0.1] * 4
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 120])))) for i in range(220)]
    docs += [(500 + i, "w0 w1 copy, copy") for i in range(110)]  # a third of all are one text
    docs += [(7, "w5 again"), (7, "w5 again"), (None, "w70 w71"), (800, None), (801, ""), (802, "?! \t"), (803, "w0 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(20, "COPY w1"), (21, None), (22, "unknown"), (23, ""), (24, "w5"), (24, "w70"), (None, "w2 w2 日本")]
    assert run(spark, docs, items, 9) == plain(docs, items, 9)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 5) == [] and run(spark, [(1, "a")], [], 5) == []


def test_filter_passes_every_term_asked_for(spark):
    asked = spark.createDataFrame([(f"t{i}é",) for i in range(500)], "term string")
    told = S.TermFilter(asked)
    assert all(told.passes(f"t{i}é".encode()) for i in range(500))
    assert sum(told.passes(f"other{i}".encode()) for i in range(2_000)) < 20
