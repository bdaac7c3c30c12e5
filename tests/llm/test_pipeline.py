"""Stages of the corpus pipeline against brute force."""

import random

import corpus_pipeline
from loomgraph.llm import near_copies
from pyspark.sql import functions as F
from test_models import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_dedup_stage_matches_brute_force(spark):
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "one two", "One TWO", "one two three"]
    for n in range(60):  # copies with a block of other words in the middle, around the limit
        base = rng.choices(voc, k=rng.randint(60, 200))
        texts.append(" ".join(base))
        for share in (0.02, 0.06, 0.1, 0.14):
            cut = int(share * len(base))
            texts.append(" ".join(base[:20] + [f"n{n}x{i}" for i in range(cut)] + base[20 + cut :]))
    texts += texts[6:9]
    rows = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    linked = {i: [j for j in range(len(rows)) if similarity(sets[i], sets[j]) >= 0.8] for i in range(len(rows))}
    pairs = [similarity(sets[i], sets[j]) for i in linked for j in linked[i] if j > i]
    assert sum(0.8 <= p < 0.9 for p in pairs) > 50
    want = components(list(range(len(rows))), linked)
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()}
    assert left == set(want.values())


def test_near_copies_null_ids_and_nothing(spark):
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(None, "a b c"), (4, "a b c"), (None, "q r s t"), (None, "q r s t")]], DOCS)
    got = near_copies.near_copy_groups(frame).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "None", "None"]
    assert near_copies.drop_near_copies(frame).count() == 2
    assert near_copies.drop_near_copies(frame.limit(0)).count() == 0


def test_simhash_links_are_candidates(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.choices([f"w{i}" for i in range(900)], k=1500)
    other = base[:700] + ["changed"] + base[701:]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(reversed(base)))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    sets = near_copies.shingle_sets(frame, 5).cache()
    node = {r.doc_id: bytes(r.node) for r in sets.collect()}
    got = {(bytes(r.a), bytes(r.b)) for r in near_copies.simhash_candidates(sets).collect()}
    assert got == {tuple(sorted((node[1], node[2])))}
    # with bands that never agree, the links of the fingerprints alone find the copy
    plain = near_copies.shingle_sets
    lone = lambda docs, words: plain(docs, words).withColumn("bands", F.array(F.col("doc_id").cast("long")))
    monkeypatch.setattr(near_copies, "shingle_sets", lone)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, "").collect()} == {1, 3}
