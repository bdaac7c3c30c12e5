"""Near-duplicates, decontamination, language model and toxicity against brute force or held-out rows."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, language_model, simhash, toxicity, vector_dedup
from loomgraph.llm.common import crc_mod

DOCS = "doc_id long, text string, fp string, held_out string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS)


def components(nodes, linked):
    label = {n: n for n in nodes}
    while True:
        new = {n: min([label[n], *(label[m] for m in linked[n])]) for n in nodes}
        if new == label:
            return label
        label = new


# ---- SimHash

def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=150) for _ in range(8)]
    texts = [" ".join(w if rng.random() > 0.004 else rng.choice(words) for w in rng.choice(base)) for _ in range(150)]
    texts += [None, "", " \t", "one", "ONE", "É two", "é two", "x " * 30000]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    got = simhash.simhash_groups(docs(spark, rows)).collect()
    prints = {i: plain_print(t) for i, t in rows}
    linked = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2] for i in prints}
    want = components(list(prints), linked)
    assert len(got) == len(rows)
    for r in got:
        assert r.fp & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == want[r.doc_id]
    left = simhash.drop_near_copies(docs(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values())) and left.columns == ["doc_id", "text", "fp", "held_out"]


def test_simhash_links_up_to_two_bits_only(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ m for b in base for m in (0, 1, 3 << 20, 1 << 5 | 1 << 60, 7 << 30)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = simhash.linked_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    want = {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    assert {frozenset((unsigned(r.a), unsigned(r.b))) for r in pairs} == want and len(pairs) == len(want)


def test_simhash_null_ids_and_nothing(spark):
    got = simhash.simhash_groups(docs(spark, [(None, "a b c"), (4, "a b c"), (None, "q r s t")])).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "4", "None"]
    assert simhash.drop_near_copies(docs(spark, [(None, "q r s t")] * 2)).count() == 1
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


# ---- vectors

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "clash") for i, v, l in rows], "vec_id long, embedding array<float>, label int, node string")


@pytest.mark.parametrize("chunk", [8192, 20])
def test_vector_groups_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((160, 24))
    x[60:130] = x[0] + rng.standard_normal((70, 24)) * rng.uniform(0.05, 0.5, (70, 1))  # a dense cloud with pairs around the limit
    x[130:140] = x[5] * rng.uniform(0.1, 9, (10, 1))
    x[140:150] = x[6]
    rows = [(i, [float(c) for c in v.astype("f4")], int(i % 7 == 0)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, [None] + [1.0] * 23, 1), (905, rows[6][1], None)]
    odd += [(906, [float("inf")] + [1.0] * 23, 0), (907, rows[6][1][:10], 0)]
    got = {r.vec_id: r for r in vector_dedup.embedding_groups(vectors(spark, rows + odd)).collect()}
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    near = (y @ y.T >= 0.93) & (lab[:, None] == lab)
    linked = {i: np.flatnonzero(near[i]).tolist() for i in range(len(rows))}
    want = components(list(range(len(rows))), linked)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(linked[i]) - 1, want[i], want[i] == i)
    for i, _, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_vectors_of_nothing(spark):
    assert vector_dedup.embedding_groups(vectors(spark, [])).count() == 0


# ---- decontamination

def test_decontamination_recall_and_precision(spark):
    rng = random.Random(4)
    voc = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(600)]
    items = [(i, " ".join(rng.choices(voc, k=rng.randint(12, 60)))) for i in range(60)]
    rows, edits = [], {}
    for n in range(240):
        item, text = items[n % 60]
        words = text.split()
        edits[n] = int(rng.choice([0, 0.1, 0.2, 0.45]) * len(words) + 1e-9)
        for at in rng.sample(range(len(words)), edits[n]):
            words[at] = "zz" + str(at)
        glue = rng.choice([" ", ", ", "\n"])
        rows.append((n, " ".join(rng.choices(voc, k=40)) + " . " + glue.join(words).upper() + ". " + " ".join(rng.choices(voc, k=300))))
    found = decontaminate.contaminated_pairs(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    meant = {(n, n % 60) for n in edits if edits[n] <= 0.2 * len(items[n % 60][1].split())}
    assert len(meant & set(got)) >= 0.97 * len(meant)
    assert all(got[p] <= edits[p[0]] for p in meant & set(got)) and set(got) <= meant


def test_decontamination_edge_cases(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (1, "Alpha beta"), (2, None), (3, ""), (4, "..."), (None, "gamma delta epsilon")], "item_id long, text string")
    texts = [(1, "x alpha, BETA y"), (2, None), (3, ""), (None, "Gamma delta epsilon"), (5, "alpha gamma beta"), (6, "word " * 40000 + "alpha beta")]
    got = decontaminate.contaminated_pairs(docs(spark, texts + texts[:1]), items).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.edits) for r in got) == [("1", "1", 0), ("1", "1", 0), ("6", "1", 0), ("None", "None", 0)]
    left = decontaminate.drop_contaminated(docs(spark, texts), items)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "5"]
    assert decontaminate.contaminated_pairs(docs(spark, []), items).count() == 0
    assert decontaminate.drop_contaminated(docs(spark, texts), items.limit(0)).count() == len(texts)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(12)]
    got = decontaminate.contaminated_pairs(docs(spark, items), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(12)]


def test_decontamination_blocks_are_collected_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(8))) for i in range(6)]
    n, blocks = decontaminate.item_blocks(spark.createDataFrame(items, "item_id long, text string"))
    assert n > 1 and iter(blocks) is blocks and sum(len(b) for b in blocks) == 6
    rows = items + [(7, "clean"), (8, None), (8, None), (9, items[0][1])]
    left = decontaminate.drop_contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [7, 8, 8] and left.columns == ["doc_id", "text", "fp", "held_out"]


def test_decontamination_memory_follows_the_benchmark_text():
    import tracemalloc

    rng = random.Random(6)
    voc = [f"v{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choices(voc, k=rng.choice([12, 60, 500])))) for i in range(150)]
    tracemalloc.start()
    index = decontaminate.Index(items, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * sum(len(t) for _, t in items)
    assert index.scan([items[3][1], "other words"])[0][0][:2] == (3, 0)


# ---- language model

@pytest.mark.parametrize("shard", [2_000_000, 300])
def test_language_model_matches_plain_kneser_ney(spark, monkeypatch, shard):
    monkeypatch.setattr(language_model, "SHARD", shard)
    rng = random.Random(9)
    voc = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices(voc, [1 / (k + 1) for k in range(80)], k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "É é X x"), (203, "new words only here"), (7, rows[7][1]), (None, "v1 v2")]
    got = language_model.language_model_scores(docs(spark, rows), crc_mod(F.col("doc_id"), 7) == 2).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [0]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    train = [tokens(t) for i, t in rows if not held(i)]
    uni = Counter(w for d in train for w in d)
    pairs = Counter(p for d in train for p in zip([1, *d], d))
    context, follow = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (a, b), c in pairs.items():
        context[a][0] += c
        context[a][min(c, 3)] += 1
        follow[b] += 1
    d = language_model.discounts([sum(c == i for c in pairs.values()) for i in range(1, 5)])
    e = language_model.discounts([sum(c == i for c in follow.values()) for i in range(1, 5)])
    left = sum(e[min(c, 3) - 1] for c in follow.values()) / len(pairs)

    def p(a, b):
        low = (follow[b] - e[min(follow[b], 3) - 1] if follow[b] else 0) / len(pairs) + left / (len(uni) + 1)
        if a not in context:
            return low
        total, *few = context[a]
        c = pairs.get((a, b), 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + sum(x * y for x, y in zip(d, few)) / total * low

    assert sum(p(b"v1", w) for w in uni) + p(b"v1", "unknown") == pytest.approx(1)
    n = sum(uni.values())
    want = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in ws)
        score = sum(math.log10(p(a, b)) for a, b in zip([1, *ws], ws))
        want.append((str(i), held(i), len(ws), sum(w in uni for w in ws), n, round(base, 7), round(score, 7)))
    found = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in got]
    assert sorted(found) == sorted(want)


def test_language_model_without_rows(spark):
    assert language_model.language_model_scores(docs(spark, []), F.lit(False)).count() == 0
    only = language_model.language_model_scores(docs(spark, [(1, "a b")]), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in only] == [(3, 0, 0, 0.0, 0.0)]


def test_arrays_survive_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (language_model.unpack_sorted(language_model.pack_sorted(x)) == x).all()
    assert (language_model.unmix(language_model.mix(x)) == x).all()


# ---- toxicity

def labelled(n, seed=0):
    rng = random.Random(seed)
    voc = ["".join(rng.choices(["the", "re", "on", "ti", "sh", "ea", "lo", "st"], k=rng.randint(1, 4))) for _ in range(500)]
    bad = ["blarg", "snokk", "vuxlert"]
    rows = []
    for i in range(n):
        words = rng.choices(voc, k=rng.randint(5, 120))
        is_bad = rng.random() < 0.2
        if is_bad:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words) + ".", is_bad))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.fit([(t, x) for _, t, x in labelled(600)])


def test_toxicity_on_held_out_rows(spark, model):
    rows = labelled(300, seed=1)
    got = toxicity.score_toxicity(docs(spark, [(i, t) for i, t, _ in rows]), model)
    score = {r.doc_id: r.score for r in got.collect()}
    assert sum((score[i] >= 0.5) == x for i, _, x in rows) >= 0.98 * len(rows)
    assert got.columns == ["doc_id", "text", "fp", "held_out", "score"]


def test_toxicity_sees_through_disguises(model):
    said = ["the sh b l a r g on", "the sh bl-arg on", "sh on s.n.o.k.k the", "sh vux1ert the", "the vuxxlert on", "SNOKK!!"]
    scores = toxicity.Scorer(model).score([f"{s} rethe onsh tire." for s in said])
    assert (scores >= 0.5).all()
    assert (toxicity.Scorer(model).score(["the b sh l on a the r", "t h e s h o n", "argblre snlokti"]) < 0.5).all()


def test_toxicity_of_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "||| --- 123"), (4, "the " * 60000 + "blarg"), (5, "x" * 3000), (6, "blarg"), (6, "blarg")]
    got = toxicity.score_toxicity(docs(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.text): r.score for r in got}
    assert by[1, None] == by[2, ""] < 0.5 < by[6, "blarg"]
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0


def test_toxicity_without_anything_to_learn():
    for rows in ([], [("fine words", False)] * 3, [("one", True)]):
        assert 0 <= toxicity.Scorer(toxicity.fit(rows)).score(["some text", None])[0] <= 1


def test_labelled_sample_is_bounded_and_whole(spark):
    rows = docs(spark, [(i, f"t{i}") for i in range(50)] + [(1, "t1"), (60, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (60, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(rows, labels, F.col("doc_id") != 5)
    assert ("t5", True) not in got and ("t3", True) not in got and ("t4", False) in got and len(got) == 49
    assert len(toxicity.labelled_sample(rows, labels, F.lit(True), limit=10)) <= 11


def test_the_fit_runs_in_a_task(spark, monkeypatch):
    rows = [(f"the plain text number {i}", False) for i in range(40)] + [(f"you utter blockhead number {i}", True) for i in range(20)]
    want = toxicity.fit(sorted(rows))
    sample = spark.createDataFrame(rows, "text string, toxic boolean")
    empty = toxicity.fit_in_task(sample.filter("text is null"))
    assert empty.kernel.landmarks == []

    driver, plain_fit = os.getpid(), toxicity.fit

    def elsewhere(rows):
        assert os.getpid() != driver
        return plain_fit(rows)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    got = toxicity.fit_in_task(sample)
    assert got.kernel.landmarks == want.kernel.landmarks
    assert np.array_equal(got.weights, want.weights) and np.array_equal(got.document, want.document)
