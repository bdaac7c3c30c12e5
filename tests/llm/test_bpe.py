"""Byte-level BPE against the tokenizer library itself, and its round trip."""

import random

import pytest
import public_tokenizers
import tiktoken

from loomgraph.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = bpe.Vocabulary(PATH)
PIECES = ["a", "s", "t", "e", "l", "r", "'", "''", "'s", "'re", "'ll", "'v", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "1", "²"]
PIECES += ["é", "日", "!", "?", "😀", "̀", "ǅ", "S", "՘", "<|endoftext|>", "the", " ing"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(MODEL.raw), special_tokens={})


def both(library, texts):
    ids, bounds = bpe.encode_texts(texts, MODEL)
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [library.encode_ordinary(t) for t in texts]


def test_composition_is_associative():
    f = bpe.functions()
    every = range(f.n)
    at = lambda x, y: f.table[x * f.n + y]
    assert all(at(at(x, y), z) == at(x, at(y, z)) for x in every for y in every for z in every)


def test_random_texts_agree_with_the_library(library):
    rng = random.Random(5)
    for _ in range(600):
        both(library, ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(6)])
    both(library, ["", "", ""])


def test_every_code_point_agrees_with_the_library(library):
    both(library, ["".join(chr(c) + rng for c in range(0x110000) if not 0xD800 <= c < 0xE000) for rng in ("a ", " ")])


def test_chunks_of_long_texts_join(library, monkeypatch):
    rng = random.Random(6)
    for size in (1, 2, 3, 7, 40):
        monkeypatch.setattr(bpe, "CHUNK", size)
        both(library, ["".join(rng.choices(PIECES, k=60)) for _ in range(5)])


def test_long_runs_without_a_boundary(library):
    both(library, ["ab" * 30_000, "x" * 20_000, " " * 5_000, "'" * 999])


def test_round_trip_in_spark(spark, library):
    texts = ["Ein Text, it's fine.\n\n", None, "", "日本 'll 😀" * 400, "  twice", "  twice"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, decoded_text string, size string")
    encoded = bpe.decode(bpe.encode(docs, PATH), PATH)
    rows = encoded.collect()
    assert len(rows) == len(texts)
    both_ways = bpe.round_trip(docs, PATH)
    assert sorted(both_ways.collect()) == sorted(encoded.select(both_ways.columns).collect())
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
        parts = [library.decode_single_token_bytes(i) for i in r.ids]
        assert r.offsets == [sum(map(len, parts[:k])) for k in range(len(parts))]


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, IDS string")
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH)
    assert bpe.encode(docs, PATH, ids="tokens").count() == 0
