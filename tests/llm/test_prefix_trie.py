"""Prefix trie against a plain nested build."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, shard long"


def plain_trie(sequences):
    """Rows of the trie of `{id: [(role, text), ...]}`, by walking every prefix."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    rows = []
    for node, ids in members.items():
        leaves = saved = 0
        todo = [node]
        while todo:
            at = todo.pop()
            todo += children[at]
            leaves += not children[at]
            words = len(re.findall(r"[^\x20\x09-\x0D]+", at[-1][1])) if at else 0
            saved += (len(members[at]) - 1) * words
        ends = ",".join(map(str, sorted(c for c in ids if len(sequences[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(ids), len(node), parent, len(ids), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 3, None) for r in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(rng, n, turns, words):
    out = []
    for c in range(n):
        out += [(c * 3, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(rng.randint(1, turns))]
    return out


def sequences_of(rows):
    out = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[c].append((role or "", text or ""))
    return dict(out)


@pytest.mark.parametrize("turns,limit", [(4, 50_000), (9, 7), (40, 30)])
def test_against_plain_trie(spark, monkeypatch, turns, limit):
    rng = random.Random(turns)
    rows = conversations(rng, 120, turns, ["yes", "no words", None])
    got = prefix_trie.prefix_trie(prefix_trie.turn_keys(frame(spark, rows)))
    # shards of a few turns: the same node comes from many shards, long conversations leave the others
    nodes = [n for s in prefix_trie.shards_of([(1, b"a" * 16, 1)] * 9 + [(2, b"b" * 16, 1)]) for n in prefix_trie.shard_nodes(s)]
    assert len({n[0] for n in nodes}) == 11
    assert rows_of(got) == plain_trie(sequences_of(rows))


def test_small_shards_give_the_same_nodes(monkeypatch):
    rng = random.Random(2)
    keys = [b"%16d" % i for i in range(3)]
    stream = [(c, rng.choice(keys), 2) for c in range(90) for _ in range(rng.randint(1, 12))]

    def merged(turns, convs):
        monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
        monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", convs)
        parts = [n for s in prefix_trie.shards_of(stream) for n in prefix_trie.shard_nodes(s)]
        return list(prefix_trie.merged_nodes(sorted(parts, key=lambda n: (n[0], n[7]))))

    whole = merged(10**6, 10**6)
    for turns, convs in ((1, 10), (5, 10), (20, 3), (10**6, 1), (30, 10**6)):
        assert merged(turns, convs) == whole


def test_copies_of_a_long_conversation_and_growing_prefixes(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(12) for t in range(150)]
    rows += [(100 + n, t, "user", f"turn {t}") for n in range(60) for t in range(n + 1)]
    got = prefix_trie.prefix_trie(prefix_trie.turn_keys(frame(spark, rows)))
    assert rows_of(got) == plain_trie(sequences_of(rows))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (None, 0, "user", "lost"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 1, "", "")]
    got = prefix_trie.prefix_trie(prefix_trie.turn_keys(frame(spark, rows)))
    told = {1: [("", ""), ("user", "a")], 2: [("user", "a"), ("user", "a")], 3: [("", "")]}
    assert rows_of(got) == plain_trie(told)
    assert prefix_trie.prefix_trie(prefix_trie.turn_keys(frame(spark, []))).count() == 0


def test_role_and_text_are_kept_apart(spark):
    rows = [(1, 0, "user", "x"), (2, 0, "use", "rx")]
    got = prefix_trie.prefix_trie(prefix_trie.turn_keys(frame(spark, rows)))
    assert got.filter("depth = 1").count() == 2


def test_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, "user", rng.choice(["a", "b b", "c"])) for c in range(0, 90) if c % 20 or c % 3 for t in range(rng.randint(1, 5))]
    rows += [(-25, 0, "user", "a"), (-20, 0, "user", "q"), (-20, 1, "user", "r")]
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    own = sequences_of(rows)
    told = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        told[c] = own.get(base, [])[:h] + turns[h:]
    assert rows_of(queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path))) == plain_trie(told)
