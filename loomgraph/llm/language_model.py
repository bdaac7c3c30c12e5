"""Interpolated modified Kneser-Ney bigram model in sorted, memory-mapped hash arrays.

Counting is done in two Spark jobs (words, then bigrams). Map tasks combine
what they count and send each shard one packed, sorted block; a reduce task
merges the blocks of a shard and writes the shard as plain numpy arrays into
the shared folder. Scoring tasks map those files and search them.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import keep, mounted_scratch

END = xxhash.xxh64_intdigest(b" end")  # a word holds no white space, so this is no word's hash
CHUNK = 400_000  # tokens worked on at once
HELD = 3_000_000  # counted entries that a map task holds before it merges them
SHARD = 2_000_000  # tokens to a shard, on average
U64 = np.uint64


# ---- arrays

def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, one byte plane after the other."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U64), dtype=U64)


def fold(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31)) ^ (x >> U64(62))) * U64(0x319642B2D24D8EC3)
    x = (x ^ (x >> U64(27)) ^ (x >> U64(54))) * U64(0x96DE1B173F119089)
    return x ^ (x >> U64(30)) ^ (x >> U64(60))


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Whole or not at all, so a task that runs twice does no harm."""
    part = f"{folder}/.{uuid.uuid4().hex}.npy"
    np.save(part, values)
    os.replace(part, f"{folder}/{name}.npy")


class Sharded:
    """Files `<name>-<shard>.npy` of a folder as one mapped array; `keys` must be sorted inside shards."""

    def __init__(self, folder: str, name: str, sizes: list[int]):
        self.sizes = sizes
        self.starts = [0, *accumulate(sizes)]
        self.bits = (len(sizes) - 1).bit_length()
        self.parts = [np.load(f"{folder}/{name}-{s}.npy", mmap_mode="r") if n else None for s, n in enumerate(sizes)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Global index of each of the sorted distinct `keys`, -1 where missing."""
        out = np.full(len(keys), -1, np.int64)
        cuts = np.searchsorted(shard_of(keys, self.bits), np.arange(len(self.parts) + 1))
        for s, part in enumerate(self.parts):
            a, b = cuts[s], cuts[s + 1]
            if a < b and part is not None:
                at = np.searchsorted(part, keys[a:b])
                near = np.minimum(at, len(part) - 1)
                out[a:b] = np.where(part[near] == keys[a:b], near + self.starts[s], -1)
        return out

    def take(self, index: np.ndarray) -> np.ndarray:
        """Values at ascending global indices, 0 where the index is -1."""
        out = np.zeros(len(index), np.int64)
        rows = np.flatnonzero(index >= 0)
        found = index[rows]
        cuts = np.searchsorted(found, self.starts)
        for s, part in enumerate(self.parts):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                out[rows[a:b]] = part[found[a:b] - self.starts[s]]
        return out


# ---- tokens

def token_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """`(rows, tokens, lengths)`: hashes of the words of whole texts, each text closed by the end token.

    `bytes.lower` and `bytes.split` touch ASCII letters and white space only.
    """
    hash_of = xxhash.xxh64_intdigest
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        tokens, lengths, first = array("Q"), [], 0
        for i in range(len(b)):
            before = len(tokens)
            tokens.extend(map(hash_of, (texts[i].as_py() or b"").lower().split()))
            tokens.append(END)
            lengths.append(len(tokens) - before)
            if len(tokens) >= CHUNK or i == len(b) - 1:
                yield b.slice(first, i + 1 - first), np.frombuffer(tokens, U64), np.array(lengths)
                tokens, lengths, first = array("Q"), [], i + 1


class Combiner:
    """Counts of a map task: merged as they gather, sent when merging no longer shrinks them."""

    def __init__(self, bits: int):
        self.bits, self.keys, self.counts, self.held = bits, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        if self.held > HELD:
            k, c = fold(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held = [k], [c], len(k)
            if self.held > HELD // 2:
                yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.keys:
            yield from blocks_of(*fold(np.concatenate(self.keys), np.concatenate(self.counts)), self.bits)
        self.keys, self.counts, self.held = [], [], 0


def blocks_of(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    shards = shard_of(keys, bits)
    edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(keys) else []
    for a, b in zip(edges, edges[1:]):
        row = [pa.array([shards[a]], pa.int64()), pa.array([pack_sorted(keys[a:b])]), pa.array([pack(counts[a:b].astype(np.uint32))])]
        yield pa.RecordBatch.from_arrays(row, ["shard", "keys", "counts"])


def count_keys(training: DataFrame, bits: int, keys_of) -> DataFrame:
    """`(shard, keys, counts)` blocks; `keys_of(tokens, lengths)` gives what is counted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Combiner(bits)
        for _, tokens, lengths in token_chunks(batches):
            yield from sums.add(keys_of(tokens, lengths))
        yield from sums.send()

    return training.select("text").mapInArrow(work, "shard long, keys binary, counts binary")


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All blocks of a shard as one; blocks are folded as they pile up."""
    keys, counts, held = [], [], 0
    for k, c in zip(table.column("keys"), table.column("counts")):
        keys.append(unpack_sorted(k.as_py()))
        counts.append(unpack(c.as_py(), np.uint32).astype(np.int64))
        held += len(keys[-1])
        if held > HELD:
            k, c = fold(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [k], [c], 0
    return fold(np.concatenate(keys), np.concatenate(counts))


def text_starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]])


def bigram_keys(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Key of (previous, word) for each token; a text's start is context 0, word i is context i + 1.

    Keys with an unknown word on either side mean nothing; callers mask them.
    """
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1] + 1
    before[starts] = 0
    return mix((before.astype(U64) << U64(32)) | np.maximum(ids, 0).astype(U64))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of entries seen 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = []
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * y
        out.append(min(max(d, 0.05), i - 0.05))
    return out


class Model:
    """What scoring tasks open: mapped word, bigram and context arrays, and the numbers in `model.json`."""

    def __init__(self, folder: str):
        with open(f"{folder}/model.json") as f:
            self.info = json.load(f)
        words, pairs = self.info["words"], self.info["pairs"]
        self.words = Sharded(folder, "word", words)
        self.pairs = Sharded(folder, "pair", pairs)
        self.word_count = Sharded(folder, "word-count", words)
        self.pair_count = Sharded(folder, "pair-count", pairs)
        self.context = [Sharded(folder, f"context-{k}", words) for k in ("total", "1", "2", "3")]
        self.follows = Sharded(folder, "follows", words)

    def score(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probabilities of the tokens by the model and by add-one, and which tokens are known."""
        info, starts = self.info, text_starts(lengths)
        n, v = info["tokens"], sum(info["words"])
        # look up each distinct word once, in order, then spread the values over the tokens
        distinct, token = np.unique(tokens, return_inverse=True)
        word = self.words.find(distinct)
        ids = word[token]
        known = ids >= 0
        base = np.log10((self.word_count.take(word) + 1) / (n + v + 1))[token]
        # lower order: how many different words a word follows
        d, types = info["follow_discounts"], max(1, sum(info["pairs"]))
        cont = self.follows.take(word)
        left = sum(x * y for x, y in zip(d, info["follow_counts"])) / types if sum(info["pairs"]) else 1.0
        low = np.where(cont > 0, cont - np.array([0.0, *d])[np.minimum(cont, 3)], 0.0) / types + left / (v + 1)
        low = low[token]
        # higher order
        pair, at = np.unique(bigram_keys(ids, starts), return_inverse=True)
        count = self.pair_count.take(self.pairs.find(pair))[at]
        before = np.empty(len(token), np.int64)
        before[0] = 0
        before[1:] = token[:-1]
        ahead = np.empty(len(token), bool)
        ahead[1:] = known[:-1]
        ahead[starts] = True
        contexts = []
        for values, start in zip(self.context, info["start"]):
            here = values.take(word)[before]
            here[starts] = start
            contexts.append(here)
        total, *few = contexts
        seen = ahead & (total > 0)
        count = np.where(known & seen, count, 0)
        total = np.where(seen, total, 1)
        d = info["discounts"]
        share = np.where(count > 0, count - np.array([0.0, *d])[np.minimum(count, 3)], 0.0) / total
        back = np.where(seen, sum(x * y for x, y in zip(d, few)) / total, 1.0)
        return np.log10(share + back * low), base, known


def train(training: DataFrame) -> str:
    """Count `training(text)` and return the folder of the model.

    Memory of a task is bounded by the shard size and the longest text; shards
    grow in number with the corpus. Keys are hashes, so shards are even
    whatever the words: a word that is a third of all tokens is one entry, and
    its followers are spread over all shards.
    """
    folder = mounted_scratch(training.sparkSession, "kneser-ney")
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (int(size / 6 / SHARD)).bit_length())
    shards = 1 << bits

    def words_of_shard(table: pa.Table) -> pa.Table:
        keys, counts = merged(table)
        shard = table.column("shard")[0].as_py()
        save(folder, f"word-{shard}", keys)
        save(folder, f"word-count-{shard}", counts.astype(np.uint64 if counts.max() >> 32 else np.uint32))
        return pa.table({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    counted = count_keys(training, bits, lambda tokens, lengths: tokens)
    done = counted.groupBy("shard").applyInArrow(words_of_shard, "shard long, n long, total long").collect()
    words, tokens = [0] * shards, 0
    for shard, n, total in done:
        words[shard] = n
        tokens += total
    starts = np.array([0, *accumulate(words)])
    if starts[-1] >= 1 << 32:
        raise ValueError("more than 2**32 different words")

    opened: dict[str, Sharded] = {}

    def pair_keys(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if "words" not in opened:
            opened["words"] = Sharded(folder, "word", words)
        distinct, token = np.unique(tokens, return_inverse=True)
        return bigram_keys(opened["words"].find(distinct)[token], text_starts(lengths))

    def pairs_of_shard(table: pa.Table) -> pa.Table:
        """Write a shard of bigrams; send on, for each range of words, what it tells of contexts and followers."""
        keys, counts = merged(table)
        shard = table.column("shard")[0].as_py()
        save(folder, f"pair-{shard}", keys)
        save(folder, f"pair-count-{shard}", counts.astype(np.uint64 if counts.max() >> 32 else np.uint32))
        both = unmix(keys)
        before, word = (both >> U64(32)).astype(np.int64), (both & U64(0xFFFFFFFF)).astype(np.int64)
        few = [(counts == i).astype(np.int64) for i in (1, 2)] + [(counts >= 3).astype(np.int64)]
        ids, *stats = fold(before, counts, *few)
        start = [int(s[0]) for s in stats] if len(ids) and ids[0] == 0 else [0] * 4
        if len(ids) and ids[0] == 0:
            ids, stats = ids[1:], [s[1:] for s in stats]
        ids = ids - 1
        followed, follows = fold(word, np.ones(len(word), np.int64))
        all_ids, *all_stats = fold(
            np.concatenate([ids, followed]),
            *(np.concatenate([s, np.zeros(len(followed), np.int64)]) for s in stats),
            np.concatenate([np.zeros(len(ids), np.int64), follows]),
        )
        rows = [{"part": -1, "shard": shard, "n": len(keys), "start": start, "few": [int((counts == i).sum()) for i in range(1, 5)]}]
        cuts = np.searchsorted(all_ids, starts)
        for s in range(shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                stats_of = [pack(x[a:b].astype(np.uint32)) for x in all_stats]
                rows.append({"part": s, "ids": pack_sorted(all_ids[a:b].astype(U64)), "stats": stats_of})
        return pa.Table.from_pylist(rows, PAIR_ROWS)

    pair_type = "part long, shard long, n long, start array<long>, few array<long>, ids binary, stats array<binary>"
    paired = count_keys(training, bits, pair_keys).groupBy("shard").applyInArrow(pairs_of_shard, pair_type)

    def contexts_of_part(table: pa.Table) -> pa.Table:
        """Write a range of the context arrays; pass the numbers of shards through."""
        part = table.column("part")[0].as_py()
        if part < 0:
            return table.select(["part", "shard", "n", "start", "few"])
        size, first = words[part], int(starts[part])
        sums = [np.zeros(size, np.int64) for _ in range(5)]
        for ids, stats in zip(table.column("ids"), table.column("stats")):
            at = (unpack_sorted(ids.as_py()) - U64(first)).astype(np.int64)
            for total, packed in zip(sums, stats.as_py()):
                total[at] += unpack(packed, np.uint32)
        for name, total in zip(("context-total", "context-1", "context-2", "context-3", "follows"), sums):
            save(folder, f"{name}-{part}", total.astype(np.uint64 if total.max() >> 32 else np.uint32))
        few = [int((sums[4] == i).sum()) for i in range(1, 5)] + [int((sums[4] >= 3).sum())]
        return pa.Table.from_pylist([{"part": part, "few": few}], PAIR_ROWS).select(["part", "shard", "n", "start", "few"])

    # the numbers of shards have a group each, else one task would gather all of them
    split = F.when(F.col("part") < 0, -1 - F.col("shard")).otherwise(F.col("part"))
    out_type = "part long, shard long, n long, start array<long>, few array<long>"
    rows = paired.withColumn("key", split).groupBy("key").applyInArrow(lambda t: contexts_of_part(t.drop_columns(["key"])), out_type).collect()
    pairs, start, few, follow = [0] * shards, np.zeros(4, np.int64), np.zeros(4, np.int64), np.zeros(5, np.int64)
    for r in rows:
        if r.part < 0:
            pairs[r.shard] = r.n
            start += r.start
            few += r.few
        else:
            follow += r.few
    info = {
        "words": words,
        "pairs": pairs,
        "tokens": tokens,
        "start": start.tolist(),
        "discounts": discounts(few.tolist()),
        "follow_discounts": discounts(follow[:4].tolist()),
        "follow_counts": [int(follow[0]), int(follow[1]), int(follow[4])],
    }
    with open(f"{folder}/model.json", "w") as f:
        json.dump(info, f)
    return folder


PAIR_ROWS = pa.schema(
    [
        ("part", pa.int64()),
        ("shard", pa.int64()),
        ("n", pa.int64()),
        ("start", pa.list_(pa.int64())),
        ("few", pa.list_(pa.int64())),
        ("ids", pa.binary()),
        ("stats", pa.list_(pa.binary())),
    ]
)


def score_texts(docs: DataFrame, folder: str) -> DataFrame:
    """`(doc_id, n_tokens, n_known, train_tokens, base_score, score)` of every row of `docs`, in the order of the input."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder)
        for rows, tokens, lengths in token_chunks(batches):
            score, base, known = model.score(tokens, lengths)
            starts = text_starts(lengths)
            columns = [
                rows.column("doc_id"),
                rows.column("held_out"),
                pa.array(lengths),
                pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                pa.array(np.full(len(lengths), model.info["tokens"])),
                pa.array(np.add.reduceat(base, starts)),
                pa.array(np.add.reduceat(score, starts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = [kind, "boolean", "long", "long", "long", "double", "double"]
    return docs.select("doc_id", "held_out", "text").mapInArrow(work, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def language_model_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Score every document by a model of those for which `held_out` is not true.

    Per row: the id, `held_out`, the number of tokens (words and one end), of
    those seen in training, the training tokens, the log10 probability by the
    add-one baseline and by the model. A null or empty text is its end alone.
    Rows that repeat count as often as they are there; null ids pass through;
    extra columns are ignored; an empty table gives an empty table, and with
    no training rows every token is unknown. The scores are written to the
    shared folder, then the model is removed.
    """
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    folder = train(marked.filter(~F.col("held_out")).select("text"))
    scored = keep(score_texts(marked, folder), "kneser-ney-scores")
    shutil.rmtree(folder, ignore_errors=True)
    return scored
