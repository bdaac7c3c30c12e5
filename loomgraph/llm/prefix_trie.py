"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt out in ranges of their ids. A task cuts its range into shards of bounded size; in a shard,
every (position, turn) has a bitset of the conversations that hold it. From the root downwards, the bitset of a node
meets the postings of the next position: each non-empty intersection is a child, its popcount the number of members,
and the members without a next turn end there. Nodes are named by a digest of their path, so shards need not know each
other: nodes of all shards are merged by name, and sums over subtrees double their reach in every round.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import digest, keep, word_count

# bounds of a shard; one conversation of more turns is a shard of its own
SHARD_TURNS, SHARD_CONVERSATIONS = 50_000, 1_024
ROWS = 5_000  # rows of a batch that leaves a task
ROOT = b"\0" * 16
ROUNDS = 4  # doubling rounds in one plan

SHARD_NODES = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("above", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64())]
    + [("n_convs", pa.int64()), ("words", pa.int64()), ("shard", pa.int64()), ("ends", pa.string())]
)
NODES = pa.schema([*list(SHARD_NODES)[:7], ("ends_sha256", pa.string())])


def turn_keys(conversations: DataFrame) -> DataFrame:
    """`(conv_id, turn, key, words)`: the digest of role and text and the words of the text; null ones count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(F.col("conv_id").cast("long"), "turn", digest(named).alias("key"), word_count(text).alias("words"))


def child_key(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


class Path:
    """Keys from the root to a node."""

    def __init__(self):
        self.keys = bytearray()

    def enter(self, depth: int, node: bytes) -> bytes:
        """Put `node` at `depth`; gives its ancestors 1, 2, 4, ... levels up."""
        del self.keys[16 * depth :]
        self.keys += node
        return b"".join(bytes(self.keys[16 * (depth - (1 << k)) : 16 * (depth - (1 << k)) + 16]) for k in range(depth.bit_length()))


class Conversation:
    """Turns of one conversation: 16 bytes and a number each."""

    def __init__(self, conv_id: int):
        self.conv_id, self.keys, self.words = conv_id, bytearray(), array("q")

    def add(self, key: bytes, words: int) -> None:
        self.keys += key
        self.words.append(words)

    def key(self, position: int) -> bytes:
        return bytes(self.keys[16 * position : 16 * position + 16])


def chain(one: Conversation) -> Iterator[tuple]:
    """Nodes of a shard of one conversation, without postings."""
    path, node, parent = Path(), ROOT, None
    n = len(one.words)
    for depth in range(n + 1):
        above = path.enter(depth, node)
        words = one.words[depth - 1] if depth else 0
        yield node, parent, above, depth, one.conv_id, 1, words, one.conv_id, str(one.conv_id) if depth == n else None
        if depth < n:
            node, parent = child_key(node, one.key(depth)), node


def shard_nodes(shard: list[Conversation]) -> Iterator[tuple]:
    """Nodes of a shard, depth first; the lowest bit of a bitset is its smallest id, for conversations come in order."""
    if len(shard) == 1:
        yield from chain(shard[0])
        return
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    lengths: dict[int, int] = defaultdict(int)
    for bit, one in enumerate(shard):
        lengths[len(one.words)] |= 1 << bit
        for position in range(len(one.words)):
            postings[position, one.key(position)] |= 1 << bit
    path = Path()
    todo = [(0, ROOT, None, 0, (1 << len(shard)) - 1)]
    while todo:
        depth, node, parent, words, bits = todo.pop()
        above = path.enter(depth, node)
        ended = bits & lengths.get(depth, 0)
        ends = ",".join(str(shard[i].conv_id) for i in bits_of(ended)) if ended else None
        least = shard[(bits & -bits).bit_length() - 1]
        yield node, parent, above, depth, least.conv_id, bits.bit_count(), words, shard[0].conv_id, ends
        left = bits ^ ended
        while left:
            first = shard[(left & -left).bit_length() - 1]
            key = first.key(depth)
            child = left & postings[depth, key]
            todo.append((depth + 1, child_key(node, key), node, first.words[depth], child))
            left ^= child


def bits_of(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def shards_of(rows: Iterable[tuple]) -> Iterator[list[Conversation]]:
    """Conversations, in order of their ids, in shards of bounded size. `rows`: id, key or null, words."""
    shard: list[Conversation] = []
    turns = 0
    for conv_id, key, words in rows:
        if not shard or shard[-1].conv_id != conv_id:
            if len(shard) >= SHARD_CONVERSATIONS or turns >= SHARD_TURNS:
                yield shard
                shard, turns = [], 0
            shard.append(Conversation(conv_id))
        if key is not None:
            if turns >= SHARD_TURNS and len(shard) > 1:
                # a long conversation leaves the others
                yield shard[:-1]
                shard, turns = shard[-1:], len(shard[-1].words)
            shard[-1].add(key, words)
            turns += 1
    if shard:
        yield shard


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def merged_nodes(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Nodes of all shards by name; `rows` come by node and shard, so the ids that end at a node are hashed as they pass."""
    node, seen = None, None
    for row in rows:
        if row[0] != node:
            if node is not None:
                yield node, *attributes, least, members, words, seen.hexdigest()
            node, attributes, words = row[0], row[1:4], row[6]
            least, members, seen, empty = row[4], 0, hashlib.sha256(), True
        least, members = min(least, row[4]), members + row[5]
        if row[8] is not None:
            seen.update(("" if empty else ",").encode() + row[8].encode())
            empty = False
    if node is not None:
        yield node, *attributes, least, members, words, seen.hexdigest()


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.binary(): "binary", pa.int64(): "long", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns: `(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)`.

    `turns(conv_id, turn, key, words)` as of `turn_keys`; other columns are ignored. Turns go by `turn`, null first, equal
    ones by key; repeated rows are turns of their own. A row with a null key says only that the conversation exists, so it
    may have no turns and end at the root. Rows with a null `conv_id` belong to no conversation and are left out. No rows
    give no nodes. A task holds one shard, and 40 bytes for each turn of the longest conversation; one conversation is not
    split. A node that many conversations share is one row per shard by the time rows are shuffled by name.
    """
    dealt = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "key", "words").repartitionByRange("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "key").select("conv_id", "key", "words")

    def cut(batches):
        nodes = (node for shard in shards_of(rows_of(batches)) for node in shard_nodes(shard))
        return in_batches(nodes, SHARD_NODES)

    def merge(batches):
        return in_batches(merged_nodes(rows_of(batches)), NODES)

    by_name = dealt.mapInArrow(cut, spark_schema(SHARD_NODES)).repartition("node").sortWithinPartitions("node", "shard")
    merged = by_name.mapInArrow(merge, spark_schema(NODES))
    known = F.struct("parent", "above", "depth", "conv_id", "n_convs", "words", "ends_sha256")

    def row_of(node, own, child, leaf):
        return F.struct(F.col(node).alias("node"), own.alias("own"), child.alias("child"), leaf.alias("leaf"))

    # every node tells its parent of one child, and of one leaf when the rest of the way down is its own
    told = merged.select(
        F.inline(
            F.array(
                row_of("node", known, F.lit(0), F.lit(0)),
                row_of("parent", F.when(F.lit(False), known), F.lit(1), F.when(F.col("n_convs") == 1, 1).otherwise(0)),
            )
        )
    ).filter("node IS NOT NULL")
    sums = told.groupBy("node").agg(F.first("own", ignorenulls=True).alias("own"), F.sum("child").alias("n_children"), F.sum("leaf").alias("leaves"))
    nodes = keep(sums.select("node", "own.*", "n_children", "leaves"), "trie-nodes")
    shared = nodes.filter("n_convs > 1")
    totals = subtree_sums(
        shared.select(
            "node",
            "above",
            (F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        shared.agg(F.max("depth")).first()[0] or 0,
    )
    root = nodes.filter("depth = 0").select("conv_id").scalar()
    # below a node of one conversation all is that conversation's; only shared parents are looked up
    parents = shared.select(F.col("node").alias("up"), F.col("conv_id").alias("up_id"))
    deep = F.when(F.col("depth") > 1, F.col("parent")).otherwise(F.col("node"))
    placed = nodes.join(totals, "node", "left").withColumn("up", deep).join(parents, "up", "left")
    return placed.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == 1, root).when(F.col("depth") > 1, F.coalesce("up_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        "ends_sha256",
    )


def subtree_sums(own: DataFrame, deepest: int) -> DataFrame:
    """Sums of the two numbers over each subtree. Before round k a node's sums reach 2^k - 1 levels down; in it they go to
    the ancestor 2^k levels up. One shuffle a round, summed before it, so a node with many nodes below is no hot key."""
    sums = own
    for k in range(deepest.bit_length()):
        up = F.when(F.octet_length("above") >= 16 * (k + 1), F.substring("above", 16 * k + 1, 16))
        numbers = [F.col("n_leaves"), F.col("saved_tokens")]
        both = F.array(F.struct("node", "above", *numbers), F.struct(up.alias("node"), F.lit(None).cast("binary").alias("above"), *numbers))
        sums = sums.select(F.inline(both)).filter("node IS NOT NULL")
        sums = sums.groupBy("node").agg(F.max("above").alias("above"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        if k % ROUNDS == ROUNDS - 1:
            sums = keep(sums, "trie-sums")
    return sums.select("node", "n_leaves", "saved_tokens")
