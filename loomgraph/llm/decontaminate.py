"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import digest, keep

BLOCK_CHARS = 4_000_000  # benchmark text that travels to the tasks at once
CHUNK = 1_000_000  # words of documents worked on at once
WALKS, TABLES, SAMPLES = 8, 6, 4
KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space separate them."""
    return (text or "").lower().encode("utf-8", "replace").translate(KEEP).split()


def mixed(words: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each word number (splitmix64)."""
    x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def allowed_edits(n: int, similarity: float) -> int:
    return int((1 - similarity) * n + 1e-9)


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Fewest word edits between `item` and any stretch of `region`, and where the best stretch ends."""
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item, 1):
        best = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class LengthClass:
    """Items of about the same number of words, with their hash tables.

    A CGK walk reads a word at each step and moves on by a random bit that
    step and word decide: the top bit of the mixed word times the step's odd
    number, so a walk takes no memory by word. Item and window take the same walk, so after an edit
    they soon fall into step again and most samples agree. Samples are taken
    where the walk is still inside the shortest item of the class.
    """

    shortest: int
    edits: int
    items: list[int] = field(default_factory=list)
    member: np.ndarray | None = None  # whether a word is in any item of the class
    walks: list = field(default_factory=list)  # (odd numbers by step, sampled steps -> tables, tables)

    def embed(self, spread: np.ndarray, at: np.ndarray, walk: tuple) -> np.ndarray:
        """Sample keys of every table for the windows of mixed words that begin at `at`."""
        odd, sampled = walk
        keys = np.zeros((TABLES, len(at)), np.uint64)
        here = at.copy()
        for step in range(len(odd)):
            word = spread[here]
            for t in sampled[step]:
                keys[t] = (keys[t] + word) * np.uint64(0x9E3779B97F4A7C15)
                keys[t] ^= keys[t] >> np.uint64(29)
            here += ((word * odd[step]) >> np.uint64(63)).view(np.int64)
        return keys


class Index:
    """Hash tables of a block of benchmark items."""

    def __init__(self, items: list[tuple], similarity: float):
        self.similarity = similarity
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            ws = words_of(text)
            if ws:
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int32))
        self.sets = [frozenset(w.tolist()) for w in self.words]
        longest = max((len(w) for w in self.words), default=0)
        self.gap = 1 + longest + allowed_edits(longest, similarity)  # keeps matches inside a text
        self.tail = np.zeros(2 * longest + 2, np.int32)  # keeps walks inside the array
        self.classes = self.build()

    def build(self) -> list[LengthClass]:
        classes: list[LengthClass] = []
        for i in sorted(range(len(self.words)), key=lambda i: len(self.words[i])):
            n = len(self.words[i])
            if not classes or n > classes[-1].shortest * 1.15:
                classes.append(LengthClass(n, 0))
            classes[-1].items.append(i)
            classes[-1].edits = allowed_edits(n, self.similarity)
        rng = np.random.default_rng(7)
        for c in classes:
            steps = max(1, int(1.8 * c.shortest))
            flat, starts = self.flat(c.items, steps)
            spread = mixed(flat)
            c.member = np.zeros(len(self.vocabulary) + 1, np.int8)
            c.member[flat] = 1
            c.member[0] = 0
            for _ in range(WALKS):
                odd = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                chosen = [sorted(rng.choice(steps, min(SAMPLES, steps), replace=False)) for _ in range(TABLES)]
                sampled = [[t for t in range(TABLES) if s in chosen[t]] for s in range(steps)]
                keys = c.embed(spread, starts, (odd, sampled))
                tables = []
                for t in range(TABLES):
                    order = np.argsort(keys[t], kind="stable")
                    tables.append((keys[t][order], np.array(c.items)[order]))
                c.walks.append(((odd, sampled), tables))
        return classes

    def flat(self, items: list[int], gap: int) -> tuple[np.ndarray, np.ndarray]:
        """The items one after another, `gap` steps apart, and where each begins."""
        pieces, starts, at = [], [], 0
        for i in items:
            starts.append(at)
            pieces += [self.words[i], np.zeros(gap, np.int32)]
            at += len(self.words[i]) + gap
        return np.concatenate(pieces), np.array(starts)

    def candidates(self, c: LengthClass, words: np.ndarray, spread: np.ndarray) -> set[tuple[int, int]]:
        """`(item, position)`: windows that share a sample key with an item.

        Only windows with enough words of the class are embedded: a match has
        at most `edits` words that are not the item's.
        """
        width, last = c.shortest, len(words) - len(self.tail)
        known = np.concatenate([np.zeros(1, np.int32), np.cumsum(c.member[words], dtype=np.int32)])
        enough = known[width : width + last] - known[:last] >= max(1, width - c.edits)
        at = np.flatnonzero(enough)
        found: set[tuple[int, int]] = set()
        if not len(at):
            return found
        for walk, tables in c.walks:
            keys = c.embed(spread, at, walk)
            for t, (table, items) in enumerate(tables):
                lo, hi = np.searchsorted(table, keys[t]), np.searchsorted(table, keys[t], side="right")
                for p in np.flatnonzero(hi > lo):
                    found.update((int(i), int(at[p])) for i in items[lo[p] : hi[p]])
        return found

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """`(item, end position, edits)` of verified matches; windows inside a match are not verified again."""
        out, spread = [], mixed(words)
        for c in self.classes:
            done: dict[int, int] = {}
            for i, p in sorted(self.candidates(c, words, spread)):
                n, limit = len(self.words[i]), allowed_edits(len(self.words[i]), self.similarity)
                if p < done.get(i, -1):
                    continue  # inside a region that has been verified
                own = self.sets[i]
                if sum(w in own for w in words[p : p + n].tolist()) < n - 2 * limit - 1:
                    continue
                # the window may be off by some words: look around it for the best stretch
                around = limit + n // 2
                begin = max(0, p - around)
                edits, stop = edit_distance(self.words[i], words[begin : p + n + around])
                if edits <= limit:
                    out.append((i, begin + stop, edits))
                    done[i] = begin + stop
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple]]:
        """`(item_id, edits, words)` for every text."""
        found: list[dict] = [{} for _ in texts]
        get = self.vocabulary.get
        pending, spans, size = [], [], 0

        def flush() -> None:
            nonlocal pending, spans, size
            if not pending:
                return
            ends = np.array([s[1] for s in spans])
            for i, stop, edits in self.matches(np.concatenate([*pending, self.tail])):
                row = spans[int(np.searchsorted(ends, stop))][2]
                key = (self.ids[i], len(self.words[i]))
                found[row][key] = min(edits, found[row].get(key, edits))
            pending, spans, size = [], [], 0

        for row, text in enumerate(texts):
            ids = np.array([get(w, 0) for w in words_of(text)], np.int32)
            if not ids.any():
                continue
            pending += [ids, np.zeros(self.gap, np.int32)]
            spans.append((size, size + len(ids), row))
            size += len(ids) + self.gap
            if size > CHUNK:
                flush()
        flush()
        return [[(item, edits, n) for (item, n), edits in f.items()] for f in found]


def item_blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks of about `BLOCK_CHARS` and the blocks, each collected when it is asked for."""
    rows = benchmark.select("item_id", "text").filter(F.length(F.coalesce("text", F.lit(""))) > 0).distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)

    def collected() -> Iterator[list[tuple]]:
        for k in range(blocks):
            block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
            yield sorted(((r.item_id, r.text) for r in block.collect()), key=repr)

    return blocks, collected()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """`(doc_id, item_id, edits, item_words, similarity)` for each item found in each document row.

    An item is found where some stretch of the whole text is within
    `(1 - similarity) * words` word edits of it; `edits` is the best stretch's
    number. Items of a few words must be there unchanged. Null and empty texts
    hold and match nothing; equal item rows count once; ids pass through,
    nulls included; document rows that repeat give their own rows; extra
    columns are ignored; empty tables give an empty table. The documents are
    read once for each block of the benchmark and nothing is shuffled. Of
    several blocks each is searched, and its pairs are written, before the
    next one is collected.
    """
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, edits int, item_words int, similarity double"

    def found_by(items: list[tuple]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, similarity)
            for b in batches:
                hits = [(row, *hit) for row, f in enumerate(index.scan(b.column("text").to_pylist())) for hit in f]
                rows, ids, edits, words = zip(*hits) if hits else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(ids, kind_of[item_kind]),
                        pa.array(edits, pa.int32()),
                        pa.array(words, pa.int32()),
                        pa.array([1 - e / n for e, n in zip(edits, words)], pa.float64()),
                    ],
                    ["doc_id", "item_id", "edits", "item_words", "similarity"],
                )

        return work

    kind_of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out = docs.sparkSession.createDataFrame([], schema)
    n, blocks = item_blocks(benchmark)
    for items in blocks:
        found = docs.select("doc_id", "text").mapInArrow(found_by(items), schema)
        out = out.union(found if n == 1 else keep(found, "decontaminate"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns kept, whose text holds no benchmark item.

    One block filters the rows in place. Of several, each writes the digests
    of the texts that it finds before the next one is collected.
    """

    def having(items: list[tuple], clean: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, similarity)
            for b in batches:
                yield b.filter(pa.array([bool(f) != clean for f in index.scan(b.column("text").to_pylist())], pa.bool_()))

        return work

    n, blocks = item_blocks(benchmark)
    if n <= 1:
        for items in blocks:
            docs = docs.mapInArrow(having(items, True), docs.schema)
        return docs
    row = digest(F.coalesce("text", F.lit("")))
    texts, found = docs.select("text"), None
    for items in blocks:
        held = keep(texts.mapInArrow(having(items, False), "text string").select(row.alias("_row")).distinct(), "decontaminate")
        found = held if found is None else found.union(held)
    return docs.withColumn("_row", row).join(found.distinct(), "_row", "left_anti").select(*docs.columns)
