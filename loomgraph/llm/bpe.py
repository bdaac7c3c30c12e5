"""Byte-level BPE: pre-tokens found by scanning transition functions, merges cached by pre-token.

The pre-token pattern is fixed: contractions, then letters, digits or other signs with at most one space in
front, then white space, of which the last one before something else stands alone or goes with it. It is a
finite automaton whose input at a position is the class of the code point, sharpened by the classes of the next
two. Each input is a function on the states; the functions that inputs can compose to are few, so each has a
number and composition is one table lookup. Composition is associative: numpy scans it over whole batches of
texts at once, block by block, and the state before a position says whether a pre-token starts there.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import unused

# inputs of the automaton
LETTER, DIGIT, SIGN, SHORT, LONG, SPACES, BLANK, BREAK = range(8)
# its states: nothing open, in letters, in digits, in signs, a space that goes with what follows, in white space,
# one and two letters of a contraction still to come
NEW, LETTERS, DIGITS, SIGNS, JOINED, WHITE, ONE, TWO = range(8)

# classes of code points; the letters of contractions have their own
PLAIN, NUMBER, OTHER, APOSTROPHE, SPACE, WIDE, STMD, RV, E, L, END = range(11)
CONTRACTIONS = {"s": STMD, "t": STMD, "m": STMD, "d": STMD, "r": RV, "v": RV, "e": E, "l": L}
# code points with the property White_Space, fixed values
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

CHUNK = 1 << 20  # code points scanned at once
BATCH = 1 << 19  # code points of one batch of texts; a longer text is a batch of its own
SHORT_PIECE, NO_RANK = 100, 1 << 40
CACHED = 1 << 22  # code points of cached pre-tokens, beyond which a worker forgets them


def step(state: int, given: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token starts at this input."""
    if given in (LETTER, DIGIT, SIGN):
        if given == LETTER and state in (ONE, TWO):
            return (NEW if state == ONE else ONE), False
        into = {LETTER: LETTERS, DIGIT: DIGITS, SIGN: SIGNS}[given]
        return into, state not in (into, JOINED)
    if given in (SHORT, LONG):
        if state in (SIGNS, JOINED):
            return SIGNS, False
        return (ONE if given == SHORT else TWO), True
    if given == SPACES:
        return WHITE, state != WHITE
    return (JOINED if given == BLANK else WHITE), True


class Functions:
    """All compositions of input functions, numbered; `table[f, g]` is f, then g. Inputs are 0-7, after a reset 8-15."""

    def __init__(self):
        basic = [tuple(step(s, g)[0] for s in range(8)) for g in range(8)]
        basic += [(f[NEW],) * 8 for f in basic]
        found = {tuple(range(8)): 0}
        for f in basic:
            found.setdefault(f, len(found))
        todo = list(found)
        for f in todo:
            for g in basic:
                both = tuple(g[s] for s in f)
                if both not in found:
                    found[both] = len(found)
                    todo.append(both)
        self.n = len(found)
        self.of_input = np.array([found[f] for f in basic], np.uint16)
        self.values = np.array(list(found), np.uint8)
        self.table = np.array([[found[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16).ravel()
        self.starts = np.array([[step(s, g)[1] for g in range(8)] for s in range(8)]).ravel()

    def compose(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return self.table[first * np.int32(self.n) + then]

    def scan(self, functions: np.ndarray, width: int = 32) -> np.ndarray:
        """Inclusive prefix compositions: inside blocks for all blocks at once, then over the blocks."""
        n = len(functions)
        if n <= width:
            out = functions.copy()
            for i in range(1, n):
                out[i] = self.table[int(out[i - 1]) * self.n + int(out[i])]
            return out
        rows = -(-n // width)
        grid = np.zeros((rows, width), np.uint16)
        grid.ravel()[:n] = functions
        grid = np.ascontiguousarray(grid.T)
        for i in range(1, width):
            grid[i] = self.compose(grid[i - 1], grid[i])
        before = np.zeros(rows, np.uint16)
        before[1:] = self.scan(grid[-1])[:-1]
        return self.compose(before[None, :], grid).T.ravel()[:n]


@lru_cache(1)
def functions() -> Functions:
    return Functions()


@lru_cache(1)
def code_point_classes() -> bytes:
    """Class of every code point, compressed to some kilobytes. Letters and numbers are those of the tokenizer
    library's own Unicode tables; the driver asks it once, a range of code points at a time."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for name, kind in ((r"\p{L}", PLAIN), (r"\p{N}", NUMBER)):
        told = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
        for start in range(0, 0x110000, 0x800):
            if 0xD800 <= start < 0xE000:
                continue
            members = bytes(told.encode_ordinary("".join(map(chr, range(start, start + 0x800))))).decode()
            out[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    out[WHITE_SPACE] = WIDE
    out[32] = SPACE
    out[ord("'")] = APOSTROPHE
    for letter, kind in CONTRACTIONS.items():
        out[ord(letter)] = kind
    return zlib.compress(out.tobytes())


@lru_cache(1)
def class_table(compressed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(compressed), np.uint8)


def inputs_of(classes: np.ndarray, n: int, first: np.ndarray) -> np.ndarray:
    """Automaton inputs of the first `n` classes, of which two more may follow; `first` marks starts of texts."""
    pad = np.full(n + 2, END, np.uint8)
    pad[: len(classes)] = classes[: n + 2]
    starts = np.zeros(n + 2, bool)
    starts[: len(first)] = first[: n + 2]
    here, one, two = pad[:n], pad[1 : n + 1].copy(), pad[2:].copy()
    # what lies in the next text is the end of this one
    ends_one = starts[1 : n + 1]
    one[ends_one] = END
    two[ends_one | starts[2:]] = END
    out = np.array([LETTER, DIGIT, SIGN, SIGN, SPACES, SPACES, LETTER, LETTER, LETTER, LETTER, SIGN], np.uint8)[here]
    mark = here == APOSTROPHE
    out[mark & (one == STMD)] = SHORT
    out[mark & (((one == RV) & (two == E)) | ((one == L) & (two == L)))] = LONG
    white_next = (one == SPACE) | (one == WIDE) | (one == END)
    out[(here == SPACE) & ~white_next] = BLANK
    out[(here == WIDE) & ~white_next] = BREAK
    return out


def pre_token_starts(text: str, text_starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions in `text` at which pre-tokens start; `text` joins several texts, each starting anew."""
    tables = functions()
    found, state = [], NEW
    for at in range(0, len(text), CHUNK):
        part = np.frombuffer(text[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        n = min(CHUNK, len(text) - at)
        first = np.zeros(len(part), bool)
        inside = text_starts[np.searchsorted(text_starts, at) : np.searchsorted(text_starts, at + len(part))] - at
        first[inside] = True
        given = inputs_of(classes[part], n, first)
        prefix = tables.scan(tables.of_input[given + 8 * first[:n].astype(np.uint8)])
        after = tables.values[prefix, state]
        before = np.empty(n, np.uint8)
        before[0], before[1:] = state, after[:-1]
        before[first[:n]] = NEW
        found.append(np.flatnonzero(tables.starts[before * np.uint8(8) + given] | first[:n]) + at)
        state = int(after[-1])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank, leftmost first, merges until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return merge_long(piece, ranks) if len(piece) > SHORT_PIECE else merge_short(piece, ranks)


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < NO_RANK:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
    return [ranks[part] for part in parts]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, n log n for a run of any length."""
    n = len(piece)
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            prior[after[i]] = i
            r = ranks.get(piece[i : end[after[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if prior[i] >= 0:
            r = ranks.get(piece[prior[i] : stop])
            if r is not None:
                heapq.heappush(heap, (r, prior[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class PieceIds(dict):
    """Pre-token to its number; `ids[bounds[k]:bounds[k + 1]]` are the ids of number k."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.bounds, self.held = array("i"), array("q", [0]), 0

    def __missing__(self, piece: str) -> int:
        self.ids.extend(merge(piece.encode("utf-8", "surrogatepass"), self.ranks))
        self.bounds.append(len(self.ids))
        self.held += len(piece)
        self[piece] = len(self.bounds) - 2
        return self[piece]

    def of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and the number of ids of each piece."""
        if self.held > CACHED:
            self.forget()
        which = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        ids, bounds = np.array(self.ids, np.int32), np.array(self.bounds, np.int64)
        counts = (bounds[1:] - bounds[:-1])[which]
        ends = np.cumsum(counts)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        return ids[np.repeat(bounds[which], counts) + within], counts


class Vocabulary:
    """Ranks of a public vocabulary and the classes of code points, read once on the driver; half a megabyte that
    travels with the tasks. Each worker unpacks them once."""

    def __init__(self, path: str):
        self.raw, self.classes = Path(path).read_bytes(), code_point_classes()


@lru_cache(4)
def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


@lru_cache(4)
def tokens_of(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    ranks = ranks_of(raw)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return by_id, np.array([len(t) for t in by_id], np.int64)


@lru_cache(4)
def pieces_of(raw: bytes) -> PieceIds:
    return PieceIds(ranks_of(raw))


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and where each text's ids start, with the end as the last entry."""
    lengths = np.array([len(t) for t in texts], np.int64)
    text_starts = np.concatenate([[0], np.cumsum(lengths)])
    joined = "".join(texts)
    starts = pre_token_starts(joined, np.unique(text_starts[:-1][lengths > 0]), class_table(vocabulary.classes))
    edges = [*starts.tolist(), len(joined)]
    ids, counts = pieces_of(vocabulary.raw).of([joined[a:b] for a, b in zip(edges, edges[1:])])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return ids, bounds[np.searchsorted(starts, text_starts)]


def batches_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, text in enumerate(texts):
        if i > at and held + len(text) > BATCH:
            yield at, i
            at, held = i, 0
        held += len(text)
    if texts:
        yield at, len(texts)


def encode_batches(batches: Iterable[pa.RecordBatch], model: Vocabulary, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches with ids and offsets of column `at`, in parts of bounded text."""
    _, lengths = tokens_of(model.raw)
    for batch in batches:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        for a, b in batches_of(texts):
            values, bounds = encode_texts(texts[a:b], model)
            ends = np.concatenate([[0], np.cumsum(lengths[values])])
            places = ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds))
            bounds = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(v, pa.int32())) for v in (values, places)]
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, *lists], names=[*part.schema.names, *names])


def decode_batches(batches: Iterable[pa.RecordBatch], raw: bytes, at: int, place: int, name: str) -> Iterator[pa.RecordBatch]:
    """Batches with the bytes of the ids in column `at`, whose offsets are in column `place`."""
    tokens, lengths = tokens_of(raw)
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            row, told = batch.column(at)[i].values, batch.column(place)[i].values
            given = row.to_numpy() if row is not None else np.empty(0, np.int32)
            starts = told.to_numpy() if told is not None else np.empty(0, np.int32)
            sizes = lengths[given]
            if len(starts) != len(given) or not np.array_equal(starts, np.cumsum(sizes) - sizes):
                raise ValueError("offsets do not fit the ids")
            out.append(b"".join(map(tokens.__getitem__, given.tolist())))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, name])


def with_fields(df: DataFrame, **kinds: T.DataType) -> T.StructType:
    unused(df, *kinds)
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in kinds.items())])


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", offsets: str = "offsets") -> DataFrame:
    """`docs` with the token `ids` of each text and the byte `offsets` at which they start in its UTF-8 form.

    A null or empty text has no ids. Special tokens are ordinary text. All columns and rows stay; `ids` and `offsets`
    must be new names. One pass without a shuffle: memory follows a part of half a million code points or the longest text.
    """
    model, at = Vocabulary(vocabulary), docs.columns.index(text)
    schema = with_fields(docs, **{ids: T.ArrayType(T.IntegerType()), offsets: T.ArrayType(T.IntegerType())})
    return docs.mapInArrow(lambda batches: encode_batches(batches, model, at, [ids, offsets]), schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", offsets: str = "offsets", decoded: str = "decoded") -> DataFrame:
    """`encoded` with the bytes that its `ids` stand for; null ids give no bytes, an id outside the vocabulary fails.

    The kept `offsets` say where each token's bytes start; they must agree with the lengths of the tokens. Spark hands over
    `spark.sql.execution.arrow.maxRecordsPerBatch` rows at a time: lower it where documents have many tokens.
    """
    raw, at, place = Vocabulary(vocabulary).raw, encoded.columns.index(ids), encoded.columns.index(offsets)
    schema = with_fields(encoded, **{decoded: T.BinaryType()})
    return encoded.mapInArrow(lambda batches: decode_batches(batches, raw, at, place, decoded), schema)


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` without the text, with its `ids`, `offsets` and the bytes `decoded` from them, in one pass: the parts of a
    batch are encoded and decoded one after the other, so no more than one of them is held."""
    model, at = Vocabulary(vocabulary), docs.columns.index(text)
    n = len(docs.columns)
    schema = with_fields(docs, ids=T.ArrayType(T.IntegerType()), offsets=T.ArrayType(T.IntegerType()), decoded=T.BinaryType())

    def run(batches):
        encoded = encode_batches(batches, model, at, ["ids", "offsets"])
        for part in decode_batches(encoded, model.raw, n, n + 1, "decoded"):
            yield part.drop_columns([text])

    return docs.mapInArrow(run, T.StructType([f for f in schema.fields if f.name != text]))
