"""Seeded draws with replacement, many digests at once in numpy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

# MD5 as in RFC 1321: sine table, shifts and the word that a round reads
_SINES = [int(abs(math.sin(r + 1)) * 2**32) for r in range(64)]
_SINE_WORDS = [np.array(x, np.uint32) for x in _SINES]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_LEFT, _RIGHT = [np.array(s, np.uint32) for s in _SHIFTS], [np.array(32 - s, np.uint32) for s in _SHIFTS]
_WORDS = [((1, 5, 3, 7)[r // 16] * r + (0, 1, 5, 0)[r // 16]) % 16 for r in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

# digests worked out at once; some ten arrays of this many words stay in a core's cache
CHUNK = 32768


def _heads(words: Sequence[int | np.ndarray], size: int) -> np.ndarray:
    """First four bytes, as a big-endian number, of the MD5 digests of `size` one-block messages of 16 words each."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for r in range(61):  # the last three rounds do not change the first word
        if r < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif r < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif r < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[_WORDS[r]]
        np.add(f, a, out=f)
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            np.add(f, _SINE_WORDS[r], out=f)
        else:
            np.add(f, np.uint32((word + _SINES[r]) & 0xFFFFFFFF) if word else _SINE_WORDS[r], out=f)
        np.left_shift(f, _LEFT[r], out=t)
        np.right_shift(f, _RIGHT[r], out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    np.add(b, np.uint32(_START[0]), out=f)
    return f.byteswap()


def _placed(texts: list[bytes], at: int) -> np.ndarray:
    """16 words for each text, which begins at byte `at` of its block; the texts run along the second axis."""
    block = np.zeros((len(texts), 64), np.uint8)
    for row, text in zip(block, texts):
        row[at : at + len(text)] = np.frombuffer(text, np.uint8)
    return np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))


@lru_cache(maxsize=512)
def _fronts(n: int, at: int, draws: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Words of `n:draw:` for draws from 1, and `(first, last, byte after it)` of the draws of one length."""
    texts = [b"%d:%d:" % (n, draw) for draw in range(1, draws + 1)]
    ends = [0, *[i for i in range(1, draws) if len(texts[i]) != len(texts[i - 1])], draws]
    return _placed(texts, at), [(i, j, at + len(texts[i])) for i, j in zip(ends, ends[1:])]


def _tails(n: int, at: int) -> np.ndarray:
    """Words of i = 1 to n from byte `at`, closed and with the length of the message as MD5 wants it."""
    return _short_tails(n, at) if n <= 256 else _long_tails(n, at)


def _new_tails(n: int, at: int) -> np.ndarray:
    texts = [b"%d\x80" % i for i in range(1, n + 1)]
    words = _placed(texts, at)
    words[14] |= np.array([8 * (at + len(t) - 1) for t in texts], np.uint32)
    return words


# 16 KB each at most, and some MB each for the largest groups
_short_tails, _long_tails = lru_cache(maxsize=1024)(_new_tails), lru_cache(maxsize=12)(_new_tails)


def _batches(ns: Sequence[int], draws: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of `(n, first, last)` of some `CHUNK` draws together, at least one draw each."""
    held: list[tuple[int, int, int]] = []
    for n in ns:
        step = max(1, CHUNK // n)
        for first in range(0, draws, step):
            last = min(first + step, draws)
            if held and sum(m * (j - i) for m, i, j in held) + n * (last - first) > CHUNK:
                yield held
                held = []
            held.append((n, first, last))
    yield held


def seeded_draws(prefix: str, ns: Sequence[int], draws: int, total: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """`(n, first draw, indices below total)` by i and draw, for `draws` draws of each n.

    The index is the number of the first eight hex digits of md5(`prefix:n:draw:i`) modulo `total`; draw and i count from 1.
    """
    head = prefix.encode() + b":"
    at = len(head)
    longest = len(b"%d:%d:%d" % (max(ns), draws, max(ns)))
    lo, hi = at // 4, (at + longest) // 4 + 1  # words that hold what differs
    if at + longest > 55:  # more than one block
        base = hashlib.md5(head)
        for n, first, last in (part for batch in _batches(ns, draws) for part in batch):
            out = np.empty((n, last - first), np.int64)
            for i, draw in np.ndindex(out.shape):
                one = base.copy()
                one.update(b"%d:%d:%d" % (n, first + draw + 1, i + 1))
                out[i, draw] = int.from_bytes(one.digest()[:4], "big")
            yield n, first, out % total
        return
    fixed = [int(w) for w in _placed([head], 0)[:, 0]]
    for batch in _batches(ns, draws):
        size = sum(n * (last - first) for n, first, last in batch)
        words: list[int | np.ndarray] = [np.empty(size, np.uint32) if lo <= w < hi or w == 14 else fixed[w] for w in range(16)]
        start = 0
        for n, first, last in batch:
            fronts, lengths = _fronts(n, at, draws)
            for i, j, end in lengths:
                i, j = max(i, first), min(j, last)
                if i >= j:
                    continue
                tails = _tails(n, end)
                for w in (*range(lo, min(hi, 14)), 14):
                    cells = words[w][start : start + n * (last - first)].reshape(n, last - first)
                    np.bitwise_or(fronts[w, i:j], tails[w][:, None], out=cells[:, i - first : j - first])
            start += n * (last - first)
        if fixed[lo]:
            np.bitwise_or(words[lo], np.uint32(fixed[lo]), out=words[lo])
        picked = _heads(words, size)
        picked -= picked // np.uint32(total) * np.uint32(total)
        start = 0
        for n, first, last in batch:
            yield n, first, picked[start : start + n * (last - first)].reshape(n, last - first)
            start += n * (last - first)
