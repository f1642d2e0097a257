"""Words of a batch of texts as numpy arrays: positions and 64-bit hashes.

Used inside tasks on one Arrow batch at a time.  Texts are joined into one
array of code points; a word's hash is a difference of polynomial prefix sums
(mod 2**64), so a batch costs a few passes over its characters and no Python
loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
U64 = np.uint64

_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer (splitmix64 finaliser) over uint64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


KEPT_POWERS = 1 << 19


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    """The first n powers; a table for usual batches is kept, a longer one is
    made for the call and goes with it."""
    if n > KEPT_POWERS:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)
    if name not in _tables:
        steps = np.full(KEPT_POWERS, base, dtype=np.uint64)
        steps[0] = 1
        _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables[name][:n]


def code_point_table(name: str, fn, dtype) -> np.ndarray:
    """fn of every code point (surrogates included, as they may be looked up)."""
    if name not in _tables:
        _tables[name] = np.array([fn(chr(c)) for c in range(0x110000)], dtype=dtype)
    return _tables[name]


def lower_table() -> np.ndarray:
    return code_point_table("lower", lambda c: ord(x) if len(x := c.lower()) == 1 else ord(c),
                            np.uint32)


def letter_table() -> np.ndarray:
    return code_point_table("letter", lambda c: c.isalnum(), bool)


def space_table() -> np.ndarray:
    """White space of ASCII: space, tab, new line, vertical tab, form feed, return."""
    return code_point_table("space", lambda c: c in " \t\n\x0b\x0c\r", bool)


@dataclass
class Words:
    chars: np.ndarray       # code points of all texts, each text followed by a new line
    offsets: np.ndarray     # start of each text in chars; one more at the end
    start: np.ndarray       # first code point of each word, in chars
    end: np.ndarray         # one past the last
    hash: np.ndarray        # uint64
    first: np.ndarray       # index of the first word of each text; one more at the end
    sums: np.ndarray        # prefix sums behind the hashes

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than n characters, and hashes of their first n (never
        the hash of a word)."""
        which = np.flatnonzero(self.end - self.start > n)
        s = self.start[which]
        h = (self.sums[s + n] - self.sums[s]) * powers(len(self.chars), BASE_INV, "inv")[s]
        return which, mix(h ^ U64(n))


def chunks(texts: list[str], max_chars: int = 400_000):
    """Runs (lo, hi) of texts with at most max_chars characters (or one text)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\n".join(texts) + "\n"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return chars, offsets


def words_of(texts: list[str], letters_only: bool = False) -> Words:
    """Words of the texts, lower-cased for the hash: runs of anything but ASCII
    white space or, with ``letters_only``, runs of letters and digits."""
    chars, offsets = code_points(texts)
    inside = letter_table()[chars] if letters_only else ~space_table()[chars]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(chars)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((lower_table()[chars].astype(np.uint64) + U64(1)) * powers(n, BASE, "pow"),
              out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(n, BASE_INV, "inv")[start]
    first = np.searchsorted(start, offsets)
    return Words(chars, offsets, start, end, mix(h), first, prefix)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, text by text, and the index of the first
    of each text.  A text of 1 to n-1 words has one shingle: all its words."""
    w, count = words.hash, np.diff(words.first)
    many = np.maximum(count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(first[-1], dtype=np.uint64)
    at = np.repeat(words.first[:-1] - first[:-1], many) + np.arange(first[-1])
    length = np.repeat(np.minimum(count, n), many)
    for j in range(n):
        use = length > j
        out[use] = out[use] * BASE + w[at[use] + j]
    return mix(out + length.astype(np.uint64)), first
