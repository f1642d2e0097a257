"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling (polynomial) hash; of every
window of ``w`` consecutive hashes the smallest is chosen, the rightmost of
equal ones, and its position is kept.  Any passage of at least ``w + k - 1``
code points that two texts share leaves a common fingerprint in both, and
neighbouring positions are at most ``w`` apart.

A fingerprint is a string of 10 hex digits per chosen hash: 8 of the hash, 2
of the distance to the position before (the first: its position), so
``w <= 255``.  Equal texts have equal fingerprints.

Likeness: the share of chosen hashes in common, twice the common ones over the
sum of both numbers (Dice).

Defined results: a null text counts as empty, its fingerprint is the empty
string; a text shorter than ``k`` has one hash, of the whole text; a text with
fewer than ``w`` hashes is one window.  Two empty fingerprints have likeness
1, an empty and another one 0.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.words import BASE, BASE_INV, U64, chunks, code_points, mix, powers

K, W = 10, 20


def _choose(texts: list[str], k: int, w: int):
    """Chosen 32-bit hashes and their positions, text by text."""
    chars, offsets = code_points(texts)
    total = len(chars)
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum((chars.astype(np.uint64) + U64(1)) * powers(total, BASE, "pow"), out=sums[1:])
    length = np.diff(offsets) - 1
    many = np.where(length >= k, length - k + 1, np.minimum(length, 1))
    at = np.arange(max(total - k + 1, 0))
    key = mix((sums[k:] - sums[:-k]) * powers(total, BASE_INV, "inv")[:len(at)]) >> U64(32) \
        if total >= k else np.zeros(0, np.uint64)
    # smallest hash, then largest position: one number per position
    key = (key << U64(32)) | (U64(0xFFFFFFFF) - at.astype(np.uint64))
    least, span = key, 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:]) if len(least) > span else least[:0]
        span *= 2
    if span < w:
        least = np.minimum(least[:span - w], least[w - span:]) if len(least) > w - span else least[:0]
    for i, n in enumerate(many):
        s = offsets[i]
        if n == 0:
            yield np.zeros(0, np.uint32), np.zeros(0, np.int64)
            continue
        if length[i] < k:
            h = (sums[s + length[i]] - sums[s]) * powers(total, BASE_INV, "inv")[s]
            yield (mix(np.array([h])) >> U64(32)).astype(np.uint32), np.zeros(1, np.int64)
            continue
        got = least[s:s + n - w + 1] if n >= w else key[s:s + n].min(keepdims=True)
        got = got[np.flatnonzero(np.diff(got, prepend=~got[:1]))]
        yield ((got >> U64(32)).astype(np.uint32),
               (U64(0xFFFFFFFF) - (got & U64(0xFFFFFFFF))).astype(np.int64) - s)


def winnow(texts: list[str], k: int = K, w: int = W):
    """(hashes, positions) of each text, in order of position."""
    for lo, hi in chunks(texts):
        yield from _choose(texts[lo:hi], k, w)


def spell(hashes: np.ndarray, positions: np.ndarray) -> str:
    out = np.zeros((len(hashes), 5), dtype=np.uint8)
    out[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(positions, prepend=0)
    return out.tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a fingerprint string."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8).reshape(-1, 5)
    return (rows[:, :4].copy().view(">u4").ravel().astype(np.uint32),
            np.cumsum(rows[:, 4].astype(np.int64)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice similarity of two sets of hashes (sorted, distinct)."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 2 * common / len(both)
