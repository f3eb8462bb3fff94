"""Sets of word shingles as 64-bit hashes, computed on whole Arrow buffers.

Words are runs of bytes outside ASCII white space, A-Z lower-cased. A word's hash is a polynomial over a
random value per byte, taken from prefix sums of the whole buffer, then mixed; a shingle's hash mixes
its words' hashes. A text with fewer words than a shingle has one shingle, the whole sequence; a text
without words has none.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_random = np.random.Generator(np.random.PCG64(7))
_odd = lambda n: _random.integers(0, 1 << 63, n, U) * U(2) + U(1)
BYTE = _random.integers(0, 1 << 64, 256, U, endpoint=False)
BYTE[65:91] = BYTE[97:123]
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
BASE = int(_odd(1)[0])
PLACE = _odd(16)
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(29))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[i] = np.concatenate(([U(1)], np.cumprod(np.full(n - 1, base, U))))
    return _powers


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts data[offs[i]:offs[i + 1]], and its text."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    left, right = np.ones(len(data), bool), np.ones(len(data), bool)
    left[1:] = ~word[:-1] | edge[1:-1]
    right[:-1] = left[1:] | ~word[1:]
    starts, ends = np.flatnonzero(word & left), np.flatnonzero(word & right) + 1
    up, down = _up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * up[:len(data)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts])
    return h, np.searchsorted(offs, starts, "right") - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``k`` words."""
    h, doc = word_hashes(data, offs)
    n = len(offs) - 1
    count = np.bincount(doc, minlength=n)
    m = max(0, len(h) - k + 1)
    full = np.zeros(m, U)
    for j in range(k):
        full += h[j:j + m] * PLACE[j]
    own = doc[:m] == doc[k - 1:] if m else np.zeros(0, bool)
    full, of = mix(full[own]), doc[:m][own]
    at = np.searchsorted(of, np.arange(n + 1))
    first = np.cumsum(count) - count
    few = {}
    for i in np.flatnonzero((count > 0) & (count < k)):
        c, f = int(count[i]), int(first[i])
        few[i] = mix((h[f:f + c] * PLACE[:c]).sum(dtype=U, keepdims=True) + PLACE[15:] * U(c))
    return [few[i] if i in few else np.unique(full[at[i]:at[i + 1]]) for i in range(n)]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return int((b[i] == a).sum())
