"""Word shingles of whole texts as sorted sets of 64-bit hashes (numpy).

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A word's
hash is a polynomial over its bytes with random byte values, and a shingle's is
a random linear form of its words' hashes, mixed: two different shingles agree
with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[0x41:0x5B] += 0x20
_VALUE = _mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))[_LOWER]
_VALUE[_SPACE] = 0
_BASE = _U(0xD6E8FEB86659FD93)
_PLACE = _mixed(np.arange(1, 65, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
_powers = np.cumprod(np.full(4096, _BASE, dtype=_U))


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _BASE, dtype=_U))
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """One hash per word, in order."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    letter = ~_SPACE[raw]
    if not letter.any():
        return np.empty(0, dtype=_U)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.nonzero(first)[0]
    spans = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    return _mixed(np.add.reduceat(_VALUE[raw[starts[0]:]] * _power(int(spans.max()))[place], starts - starts[0]))


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes as signed 64-bit numbers; fewer words than
    ``size`` make one shingle of all, no words none."""
    words = word_hashes(text)
    if len(words) == 0:
        return np.empty(0, dtype=np.int64)
    k = min(size, len(words))
    n = len(words) - k + 1
    total = np.zeros(n, dtype=_U)
    for j in range(k):
        total += words[j:j + n] * _PLACE[j]
    if k < size:
        total += _U(k)
    return np.unique(_mixed(total).view(np.int64))


def min_hashes(shingles: np.ndarray, n: int) -> list[int]:
    """``n`` minimum hashes of a set (of zero for an empty one)."""
    x = shingles.view(_U)
    return [int(_mixed(x ^ _PLACE[j]).view(np.int64).min()) if len(x) else 0 for j in range(n)]
