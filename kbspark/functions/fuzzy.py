"""Token-sort ratio (M3): tokenising and sorting stay in JVM expressions; only
the LCS length of a surviving pair runs in an Arrow-batched Python UDF.

Spec (library behaviour of the reference's fuzzy matcher, from its public
documentation): drop code points 128-255, every non-word character becomes a
space, lower-case, strip, split on whitespace, sort tokens by code point, join
with one space.  Equal strings score 100; one empty side scores 0; otherwise
``round_half_even(100 * (2*LCS / (len1 + len2)))``.

The LCS runs over all pairs of an Arrow batch at once: bit vectors of 64-bit
words, one row per pair, a step per character of the shorter strings.  A pair
leaves as soon as the rest of its string cannot lift it to the threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_sort_key(c) -> Column:
    """The processed, token-sorted form of a string."""
    t = F.regexp_replace(_col(c), r"[\x{80}-\x{FF}]", "")
    t = F.trim(F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_]", " ")))
    toks = F.array_remove(F.split(t, " +"), "")
    return F.array_join(F.array_sort(toks), " ")


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel LCS length (one machine word per 64 characters of the
    longer string, Python integers hold the bit vector)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio_py(a: str | None, b: str | None) -> int | None:
    """Exact token-sort ratio of two already processed-and-sorted strings."""
    if a is None or b is None:
        return None
    if a == b:
        return 100
    if not a or not b:
        return 0
    lensum = len(a) + len(b)
    return int(round(100 * ((2 * lcs_length(a, b)) / lensum)))


def _bag_bound(a: str, b: str) -> int:
    counts: dict[str, int] = {}
    for ch in a:
        counts[ch] = counts.get(ch, 0) + 1
    total = 0
    for ch in b:
        n = counts.get(ch, 0)
        if n:
            counts[ch] = n - 1
            total += 1
    return total


def ratio_at_least_py(a, b, threshold: int):
    """Exact ratio, or None when a character-count bound already proves the
    pair is below ``threshold``."""
    if a is None or b is None:
        return None
    if a != b and a and b:
        lensum = len(a) + len(b)
        if 400 * _bag_bound(a, b) < (2 * threshold - 1) * lensum:
            return None
    return ratio_py(a, b)


# Bytes of the match masks of one group of pairs, and steps between two looks
# at which pairs can still pass.
MASK_BYTES = 1 << 25
LOOK = 16


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the texts' lengths."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), lengths


def _table(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row per text, padded with 0."""
    out = np.zeros((len(lengths), int(lengths.max())), dtype=np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = codes
    return out


def _group_lcs(a: list[str], b: list[str], least: np.ndarray) -> np.ndarray:
    """LCS length of each pair, or -1 as soon as it cannot reach ``least``;
    the strings of ``a`` are not shorter than those of ``b``, and ``b`` comes
    longest first."""
    pa, la = _points(a)
    pb, lb = _points(b)
    used = np.zeros(int(max(pa.max(), pb.max())) + 1, dtype=bool)
    used[pa] = used[pb] = True
    code = np.cumsum(used, dtype=np.int32)  # 0 is the padding's code
    width = int(code[-1]) + 1
    ta, tb = _table(code[pa], la), _table(code[pb], lb)
    n, words = len(a), -(-int(la.max()) // 64)
    rows = np.arange(n) * width
    masks = [np.zeros(n * width, dtype=np.uint64) for _ in range(words)]
    for p in range(ta.shape[1]):
        masks[p >> 6][rows + ta[:, p]] |= np.uint64(1 << (p & 63))
    # word by word, so that each word is one contiguous array; bits past a's end never match and stay set
    vector = [np.full(n, ~np.uint64(0)) for _ in range(words)]
    out = np.full(n, -1, dtype=np.int64)
    live = np.arange(n)

    def reached() -> np.ndarray:
        return 64 * words - sum(np.bitwise_count(v).astype(np.int64) for v in vector)

    for t in range(tb.shape[1] + 1):
        ended = np.searchsorted(-lb[live], -t, side="left")  # pairs from here on have no character t
        if ended < len(live):
            out[live[ended:]] = reached()[ended:]
            live = live[:ended]
            vector = [v[:ended] for v in vector]
        if not len(live):
            break
        if t % LOOK == LOOK - 1:
            able = reached() + (lb[live] - t) >= least[live]
            if not able.all():
                live = live[able]
                vector = [v[able] for v in vector]
                if not len(live):
                    break
        at = rows[live] + tb[live, t]
        carry = np.zeros(len(live), dtype=np.uint64)
        for w, v in enumerate(vector):
            u = v & masks[w].take(at)
            total = v + u
            over = total < v
            total += carry
            over |= total < carry
            vector[w] = total | (v - u)
            carry = over.astype(np.uint64)
    out[out < least] = -1
    return out


def lcs_lengths(a: list[str], b: list[str], least: np.ndarray) -> np.ndarray:
    """LCS length of each pair of strings, or -1 where it is below ``least``.

    Pairs of like lengths go together.  A group with few pairs for the length
    of its strings is counted pair by pair, which is faster there."""
    long = [x if len(x) >= len(y) else y for x, y in zip(a, b)]
    short = [y if len(x) >= len(y) else x for x, y in zip(a, b)]
    out = np.zeros(len(a), dtype=np.int64)
    size = np.fromiter(map(len, long), dtype=np.int64, count=len(long))
    rest = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
    words = -(-size // 64)
    for w in np.unique(words[rest > 0]).tolist():
        group = np.flatnonzero((words == w) & (rest > 0))
        group = group[np.argsort(-rest[group], kind="stable")]
        at = 0
        while at < len(group):
            part = group[at:at + max(1, MASK_BYTES // (8 * w * 64))]
            while len(part) > 1 and (1 + len(set("".join([long[i] + short[i] for i in part])))) * len(part) * 8 * w > MASK_BYTES:
                part = part[:len(part) // 2]
            at += len(part)
            if len(part) < 24 + 16 * w:
                found = np.array([lcs_length(long[i], short[i]) for i in part], dtype=np.int64)
                out[part] = np.where(found >= least[part], found, -1)
            else:
                out[part] = _group_lcs([long[i] for i in part], [short[i] for i in part], least[part])
    out[(rest == 0) & (least > 0)] = -1
    return out


def ratios(a: list, b: list, threshold: int | None = None) -> list:
    """Exact token-sort ratio of each pair of processed strings, ``None`` for a
    null side and, with a threshold, for pairs below it."""
    out: list = [None if x is None or y is None else 100 if x == y else 0 if not x or not y else -1 for x, y in zip(a, b)]
    at = [i for i, r in enumerate(out) if r == -1]
    if at:
        x, y = [a[i] for i in at], [b[i] for i in at]
        total = np.fromiter((len(p) + len(q) for p, q in zip(x, y)), dtype=np.int64, count=len(at))
        # round_half_even(200 * lcs / total) >= t needs 400 * lcs >= (2 t - 1) * total
        least = np.zeros(len(at), dtype=np.int64) if threshold is None else -(-(2 * threshold - 1) * total // 400)
        for i, lcs, n in zip(at, lcs_lengths(x, y, least).tolist(), total.tolist()):
            out[i] = None if lcs < 0 else int(round(100 * ((2 * lcs) / n)))
    return out if threshold is None else [r if r is not None and r >= threshold else None for r in out]


@F.pandas_udf(T.IntegerType())
def token_sort_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.tolist(), b.tolist()), dtype="Int32")


def ratio_at_least_udf(threshold: int):
    @F.pandas_udf(T.IntegerType())
    def _udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratios(a.tolist(), b.tolist(), threshold), dtype="Int32")
    # the function is deterministic; the flag only stops the optimizer from
    # copying the call into the filter on its result (two Python passes)
    return _udf.asNondeterministic()


def token_sort_ratio(a, b) -> Column:
    """M3 on raw strings: both sides processed and token-sorted in the JVM."""
    return token_sort_ratio_udf(token_sort_key(a), token_sort_key(b))
