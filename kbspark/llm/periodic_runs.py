"""Periodic runs of words: maximal stretches that repeat a period three times
or more.

Every word of such a run occurs in it at least as often as the period is
repeated.  So a word that occurs less often within the segment at hand lies in
no run there and splits it; the parts are counted anew, until nothing splits.
Most texts leave no segment.  Surviving segments are scanned lag by lag: small
lags word by word, larger ones on the grid of the lag's multiples, where a run
always holds two equal blocks side by side (found by rolling hashes, then
compared and extended word by word).  A segment of m words takes O(m log m)
block comparisons.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 24
LEAST_TIMES = 3
#: Lags up to this are scanned word by word.
SMALL_LAG = 24
#: Rows read from Arrow at a time.
SLICE = 128

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _stretches(good: np.ndarray, least: int) -> list[tuple[int, int]]:
    """``[lo, hi)`` of every maximal stretch of true values, ``least`` long or more."""
    edges = np.flatnonzero(np.diff(good.view(np.int8), prepend=0, append=0))
    lo, hi = edges[::2], edges[1::2]
    kept = hi - lo >= least
    return list(zip(lo[kept].tolist(), hi[kept].tolist()))


def split_by_frequency(codes: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int]]:
    """Segments ``[lo, hi)`` of at least ``least`` words in which every word
    occurs ``times`` times or more; all qualifying runs lie within one."""
    stable, open_ = [], [(0, len(codes))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < least:
            continue
        _, place, counts = np.unique(codes[lo:hi], return_inverse=True, return_counts=True)
        often = (counts >= times)[place]
        if often.all():
            stable.append((lo, hi))
        else:
            open_ += [(lo + a, lo + b) for a, b in _stretches(often, least)]
    return stable


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common beginning of two arrays of one length."""
    at, step = 0, 64
    while at < len(a):
        same = a[at:at + step] == b[at:at + step]
        if not same.all():
            return at + int(same.argmin())
        at, step = at + step, step * 2
    return len(a)


def scan_lags(seg: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of one segment."""
    m = len(seg)
    found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
    by_period: list[tuple[int, int, int]] = []
    small = min(SMALL_LAG, m // times)
    for q in range(1, small + 1):
        for lo, hi in _stretches(seg[q:] == seg[:-q], max(least, times * q) - q):
            # a stretch that a divisor of the lag found is that run again
            if (lo, hi + q) not in found:
                found[lo, hi + q] = q
                by_period.append((q, lo, hi + q))
    if m // times > small:
        power = np.empty(m + 1, dtype=_U)
        power[0] = 1
        np.cumprod(np.full(m, _BASE, dtype=_U), out=power[1:])
        # sums of word value times place; equal blocks agree after the shift of places
        value = (seg.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)
        value ^= value >> _U(29)
        total = np.zeros(m + 1, dtype=_U)
        np.cumsum(value * power[:m], out=total[1:])
    for q in range(small + 1, m // times + 1):
        block = np.diff(total[::q])  # of words [kq, kq + q)
        hits = np.flatnonzero(block[:-1] * power[q] == block[1:]) * q
        if not len(hits):
            continue
        # within a run of a divisor of the lag there is that run only
        for d, lo, hi in by_period:
            if q % d == 0 and hi - lo >= 2 * q:
                hits = hits[(hits < lo) | (hits + 2 * q > hi)]
        done = -1
        for at in hits.tolist():
            if at < done:
                continue
            right = at + _agreeing(seg[at:m - q], seg[at + q:])
            if right < at + q:
                continue  # hashes agree, words do not
            left = at - _agreeing(seg[:at][::-1], seg[q:at + q][::-1])
            done, end = right, right + q
            if end - left >= max(least, times * q) and (left, end) not in found:
                found[left, end] = q
                by_period.append((q, left, end))
    return [(lo, hi - lo, q) for (lo, hi), q in found.items()]


def runs_of(words: list, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all maximal runs, by start, then period:
    stretches of ``least`` words or more that repeat their smallest period at
    least ``times`` times and that no neighbouring word extends."""
    if len(words) < least:
        return []
    counts = Counter(words)
    often = np.fromiter(map(counts.__getitem__, words), dtype=np.int64, count=len(words)) >= times
    out = []
    for a, b in _stretches(often, least):
        number: dict = {}
        codes = np.array([number.setdefault(w, len(number)) for w in words[a:b]], dtype=np.int64)
        for lo, hi in split_by_frequency(codes, least, times):
            out += [(a + lo + start, length, q) for start, length, q in scan_lags(codes[lo:hi], least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """One row per row of ``df``: ``id``, ``runs`` (array of ``start, length,
    period`` in words, by start, then period) and ``collapsed``, the text's
    words without those that a run repeats, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words and
    no runs.  Texts of any length are scanned whole.  Null and repeated ids are
    read row by row; an empty table gives no rows.  Other columns of ``df`` are
    not read.  ``times`` below 3 is refused: the grid finds runs of three
    periods.
    """
    if times < 3:
        raise ValueError("runs repeat their period three times or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found, texts = [], []
                for value in batch.column(1):
                    words = (value.as_py() or b"").split()
                    runs = runs_of(words, least, times)
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    texts.append(b" ".join(collapsed(words, runs)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(texts, pa.binary())], ["id", "runs", "collapsed"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return (rows.mapInArrow(run, "id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
            .withColumn("collapsed", F.col("collapsed").cast("string")))
