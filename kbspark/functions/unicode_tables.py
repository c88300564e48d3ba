"""Character tables for ``translate()``, generated from ``unicodedata`` by rule.

Spark's ``translate`` maps one code point to at most one code point, so every
table is split into: a one-to-one part, a deletion part, and the set of
characters whose rewritten form is longer than one character.  Rows holding a
character of the last set (or any supplementary-plane character) are handed to
an Arrow-batched fallback; all other rows stay in JVM expressions.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

BMP_LIMIT = 0x10000


def _strip_marks(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", s)
                   if unicodedata.category(ch) != "Mn")


def _ascii_fold(s: str) -> str:
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


def _build(rule) -> tuple[str, str, str, tuple[tuple[int, int], ...]]:
    """Returns (mapped from, mapped to, deleted, ranges of longer results)."""
    src, dst, deleted, long_ranges = [], [], [], []
    for cp in range(BMP_LIMIT):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        out = rule(ch)
        if out == ch:
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        elif not out:
            deleted.append(ch)
        else:
            if long_ranges and long_ranges[-1][1] == cp - 1:
                long_ranges[-1][1] = cp
            else:
                long_ranges.append([cp, cp])
    return ("".join(src), "".join(dst), "".join(deleted),
            tuple((a, b) for a, b in long_ranges))


@functools.lru_cache(maxsize=None)
def accent_table():
    """NFD then drop category Mn."""
    return _build(_strip_marks)


@functools.lru_cache(maxsize=None)
def ascii_fold_table():
    """NFKD then keep ASCII only."""
    return _build(_ascii_fold)


@functools.lru_cache(maxsize=None)
def digit_table() -> tuple[str, str]:
    """Every decimal digit (category Nd) mapped to its ASCII digit, so that a
    Unicode-aware ``\\d+`` capture can be cast to an integer as Python's
    ``int()`` does."""
    src, dst = [], []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if cp < 128 or unicodedata.category(ch) != "Nd":
            continue
        src.append(ch)
        dst.append(str(unicodedata.decimal(ch)))
    return "".join(src), "".join(dst)


def ranges_to_class(ranges) -> str:
    """Java regex character class body for code-point ranges."""
    parts = []
    for a, b in ranges:
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    return "".join(parts)


def strip_marks_py(s):
    return None if s is None else _strip_marks(s)


def ascii_fold_py(s):
    return None if s is None else _ascii_fold(s)
