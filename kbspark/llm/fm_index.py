"""A bidirectional FM-index over a delimited vocabulary (numpy).

Words are laid out with a delimiter behind each.  Two Burrows-Wheeler
transforms are kept, of the words and of the reversed words, each as a wavelet
matrix.  A pattern has one rank interval in either; extending it by a symbol on
one side narrows that side's interval by two rank queries, and the other one by
the number of smaller symbols met on the way, so both stay in step and a
pattern can grow to the left and to the right.  All steps take whole arrays of
intervals.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0


def suffix_order(codes: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """Order of the suffixes of a text of delimited words: by the rest of the
    word, then by place.  ``left`` is the number of symbols up to the delimiter,
    itself included; symbols take ``bits`` bits."""
    n, width = len(codes), max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):  # as many symbols as a number holds
        symbol = np.zeros(n, dtype=np.int64)
        inside = left > k
        symbol[inside] = codes[np.flatnonzero(inside) + k]
        key = (key << bits) | symbol
    span, longest = width, int(left.max())
    while True:
        order = np.argsort(key, kind="stable")
        if span >= longest:
            return order
        rank = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        by_place = np.empty(n, dtype=np.int64)
        by_place[order] = rank + 1
        behind = np.zeros(n, dtype=np.int64)
        inside = left > span
        behind[inside] = by_place[np.flatnonzero(inside) + span]
        key = by_place * (n + 1) + behind  # doubles the symbols compared
        span *= 2


class Wavelet:
    """Ranks in a sequence of symbols below ``2 ** bits``, most significant bit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones, self.zeros = [], []
        now = symbols
        for level in range(bits):
            bit = (now >> (bits - 1 - level)) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        counts = np.bincount(symbols, minlength=1 << bits)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1]))  # rows of the suffix order before each symbol
        every = np.arange(1 << bits)
        self.base, _, _ = self._down(np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64), every)

    def _down(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.zeros(len(lo), dtype=np.int64)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one_lo, one_hi = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            smaller += np.where(up, (hi - one_hi) - (lo - one_lo), 0)
            lo, hi = np.where(up, zeros + one_lo, lo - one_lo), np.where(up, zeros + one_hi, hi - one_hi)
        return lo, hi, smaller

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval of each pattern with the symbol put before it, and how many
        of its places have a smaller symbol there."""
        a, b, smaller = self._down(lo, hi, symbol)
        start = self.first[symbol] - self.base[symbol]
        return a + start, b + start, smaller

    def branch(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """All symbols that occur in each interval: ``(which interval, symbol,
        lo, hi, smaller)`` as ``step`` gives them."""
        owner, symbol, smaller = np.arange(len(lo)), np.zeros(len(lo), dtype=np.int64), np.zeros(len(lo), dtype=np.int64)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one_lo, one_hi = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            zero_lo, zero_hi = lo - one_lo, hi - one_hi
            low, up = zero_hi > zero_lo, one_hi > one_lo
            symbol <<= 1
            smaller = np.concatenate((smaller[low], smaller[up] + (zero_hi - zero_lo)[up]))
            lo = np.concatenate((zero_lo[low], zeros + one_lo[up]))
            hi = np.concatenate((zero_hi[low], zeros + one_hi[up]))
            owner = np.concatenate((owner[low], owner[up]))
            symbol = np.concatenate((symbol[low], symbol[up] | 1))
        start = self.first[symbol] - self.base[symbol]
        return owner, symbol, lo + start, hi + start, smaller


class Vocabulary:
    """Bidirectional index of distinct words, given as one array of code points
    and the words' lengths, in code-point order."""

    LEFT, RIGHT = 0, 1

    def __init__(self, points: np.ndarray, lengths: np.ndarray):
        self.k = len(lengths)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        codes = codes.astype(np.int64) + 1  # 0 is the delimiter
        bits = max(1, int(len(self.alphabet)).bit_length())
        ends = np.cumsum(lengths)
        starts = ends - lengths
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        mirrored = codes[np.repeat(ends - 1, lengths) - place]
        words = self._order(mirrored, starts, lengths, bits)
        self.sides = [self._transform(codes, starts, lengths, np.arange(self.k), bits), self._transform(mirrored, starts, lengths, words, bits)]
        self.n = self.sides[0].n

    @staticmethod
    def _layout(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in the given order with delimiters, and the symbols left to each delimiter."""
        size = lengths[words] + 1
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(int(ends[-1]))
        text = np.zeros(int(ends[-1]), dtype=np.int64)
        inside = left > 1
        text[inside] = codes[(np.repeat(starts[words] + size, size) - left)[inside]]
        return text, left

    @classmethod
    def _order(cls, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
        """The words in order of their codes."""
        every = np.arange(len(lengths))
        text, left = cls._layout(codes, starts, lengths, every)
        order = suffix_order(text, left, bits)
        at = np.cumsum(lengths + 1) - (lengths + 1)
        word_at = np.full(len(text), -1)
        word_at[at] = every
        found = word_at[order]
        return found[found >= 0]

    @classmethod
    def _transform(cls, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: np.ndarray, bits: int) -> Wavelet:
        # the last word comes first, so that equal suffixes stand in the order of the word that follows them
        text, left = cls._layout(codes, starts, lengths, np.roll(words, 1))
        return Wavelet(text[suffix_order(text, left, bits) - 1], bits)

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points, -1 where no word has it."""
        at = np.searchsorted(self.alphabet, points).clip(max=len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1)


class Matches:
    """Patterns in the index: the query, and the interval on either side."""

    def __init__(self, query: np.ndarray, lo: tuple[np.ndarray, np.ndarray], size: np.ndarray):
        self.query, self.lo, self.size = query, lo, size

    @classmethod
    def empty_patterns(cls, index: Vocabulary, queries: int) -> "Matches":
        zero = np.zeros(queries, dtype=np.int64)
        return cls(np.arange(queries), (zero, zero), np.full(queries, index.n))

    def take(self, which: np.ndarray) -> "Matches":
        return Matches(self.query[which], (self.lo[0][which], self.lo[1][which]), self.size[which])

    def plus(self, other: "Matches") -> "Matches":
        return Matches(np.concatenate((self.query, other.query)), (np.concatenate((self.lo[0], other.lo[0])), np.concatenate((self.lo[1], other.lo[1]))),
                       np.concatenate((self.size, other.size)))

    def _moved(self, side: int, which: np.ndarray, lo: np.ndarray, hi: np.ndarray, smaller: np.ndarray) -> "Matches":
        other = self.lo[1 - side][which] + smaller
        return Matches(self.query[which], (lo, other) if side == Vocabulary.LEFT else (other, lo), hi - lo)

    def extend(self, index: Vocabulary, side: int, symbol: np.ndarray) -> "Matches":
        """Patterns longer by one symbol on a side; those that do not occur go."""
        which = np.flatnonzero(symbol >= 0)
        lo = self.lo[side][which]
        a, b, smaller = index.sides[side].step(lo, lo + self.size[which], symbol[which])
        some = b > a
        return self._moved(side, which[some], a[some], b[some], smaller[some])

    def branches(self, index: Vocabulary, side: int) -> tuple["Matches", np.ndarray]:
        """Patterns longer by any symbol on a side, and the symbols."""
        lo = self.lo[side]
        which, symbol, a, b, smaller = index.sides[side].branch(lo, lo + self.size)
        return self._moved(side, which, a, b, smaller), symbol


def one_error(index: Vocabulary, queries: np.ndarray, exact: int, side: int, inside: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(query, word)`` numbers of the words that differ from a query by one
    inserted, deleted or replaced symbol outside its exact half.

    ``queries`` holds symbols of words of one length, a row each.  With ``side``
    RIGHT their first ``exact`` symbols are matched as they stand, right to
    left, closed by the delimiter, and extended to the right over the other
    half allowing the error; with LEFT it is the mirror image.  ``inside`` says
    that the index holds the queries too.
    """
    if side == Vocabulary.RIGHT:
        half, rest = queries[:, :exact], queries[:, exact:]
        first = half[:, ::-1]
    else:
        half, rest = queries[:, queries.shape[1] - exact:], queries[:, :queries.shape[1] - exact][:, ::-1]
        first = half
    now = Matches.empty_patterns(index, len(queries))
    for j in range(exact):
        now = now.extend(index, 1 - side, first[now.query, j])
    now = now.extend(index, 1 - side, np.full(len(now.query), DELIMITER))
    now = now.take(now.size > inside)  # the query's own word is not enough
    none = Matches(np.empty(0, dtype=np.int64), (np.empty(0, dtype=np.int64),) * 2, np.empty(0, dtype=np.int64))
    erred = none
    for j in range(rest.shape[1] + 1):
        longer, symbol = now.branches(index, side)
        inserted = longer.take(np.flatnonzero((symbol != DELIMITER) & (symbol != (rest[longer.query, j] if j < rest.shape[1] else -1))))
        if j == rest.shape[1]:
            erred = erred.plus(inserted)
            break
        # a symbol that differs is an insertion before the next one, or stands in its place
        wanted = rest[:, j]
        erred = erred.plus(inserted).extend(index, side, wanted[np.concatenate((erred.query, inserted.query))])
        erred = erred.plus(inserted).plus(now)  # replaced, deleted
        now = longer.take(np.flatnonzero(symbol == wanted[longer.query]))
    erred = erred.extend(index, side, np.full(len(erred.query), DELIMITER))
    pairs = np.unique(erred.query * index.k + erred.lo[Vocabulary.LEFT])
    return pairs // index.k, pairs % index.k
