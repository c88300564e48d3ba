"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token keeps its parts in a linked list.  The queue has one bucket per
merge rank with the positions of pairs of that rank (leftmost first), and a
bitmap of two levels over the ranks (words of 256 bits under one word of bits
for the words in use): find-first-set on each level gives the next rank in
constant time.  An entry whose pair has changed since is skipped.  The work for
a pre-token of n bytes is O(n) queue steps, also where one pre-token is a whole
long text.

Runs in Arrow batches on the executors; a bounded table of recent pre-tokens
saves repeated work and holds no state that results depend on.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
WORD = 8
MASK = (1 << WORD) - 1
RECENT = 800_000


class Recent(dict):
    """Decimal ids of recent pre-tokens, in two generations of bounded size."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, word: str) -> str:
        ids = self.older.get(word)
        if ids is None:
            ids = " ".join(map(str, self.merge(word.encode("utf-8", "replace"))))
        if len(self) >= RECENT:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Codec:
    """Encoder and decoder over ``token bytes -> rank``; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words = (max(ranks.values()) >> WORD) + 1
        self.find = regex.compile(pattern).findall
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self.recent = Recent(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.  The queue's steps stand in the loop: calls
        would cost more than they do."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        rank_of = ranks.get
        buckets: dict[int, list[int]] = {}  # rank -> positions of pairs, a heap
        low, top = [0] * self.words, 0  # the bitmap: ranks in words, words in use
        after = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # start of the part before it
        pair = [rank_of(piece[i:i + 2], -1) for i in range(n)]  # rank of the pair that starts here, -1: none
        pair[n - 1] = -1
        live = 0  # pairs that can merge; other entries of the queue are stale
        fresh = [(r, i) for i, r in enumerate(pair) if r >= 0]
        while True:
            for r, i in fresh:
                live += 1
                if bucket := buckets.get(r):
                    heappush(bucket, i)
                else:
                    buckets[r] = [i]
                    if not (bits := low[r >> WORD]):
                        top |= 1 << (r >> WORD)
                    low[r >> WORD] = bits | 1 << (r & MASK)
            if not live:
                break
            word = (top & -top).bit_length() - 1
            bits = low[word]
            r = (word << WORD) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                low[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            fresh = ()
            if pair[i] != r:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            live -= 1 + (pair[j] >= 0)
            pair[j] = pair[i] = -1
            if end < n:
                before[end] = i
                if (r := rank_of(piece[i:after[end]], -1)) >= 0:
                    pair[i] = r
                    fresh = ((r, i),)
            if (h := before[i]) >= 0:
                live -= pair[h] >= 0
                pair[h] = r = rank_of(piece[h:end], -1)
                if r >= 0:
                    fresh += ((r, h),)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.recent.__getitem__, self.find(text)))

    def decode(self, ids: Iterable[str]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """Codec of a file of base64 tokens and ranks (default: a public one)."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern or public_tokenizers.PATTERN)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None,
                 keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode each text and decode its ids again: one row per row of ``df``
    with the id and ``n_tokens``, then, as ``keep`` names them, ``ids`` (array
    of int), ``decoded`` (binary) and their digests ``ids_sha256`` (of decimal
    ids joined by one space) and ``decoded_sha256``.

    Null texts are empty; empty texts have no ids.  Ids of rows may be null or
    repeat.  Other columns of ``df`` are not read; an empty table gives no rows.
    """
    kinds = {"ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            counts, made = [], {name: [] for name in keep}
            for text in batch.column(1):
                joined = coder.encode(text.as_py() or "")
                ids = joined.split(" ") if joined else []
                counts.append(len(ids))
                decoded = coder.decode(ids) if {"decoded", "decoded_sha256"} & set(keep) else b""
                for name in keep:
                    made[name].append(
                        list(map(int, ids)) if name == "ids" else decoded if name == "decoded"
                        else hashlib.sha256(joined.encode() if name == "ids_sha256" else decoded).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            for name in keep:
                kind = {"ids": pa.list_(pa.int32()), "decoded": pa.binary()}.get(name, pa.string())
                columns.append(pa.array(made[name], kind))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", *keep])

    schema = "id long, n_tokens long" + "".join(f", {name} {kinds[name]}" for name in keep)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
