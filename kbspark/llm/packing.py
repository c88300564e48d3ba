"""Bounded-space online best-fit packing of tokenised documents.

Documents are tokenised, ended with an end id and cut into pieces of at most
one sequence.  Pieces are dealt by a hash to packers.  A packer sees its
pieces once, in order of arrival (by id and piece; of the next ``LOOK_AHEAD``
the longest first), and keeps at most ``OPEN`` open bins in lists by free
space, under a bitset with one bit for each amount of free space: the lowest
set bit from the piece's length on is the best fit.  When a piece fits nowhere
a bin is opened, and if there are too many, the fullest closes first.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import written

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 2048
OPEN = 512
LOOK_AHEAD = 256
#: Pieces of one packer, about; the number of packers grows with the pieces.
PACKER_PIECES = 1 << 16
#: Bytes of the table of recent parts of texts of one worker, about, and of an entry besides its text and ids.
RECENT_BYTES = 96 << 20
ENTRY_BYTES = 200
#: Texts read from Arrow at a time.
SLICE = 128
ID_BYTES = 4


class WordIds(dict):
    """Ids (as little-endian bytes) of the blank-separated parts of texts.

    The tokenizer drops white space and never joins across it, so each part is
    encoded alone.  Most parts are a word of plain letters and a mark behind
    it: the tokenizer lower-cases the one and splits off the other, so both are
    looked up on their own, and a plain word goes straight to the tokenizer's
    model.  Recent parts are kept in two generations of bounded bytes.  Texts
    that name one of the tokenizer's added tokens are encoded whole.
    """

    #: Letters that lower-case one by one and are composed already.
    plain = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?%&#$*|]*)").fullmatch

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has a task already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.start = os.path.commonprefix(self.added)
        self.tokenise = self.tokenizer.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: as_bytes(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.raw = [i.to_bytes(ID_BYTES, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self._encode(part)
        self.held += ENTRY_BYTES + len(part) + len(ids)
        if self.held > RECENT_BYTES // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[part] = ids
        return ids

    def _encode(self, part: str) -> bytes:
        if m := self.plain(part):
            word, mark = m[1].lower(), m[2]
            if mark:
                return self[word] + self[mark]
            if word != part:
                return self[word]
            return b"".join([self.raw[token.id] for token in self.tokenise(part.translate(self.letters))])
        return b"".join(map(self.raw.__getitem__, self.tokenizer.encode(part, add_special_tokens=False).ids))

    def ids(self, text: str) -> bytes:
        if self.start in text and any(name in text for name in self.added):
            return b"".join(map(self.raw.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def word_ids(path: str | None) -> WordIds:
    import public_tokenizers

    return WordIds(path or public_tokenizers.path(VOCABULARY))


def tokenise(df: DataFrame, id_col: str, text_col: str, path: str | None = None, end_id: int = 0, sequence: int = SEQUENCE,
             keep_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, crc[, ids])`` of every piece of every row."""
    end, step = end_id.to_bytes(ID_BYTES, "little"), sequence * ID_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        for whole in batches:
            for batch in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                rows: list[tuple] = []
                for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw = coder.ids(text.as_py() or "") + end
                    rows += [(ident, k, k * sequence, len(cut) // ID_BYTES, zlib.crc32(cut), cut)
                             for k, cut in enumerate(raw[at:at + step] for at in range(0, len(raw), step))]
                columns = list(zip(*rows))[:None if keep_ids else 5]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["id", "piece", "start", "length", "crc", "ids"][:len(columns)])

    schema = "id long, piece int, start long, length long, crc long" + ", ids binary" * keep_ids
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class BestFit:
    """Open bins of one packer."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id = size, most, first_id
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.free_bits = 0
        self.open = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return got

    def _put(self, free: int, bin_id: int) -> None:
        self.by_free[free].append(bin_id)
        self.free_bits |= 1 << free
        self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """``(bin, offset)`` of a piece of this length."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.size, self.next_id
            self.next_id += 1
            if length < self.size and self.open >= self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)  # the fullest closes
        if free > length:
            self._put(free - length, bin_id)
        return bin_id, self.size - free


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0,
                   sequence: int = SEQUENCE, open_bins: int = OPEN) -> DataFrame:
    """One row per piece: ``id, piece, start, length, crc, sequence_id, offset``.

    Ids are those of the tokenizer's library as the file has it, so a string
    that names one of its added tokens becomes that token's id.  Every document
    gets the end id; only those longer than ``sequence`` are cut, into whole
    sequences and a rest.  Null texts are empty (the end id
    alone).  Null and repeated ids are packed like others.  Offsets in a
    sequence are gapless from 0; sequence ids are unique, not dense.  An empty
    table gives no rows.  Other columns are not read.
    """
    pieces = written(tokenise(df, id_col, text_col, path, end_id, sequence), "pieces")
    packers = max(1, -(-pieces.count() // PACKER_PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(sequence, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            lengths = batch.column(3).to_pylist()
            places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
            for at in range(0, len(lengths), LOOK_AHEAD):
                for i in sorted(range(at, min(at + LOOK_AHEAD, len(lengths))), key=lambda i: -lengths[i]):
                    places[i] = bins.place(lengths[i])
            if places:
                ids, offsets = zip(*places)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())],
                                                 [*batch.schema.names, "sequence_id", "offset"])

    dealt = pieces.repartition(packers, F.xxhash64("id", "piece", "crc")).sortWithinPartitions("id", "piece", "crc")
    return dealt.mapInArrow(run, "id long, piece int, start long, length long, crc long, sequence_id long, offset long")
