"""Token counts of texts by a sentencepiece model, lengths only.

Texts are encoded in batches balanced by bytes, whatever the rows' sizes are: a
long text is cut into segments at safe boundaries, and segments of any texts
fill a batch up to a byte bound.  A boundary between two characters is safe if
no piece of the vocabulary holds them side by side: no merge can then cross it,
and the parts' tokens are those of the whole.  A later segment starts behind a
line feed, which is no part of any piece: it takes the place of the blank that
the model puts before a text, and its own tokens are taken off again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a segment, about, and bytes of a batch.
SEGMENT = 1 << 15
BATCH_BYTES = 1 << 18
#: Rows read from Arrow at a time.
SLICE = 256
BLANK = "▁"
LEAD = "\n"


class Counter:
    """Token counts by one model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        plain = [model.id_to_piece(i) for i in range(len(model))
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        #: Neighbours within pieces; a model without byte pieces joins unknown characters, so it allows no cut.
        self.pairs = {p[i:i + 2] for p in plain for i in range(len(p) - 1)}
        self.cuts = any(model.is_byte(i) for i in range(len(model))) and not any(LEAD in p for p in plain)
        self.lead = len(model.encode(LEAD))

    def safe(self, text: str, at: int) -> bool:
        return (text[at - 1] + text[at]).replace(" ", BLANK) not in self.pairs

    def segments(self, text: str, size: int) -> list[str]:
        """``text`` in parts of about ``size`` characters, cut at safe
        boundaries only; where there is none the part goes on to the next."""
        parts, start = [], 0
        while self.cuts and len(text) - start > size:
            at = start + size
            while at > start and not self.safe(text, at):
                at -= 1
            if at == start:
                at = start + size + 1
                while at < len(text) and not self.safe(text, at):
                    at += 1
            if at >= len(text):
                break
            parts.append(text[start:at])
            start = at
        return [*parts, text[start:]]

    def counts(self, texts: Iterator[str], size: int = SEGMENT, batch_bytes: int = BATCH_BYTES) -> list[int]:
        """Tokens of each text."""
        totals: list[int] = []
        batch: list[bytes] = []
        owners: list[int] = []
        held = 0

        def encode() -> None:
            nonlocal held
            for owner, ids in zip(owners, self.model.encode(batch, num_threads=1)):
                totals[owner] += len(ids)
            batch.clear()
            owners.clear()
            held = 0

        for text in texts:
            totals.append(0)
            for k, part in enumerate(self.segments(text, size) if len(text) > size else (text,)):
                if k:
                    totals[-1] -= self.lead
                    part = LEAD + part
                raw = part.encode("utf-8", "replace")
                if batch and held + len(raw) > batch_bytes:
                    encode()
                batch.append(raw)
                owners.append(len(totals) - 1)
                held += len(raw)
        if batch:
            encode()
        return totals


@functools.lru_cache(maxsize=2)
def counter(path: str | None = None) -> Counter:
    import public_tokenizers

    return Counter(path or public_tokenizers.path(VOCABULARY))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``df``: ``id, n_bytes`` (UTF-8)``, n_tokens,
    over_limit`` (more than ``limit`` tokens).

    Tokens are those of the library for the whole text, without begin and end;
    names of control pieces inside a text are ordinary text.  Null and empty
    texts have no tokens.  Texts of any length are counted whole.  Null and
    repeated ids are counted row by row; an empty table gives no rows.  Other
    columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                tokens = count(value.as_py() or "" for value in batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                     F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
