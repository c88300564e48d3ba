"""Containment of many needles in many texts by one multi-pattern automaton.

The distinct needles are cut into blocks of bounded size.  Each block becomes
an Aho-Corasick automaton in the tasks, which reads every text once and finds
all of the block's needles in it; so a block costs one pass over the texts,
however many needles it holds, and no shuffle of the texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters of the needles of one automaton (about 45 bytes each in memory),
# and blocks from which on another way is cheaper than a pass for each.
BLOCK_CHARS = 1 << 20
MAX_BLOCKS = 16
# Texts read from Arrow at a time.
SLICE = 256


@functools.lru_cache(maxsize=1)
def _automaton(needles: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        found.add_word(needle, i)
    found.make_automaton()
    return found


def _search(needles: tuple[str, ...], every: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(needles) if needles else None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows: list[int] = []
                found: list[str] = []
                for i, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    if text is None:
                        continue
                    hits = sorted({k for _, k in automaton.iter(text)}) if automaton is not None and text else []
                    rows += [i] * (len(hits) + every)
                    found += [needles[k] for k in hits] + [""] * every
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:len(names) - 1]), pa.array(found, pa.string())], names)
    return run


def needle_blocks(needles: DataFrame, needle: str, block_chars: int = BLOCK_CHARS) -> int:
    """How many blocks the distinct needles make."""
    size = needles.select(needle).distinct().agg(F.sum(F.length(needle) + F.lit(1))).first()[0]
    return max(1, -(-int(size or 0) // block_chars))


def texts_with_needles(needles: DataFrame, needle: str, texts: DataFrame, text_id: str, text: str, blocks: int, keep_text: bool = False) -> DataFrame:
    """``(text_id[, text], needle)`` once for every text that contains a needle.

    An empty needle is contained in every text; null needles and texts match
    nothing.  One block of needles is read by the driver at a time, and its
    size is bounded by ``BLOCK_CHARS`` (a longer single needle is a block)."""
    rows = texts.select(text_id, text)
    kept = [text_id, text] if keep_text else [text_id]
    schema = rows.select(*kept).schema.add(needle, "string")
    distinct = needles.select(needle).where(F.col(needle).isNotNull()).distinct()
    out = None
    for k in range(blocks):
        mine = distinct.where(F.pmod(F.xxhash64(needle), F.lit(blocks)) == k) if blocks > 1 else distinct
        words = sorted(r[0] for r in mine.collect())
        part = rows.mapInArrow(_search(tuple(w for w in words if w), "" in words, [*kept, needle]), schema)
        out = part if out is None else out.unionByName(part)
    return out
