"""Join helpers: broadcast only behind a measured size bound, shuffle otherwise.

``measure`` runs one small aggregate action over an already reduced frame
(question sets, candidate pairs); the big side is never counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.session import intermediate_path

# Default bounds for a broadcast side. The byte bound is the real limit; the
# row bound keeps per-task hash tables small.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class SideSize:
    rows: int
    bytes: int

    def fits(self, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
        return self.rows <= max_rows and self.bytes <= max_bytes


def _width(field: T.StructField):
    c = F.col(f"`{field.name}`")
    dt = field.dataType
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.FloatType, T.IntegerType)):
        return F.coalesce(F.size(c), F.lit(0)) * 4 + 16
    if isinstance(dt, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    return F.lit(8)


def measure(df: DataFrame) -> SideSize:
    """Rows and approximate in-memory bytes of a (small, reduced) frame."""
    width = None
    for f in df.schema.fields:
        w = _width(f)
        width = w if width is None else width + w
    width = width if width is not None else F.lit(8)
    row = df.select(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("b")).first()
    return SideSize(int(row["n"] or 0), int(row["b"] or 0))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing a table in the session's shared folder and reading
    it back: later plans prune its columns and know its true size."""
    path = intermediate_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, size: SideSize | None = None,
                    max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Return (frame, broadcast?) with a broadcast hint only when the measured
    size is inside the bound."""
    size = size or measure(df)
    if size.fits(max_rows, max_bytes):
        return F.broadcast(df), True
    return df, False
