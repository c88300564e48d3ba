"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with cosine >= t lie within r = sqrt(2 - 2 t) of each other.  A
few pivots split the space into cells (a vector's home is the cell of its
nearest pivot).  By the triangle inequality a vector at home elsewhere can have
a partner in a cell only if it is no further than r beyond the bisector of
that cell's pivot and any other; it visits just those cells.  Each cell is
joined on its own: its homes, in blocks of bounded size, against all vectors
present, streamed.  Every pair of vectors is thus seen once from each side.
Blocks send on counts and one edge per vector, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import connected_components, written

THRESHOLD = 0.93
#: Bounded sample from which pivots come and the number of cells is chosen.
SAMPLE = 2000
CELLS = (64, 32, 16, 8, 4, 1)
#: Copies of a vector that the cells may cost on average.
COPIES = 6.0
BLOCK = 2048
STREAM = 512
#: Slack of the bounds, far above rounding errors of unit vectors.
SLACK = 1e-9
BATCH_ROWS = 4096


def unit_rows(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def visited(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit row, and the cells where it must be present."""
    c = x @ pivots.T
    home = c.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    present = np.ones(c.shape, dtype=bool)
    for k in range(len(pivots)):  # partners of cell j are nearer to pivot j than to pivot k
        present &= c[:, [k]] - c <= radius * gap[k] + SLACK
    present[np.arange(len(x)), home] = True
    return home, present


def choose_pivots(sample: np.ndarray, radius: float) -> np.ndarray:
    """Pivots from a sample of unit rows: the most cells that keep the copies
    of a vector low."""
    for n in CELLS:
        pivots = sample[:n]
        if n == 1 or len(sample) >= 4 * n and visited(sample, pivots, radius)[1].sum(axis=1).mean() <= COPIES:
            return pivots
    return sample[:1]


def _blocks(threshold: float):
    """Arrow function over rows sorted by cell, block and role (own homes first)."""

    def components(linked: np.ndarray) -> np.ndarray:
        label = np.arange(len(linked))
        while True:
            least = np.minimum(label, np.where(linked, label, len(label)).min(axis=1, initial=len(label)))
            least = least[least]
            if (least == label).all():
                return label
            label = least

    class Group:
        def __init__(self, dim: int):
            self.dim, self.ids, self.raw, self.homes = dim, [], [], None
            self.out: list[tuple[int, int, int]] = []

        def close_homes(self) -> None:
            self.homes, self.own = unit_rows(self.raw, self.dim), np.array(self.ids, dtype=np.int64)
            self.label = np.arange(len(self.own))
            counts = np.zeros(len(self.own), dtype=np.int64)
            linked = self.homes @ self.homes.T >= threshold
            linked &= self.own[:, None] != self.own[None, :]
            counts += linked.sum(axis=1)
            self.label = components(linked)
            self.counts, self.raw = counts, []

        def stream(self, ids: np.ndarray, raw: list[bytes]) -> None:
            if self.homes is None:
                self.close_homes()
            for at in range(0, len(ids), STREAM):
                some = ids[at:at + STREAM]
                linked = unit_rows(raw[at:at + STREAM], self.dim) @ self.homes.T >= threshold
                linked &= some[:, None] != self.own[None, :]
                n = linked.sum(axis=1)
                for k in np.nonzero(n)[0]:
                    labels = np.unique(self.label[linked[k]])
                    if len(labels) > 1:
                        self.label[np.isin(self.label, labels)] = labels[0]
                    self.out.append((int(some[k]), int(n[k]), int(self.own[labels[0]])))

        def end(self) -> list[tuple[int, int, int]]:
            if self.homes is None:
                self.close_homes()
            own = [(int(i), int(n), int(self.own[m])) for i, n, m in zip(self.own, self.counts, self.label) if n or self.own[m] != i]
            return self.out + own

    def rows_of(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "links", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, current = None, None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(n)) for n in ("label", "dim", "cell", "block", "visitor")])
            ids = np.asarray(batch.column("id"))
            raw = batch.column("vector").to_pylist()
            cuts = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                key, visitor = tuple(keys[:4, lo].tolist()), keys[4, lo]
                if key != current:
                    if group is not None:
                        yield rows_of(group.end())
                    group, current = Group(int(key[1])), key
                if visitor:
                    if group.ids or group.homes is not None:
                        group.stream(ids[lo:hi], raw[lo:hi])
                        if len(group.out) > 50_000:
                            yield rows_of(group.out)
                            group.out = []
                else:
                    group.ids += ids[lo:hi].tolist()
                    group.raw += raw[lo:hi]
        if group is not None:
            yield rows_of(group.end())

    return run


def link_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: ``id, n_links, component_id, kept``.

    Vectors with equal labels link when their cosine in double precision is at
    least ``threshold``.  Vectors that are null, empty, zero, or hold null or
    non-finite numbers, null labels and null ids link with nothing; vectors of
    different lengths neither.  Rows that repeat an id count as one vector's
    readings: they link as that id, never with each other.  ``component_id`` is
    the smallest id reachable by links (null for null ids, which are kept).  An
    empty table gives no rows.  Other columns are not read.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    good = rows.where("id is not null and label is not null and v is not null").where(F.coalesce(sound, F.lit(False))).withColumn("dim", F.size("v"))
    common = good.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sample = good.where(F.col("dim") == common["dim"]).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    picked = np.array([r["v"] for r in sample])
    pivots = choose_pivots(picked / np.sqrt((picked ** 2).sum(axis=1))[:, None], radius)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, BATCH_ROWS) for at in range(0, whole.num_rows, BATCH_ROWS)):
                out = [[], [], [], [], [], []]
                dims = np.asarray(batch.column("dim"))
                values = batch.column("v")
                for dim in np.unique(dims):
                    at = np.nonzero(dims == dim)[0]
                    x = np.asarray(values.take(pa.array(at)).flatten(), dtype="<f8").reshape(len(at), dim)
                    if dim == pivots.shape[1]:
                        largest = np.abs(x).max(axis=1)[:, None]  # keeps squares finite
                        unit = x / largest
                        home, present = visited(unit / np.sqrt((unit ** 2).sum(axis=1))[:, None], pivots, radius)
                    else:
                        home, present = np.full(len(at), -1), np.ones((len(at), 1), dtype=bool)
                    row, cell = np.nonzero(present)
                    if dim != pivots.shape[1]:
                        cell = np.full(len(row), -1)
                    scaled = x / np.abs(x).max(axis=1)[:, None]
                    out[0] += np.asarray(batch.column("id"))[at[row]].tolist()
                    out[1] += np.asarray(batch.column("label"))[at[row]].tolist()
                    out[2] += [int(dim)] * len(row)
                    out[3] += cell.tolist()
                    out[4] += (home[row] == cell).tolist()
                    out[5] += [scaled[k].tobytes() for k in row]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["id", "label", "dim", "cell", "home", "vector"])

    placed = written(good.select("id", "label", "dim", "v").mapInArrow(place, "id long, label long, dim int, cell int, home boolean, vector binary"), "placed")
    cells = placed.where("home").groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    spread = (placed.join(cells, ["label", "dim", "cell"])
              .withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("id", "label", "dim", "cell", "block", (~F.coalesce(F.col("own") == F.col("block"), F.lit(False))).cast("int").alias("visitor"), "vector"))
    key = ["label", "dim", "cell", "block"]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = written(spread.repartition(parts, *key).sortWithinPartitions(*key, "visitor", "id").mapInArrow(_blocks(threshold), "id long, links long, peer long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("peer").alias("b")), "vectors")
    return (rows.join(counts, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
