"""Near-duplicate texts by an n-gram Jaccard join with adaptive prefixes.

A text's set holds its distinct word shingles.  All sets order their tokens in
one global order: tokens of the lower half of the hash space first, by how many
sets hold them, then the rest.  A pair that links shares at least ``l`` tokens of both
prefixes of length ``n - ceil(t n) + l``, for every ``l``.  Each set picks the
``l`` with the least estimated cost (longer prefixes cost scans, but a
candidate then needs ``l`` shared prefix tokens), and a pair is held to the
smaller of its two.  Sets whose shortest prefix holds only tokens of their own
have no partner; these are most.

Groups of near copies are never paired out.  Equal sets stand for each other.
Of the sets that share a prefix token, first each is compared with one pivot,
which already connects most groups; then, for tokens whose sets are still in
several components, the sets outside the token's largest component are the
queries, in blocks of bounded size, against all sets that hold the token.
Any link between components has such a token, so none is lost.  Blocks count
shared prefix tokens, verify the survivors on the whole sets, and send on only
edges that join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import connected_components, written
from kbspark.llm.shingles import shingle_set

WORDS = 5
PERCENT = 75
#: Longest ``l`` a prefix may be lengthened by.
LONGEST = 8
#: Verifying a candidate costs this many scanned entries per token of a set.
VERIFY_COST = 0.05
BLOCK = 512
STREAM_ROWS = 4096
#: Rows read from Arrow at a time, and tokens of a block up to which its sets are indexed together.
SLICE = 64
INDEXED_TOKENS = 1 << 20
#: A token found in this many sets of one in ``COUNTED`` is counted on the map side.
COUNTED = 64
HOT_SETS = 1 << 11
#: Id tables up to this many rows (8 bytes each) are sent to all tasks; longer ones are joined by a shuffle.
SMALL_ROWS = 1_000_000


def least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n shares at least with any partner."""
    return -(-PERCENT * n // 100)


def digest(tokens: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(tokens.tobytes()), dtype=np.uint64).view(np.int64))


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            yield whole.slice(at, SLICE)


def _per_text(texts: DataFrame, schema: str, make) -> DataFrame:
    """``make(id, set) -> list of column arrays`` over slices of ``(id, text)``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, texts_ = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(make(ids, [shingle_set(t or "", WORDS) for t in texts_]), names)

    return texts.mapInArrow(run, schema)


def _info(ids: list, sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()),
            pa.array([int(np.searchsorted(s, 0)) for s in sets], pa.int64())]


def _tokens(ids: list, sets: list[np.ndarray]) -> list[pa.Array]:
    """Tokens of the lower half, and as many more as the longest prefix needs."""
    n = [max(int(np.searchsorted(s, 0)), min(len(s), len(s) - least_overlap(len(s)) + LONGEST)) for s in sets]
    return [pa.array(np.concatenate([s[:k] for s, k in zip(sets, n)]) if sets else [], pa.int64()),
            pa.array(np.repeat(np.array([digest(s) for s in sets], dtype=np.int64), n), pa.int64())]


def _whole(ids: list, sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]


def choose_prefix(n: int, low: int, tokens: np.ndarray, frequency: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """``(l, prefix tokens, their levels)`` of a set of n tokens, ``low`` of
    them in the lower half, given those of its emitted tokens that other sets
    hold too.  A token's level is the least ``l`` whose prefix has it; a prefix
    that ends within the upper half takes all that was emitted of it."""
    upper = tokens >= 0
    order = np.lexsort((tokens, np.where(upper, 0, frequency), upper))
    tokens, frequency, upper = tokens[order], frequency[order], upper[order]
    shared_low = int((~upper).sum())
    alone = low - shared_low  # these come first in the order
    base = n - least_overlap(n)
    place = alone + 1 + np.arange(len(tokens))
    place[upper] = low + 1
    level = np.maximum(1, place - base)
    best, best_cost = 1, np.inf
    for length in range(1, LONGEST + 1):
        scanned = float(frequency[level <= length].sum())
        cost = scanned + VERIFY_COST * n * scanned / length
        if cost < best_cost:
            best, best_cost = length, cost
    held = level <= best
    return best, tokens[held], level[held]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        out: list[list] = [[], [], [], [], []]
        shared = batch.column("shared")
        cuts = shared.offsets.to_numpy() - shared.offsets[0].as_py()
        pairs = shared.flatten()
        token, df = pairs.field("token").to_numpy(), pairs.field("df").to_numpy()
        for doc, n, low, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "low")), cuts[:-1], cuts[1:]):
            length, prefix, level = choose_prefix(n, low, token[lo:hi], df[lo:hi])
            if (level == 1).any():
                for column, value in zip(out, (doc, n, length, prefix.tolist(), level.tolist())):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc", "n", "l", "prefix", "level"])


class Block:
    """Queries of one block, indexed by prefix token and by token."""

    def __init__(self, rows: list[tuple]):
        self.doc = np.array([r[0] for r in rows], dtype=np.int64)
        self.n = np.array([r[1] for r in rows], dtype=np.int64)
        self.l = np.array([r[2] for r in rows], dtype=np.int64)
        self.sets = [np.frombuffer(r[5], dtype=np.int64) for r in rows]
        tokens = np.concatenate([np.array(r[3], dtype=np.int64) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        level = np.concatenate([np.array(r[4], dtype=np.int64) for r in rows])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.level = tokens[order], owner[order], level[order]
        self.label = np.arange(len(rows))
        self.indexed = sum(map(len, self.sets)) <= INDEXED_TOKENS

    @staticmethod
    def _hits(index: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the sorted ``index`` equal to each wanted one, and whose they are."""
        lo, hi = np.searchsorted(index, wanted, "left"), np.searchsorted(index, wanted, "right")
        width = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        return at, np.repeat(np.arange(len(wanted)), width)

    def links(self, row: tuple) -> list[tuple[int, int]]:
        """Edges of one set to queries of components not yet joined through it."""
        doc, n, length, prefix, level, raw = row
        at, mine = self._hits(self.tokens, np.array(prefix, dtype=np.int64))
        who = self.owner[at]
        needed = np.minimum(self.l, length)
        counted = np.maximum(self.level[at], np.array(level, dtype=np.int64)[mine]) <= needed[who]
        enough = np.bincount(who[counted], minlength=len(self.doc)) >= needed
        enough &= (100 * np.minimum(self.n, n) >= PERCENT * np.maximum(self.n, n)) & (self.doc != doc)
        candidates = np.nonzero(enough)[0]
        if not len(candidates):
            return []
        own = np.frombuffer(raw, dtype=np.int64)
        shared = self._overlaps(candidates, own)
        linked = candidates[100 * shared >= PERCENT * (self.n[candidates] + n - shared)]
        if not len(linked):
            return []
        labels, first = np.unique(self.label[linked], return_index=True)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        return [(int(doc), int(self.doc[q])) for q in linked[first]]

    def _overlaps(self, candidates: np.ndarray, own: np.ndarray) -> np.ndarray:
        if len(candidates) > 8 and self.indexed:
            if not hasattr(self, "all"):
                every = np.concatenate(self.sets)
                holder = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
                order = np.argsort(every, kind="stable")
                self.all, self.holder = every[order], holder[order]
            return np.bincount(self.holder[self._hits(self.all, own)[0]], minlength=len(self.doc))[candidates]
        return np.array([self._shared(self.sets[q], own) for q in candidates], dtype=np.int64)

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, part and role, queries first -> edges."""
    current, queries, block, edges = None, [], None, []
    for batch in _slices(batches):
        for key, sub, part, role, *row in zip(*(batch.column(c).to_pylist() for c in ("core", "sub", "part", "role", "doc", "n", "l", "prefix", "level", "whole"))):
            if (key, sub, part) != current:
                current, queries, block = (key, sub, part), [], None
            if role == 0:
                queries.append(tuple(row))
                continue
            if block is None and queries:
                block, queries = Block(queries), []
            if block is not None:
                edges += block.links(tuple(row))
        columns = list(zip(*edges)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])
        edges = []


def probe(queries: DataFrame, candidates: DataFrame, full: DataFrame) -> DataFrame:
    """Edges between the queries ``(core, sub, doc)`` of each block and its
    candidates ``(core, sub, doc)``; a block with many candidates is split into
    parts, each with all the block's queries."""
    parts = candidates.groupBy("core", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(STREAM_ROWS)).cast("int").alias("parts"))
    parts = written(parts, "parts")
    asked = (queries.join(parts, ["core", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("core", "sub", "part", F.lit(0).alias("role"), "doc"))
    offered = (candidates.join(parts, ["core", "sub"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
               .select("core", "sub", "part", F.lit(1).alias("role"), "doc"))
    rows = asked.unionByName(offered).join(full, "doc")
    key = ["core", "sub", "part"]
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartition(width, *key).sortWithinPartitions(*key, "role", "doc").mapInArrow(_probe, "a long, b long"), "edges")


def shared_tokens(texts: DataFrame, counted: int = COUNTED, hot_sets: int = HOT_SETS) -> DataFrame:
    """``(token, doc, df)`` of the tokens that two sets or more hold.

    A token's sets meet in one window, but for tokens that very many hold: one
    in ``counted`` sets tells which these may be, and they are counted on the
    map side instead, over all sets.  The result is the same either way.
    """
    schema = "token long, doc long"
    some = _per_text(texts.where(F.pmod(F.xxhash64("id"), F.lit(counted)) == 0), schema, _tokens)
    hot = written(some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_sets).select("token"), "hot")
    posted = _per_text(texts, schema, _tokens)
    several = not hot.isEmpty()
    few = posted.join(hot, "token", "left_anti") if several else posted
    shared = few.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df >= 2")
    if not several:
        return shared
    held = posted.join(hot, "token", "left_semi")
    often = written(held.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2"), "often")
    return shared.unionByName(held.join(often, "token"))


def link_sets(texts: DataFrame, info: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between set digests that connect just the sets that
    links connect.  ``texts(id, text)``; ``info(id, n, doc, low)`` of each row."""
    sets = info.where("n > 0 and id is not null").groupBy("doc").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("low").alias("low"))
    sets = written(sets, "sets")
    standing = sets.select(F.col("rep").alias("id")).distinct()
    copies = written(info.where("n > 0 and id is not null").select("id").distinct().join(standing, "id", "left_anti"), "copies")
    own = texts.where("id is not null").join(_sized(copies), "id", "left_anti")
    shared = written(shared_tokens(own), "shared")
    gathered = shared.groupBy("doc").agg(F.collect_set(F.struct("token", "df")).alias("shared")).join(sets.select("doc", "n", "low"), "doc")
    prefix = written(gathered.mapInArrow(_prefixes, "doc long, n long, l int, prefix array<long>, level array<int>"), "prefix")
    needed = prefix.select("doc").join(sets.select("doc", "rep"), "doc").select(F.col("rep").alias("id")).distinct()
    whole = _per_text(texts.where("id is not null").join(_sized(written(needed, "needed")), "id", "left_semi"), "doc long, whole binary", _whole).dropDuplicates(["doc"])
    full = written(prefix.join(whole, "doc"), "full")

    entries = (prefix.select("doc", F.explode(F.arrays_zip("prefix", "level")).alias("p")).where("p.level = 1")
               .select(F.col("p.prefix").alias("token"), "doc"))
    pivots = entries.groupBy("token").agg(F.min("doc").alias("pivot"), F.count(F.lit(1)).alias("held")).where("held >= 2")
    entries = written(entries.join(written(pivots, "pivots").select("token", "pivot"), "token"), "entries")
    stars = written(entries.where("doc <> pivot").select("pivot", "doc").distinct(), "stars")
    blocks = max(1, -(-stars.select("pivot").distinct().count() // BLOCK))

    def place(doc):
        return F.lit(0).cast("long").alias("core"), F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int").alias("sub")

    first = probe(stars.select("pivot").distinct().select(*place("pivot"), F.col("pivot").alias("doc")),
                  stars.select(*place("pivot"), "doc").distinct(), full)

    component = written(connected_components(first, "first"), "component")
    size = component.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    named = component.join(size, "component").select(F.col("node").alias("doc"), "component", "size")
    entries = written(entries.select("token", "doc").join(named, "doc", "left")
                      .select("token", "doc", F.coalesce("component", "doc").alias("component"), F.coalesce("size", F.lit(1)).alias("size")), "entries")
    cores = (entries.groupBy("token").agg(F.max(F.struct("size", "component")).alias("core"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo <> hi").select("token", F.col("core.component").alias("core")))
    open_ = written(entries.join(written(cores, "cores"), "token"), "open")
    queries = open_.where("component <> core").select("core", "doc").distinct()
    subs = queries.groupBy("core").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("subs"))
    subs = written(subs, "subs")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(subs, "core").withColumn("sub", F.pmod(F.xxhash64("doc"), F.col("subs")).cast("int"))

    asking = dealt(open_.where("component <> core")).select("token", "core", "sub").distinct()
    offered = asking.join(open_.select("token", "doc"), "token").select("core", "sub", "doc").distinct()
    second = probe(dealt(queries).select("core", "sub", "doc"), offered, full)
    return first.unionByName(second)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id, n_shingles, component_id``.

    Rows link when their sets of word shingles have a Jaccard index of 0.75 or
    more; ``component_id`` is the smallest id reachable by links.  Null texts are empty;
    texts without words link with nothing.  Rows that repeat an id are one node
    with the links of all of them.  A null id links with nothing and has a null
    component.  An empty table gives no rows.  Other columns are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    info = written(_per_text(texts, "id long, n long, doc long, low long", _info), "info")
    edges = link_sets(texts, info)
    known = info.where("n > 0 and id is not null")
    # rows of one id join their sets
    joined = known.groupBy("id").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("id", "lo")
    same_id = known.join(joined, "id").select(F.col("doc").alias("a"), F.col("lo").alias("b"))
    component = connected_components(edges.unionByName(same_id), "near")
    least = (known.groupBy("doc").agg(F.min("id").alias("id")).join(component.withColumnRenamed("node", "doc"), "doc", "left")
             .withColumn("component", F.coalesce("component", "doc")))
    least = written(least, "least")
    smallest = written(least.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    named = written(least.join(smallest, "component").select("doc", "component_id"), "named")
    return (info.join(named, "doc", "left")
            .select("id", F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("id"))).alias("component_id")))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one text of each group of near copies, that of the smallest
    id, all columns as they are.

    Groups are made of texts: rows that share an id are decided each by its own
    text, and of near copies with the smallest id one stays.  Rows equal in id
    and text stay or go together.  Rows with a null id or without words stay.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n long, doc long, low long"
    info = written(_per_text(texts, schema, _info), "info")
    component = written(connected_components(link_sets(texts, info), "near"), "component").withColumnRenamed("node", "doc")
    known = info.where("n > 0 and id is not null")
    repeated = written(info.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "repeated")
    several = not repeated.isEmpty()
    rows = known.select("id", "doc", F.lit(0).cast("long").alias("key"))
    if several:  # these rows are told apart by their texts
        own = written(texts.join(_sized(repeated), "id", "left_semi").select("id", F.xxhash64("text").alias("key"), "text"), "own")
        sets = _per_text(own.select(F.col("key").alias("id"), "text"), schema, _info).where("n > 0").select(F.col("id").alias("key"), "doc").distinct()
        rows = (rows.join(_sized(repeated), "id", "left_anti")
                .unionByName(own.select("id", "key").distinct().join(written(sets, "sets"), "key").select("id", "doc", "key")))
    named = written(rows.join(component, "doc", "left").select("id", "key", F.coalesce("component", "doc").alias("component"), F.struct("id", "doc", "key").alias("row")), "named")
    kept = written(named.groupBy("component").agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "kept")
    gone = written(named.join(kept, "component").where("row <> kept").select(F.col("id").alias("__kb_id"), F.col("key").alias("__kb_key")), "gone")
    same = df[id_col].cast("long") == F.col("__kb_id")
    if not several:
        return df.join(_sized(gone.select("__kb_id")), same, "left_anti")
    single = gone.join(_sized(repeated), F.col("__kb_id") == F.col("id"), "left_anti").select("__kb_id")
    mixed = gone.join(_sized(repeated), F.col("__kb_id") == F.col("id"), "left_semi")
    return (df.join(_sized(written(single, "single")), same, "left_anti")
            .join(_sized(written(mixed, "mixed")), same & (F.xxhash64(df[text_col]) == F.col("__kb_key")), "left_anti"))
