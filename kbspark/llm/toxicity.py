"""Toxicity by weak supervision.

Twelve voters fire or not on each text: fixed lexicons, attack and shouting
patterns, and lexicons of words and word beginnings mined from a bounded sample
of labelled rows.  A generative label model estimates from all documents how
often each voter fires in either class (expectation maximisation over the at
most 2**12 vote patterns, labelled rows held to their label) and how voters
correlate within a class, and discounts what correlated voters repeat.  Its
posterior labels train a linear classifier on a bounded sample; the classifier
scores every whole text.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import written
from kbspark.llm.shingles import min_hashes, shingle_set

#: Labelled ids whose texts are mined for words, about, and most documents the
#: classifier is fitted on: of larger tables a random sample is taken.
FIT_ROWS = 20_000
#: Texts read from Arrow at a time.
SLICE = 256
BEGINNINGS = (4, 5, 6)
#: Least share of toxic rows among the labelled rows with a mined word.
PRECISION = 0.95
#: Copies of a text count once when words are mined: minimum hashes compared.
COPY_HASHES = 6
SHAPE = 2
ROUNDS = 60
STEPS = 400

# Common insults by language.
LEXICONS = {
    "en": """idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers pathetic scum scumbag trash worthless disgusting clown jerk imbecile
             bastard bitch asshole crap shit fuck fucking retard retarded vermin filth filthy garbage useless coward creep freak""",
    "de": """arschloch idioten dumm dummkopf blöd blödmann trottel abschaum wertlos widerlich ekelhaft versager dreck drecksack scheiße scheiss schwachkopf
             vollidiot miststück hurensohn wichser erbärmlich lächerlich""",
    "fr": """imbécile crétin connard connasse débile ordure dégoûtant minable stupide raté salaud salope merde abruti pathétique pourriture racaille
             enculé bouffon""",
    "es": """idiota idiotas imbécil estúpido estúpida tonto basura asqueroso asquerosa patético patética inútil escoria perdedor payaso mierda
             cabrón gilipollas pendejo puta""",
}
ATTACK = re.compile(r"\b(?:shut up|go to hell|kill yourself|drop dead|screw you|(?:you|they|we) (?:are|were)(?: all| just| such)?(?: an?| the)? (?:idiot|moron|loser|clown|trash|scum|fool|joke)s?)\b")
DISGUISED = re.compile(r"\b[a-z]+[0-9@$*!][a-z0-9@$*!]*[a-z]\b")
PLAIN = str.maketrans("013457@$!", "oleastasi")
WORD = re.compile(r"[^\W\d_]+")
VOTERS = ("en", "de", "fr", "es", "attack", "disguised", "shouting", "words", "begin4", "begin5", "begin6", "several")


@functools.cache
def fixed_words() -> dict[str, int]:
    return {word: k for k, words in enumerate(LEXICONS.values()) for word in words.split()}


@dataclass
class Vocabulary:
    """Features: fixed words first, then the mined ones."""

    words: dict[str, int] = field(default_factory=dict)
    begins: tuple[dict[str, int], ...] = ({}, {}, {})
    size: int = 0

    @classmethod
    def of(cls, mined: list[str]) -> "Vocabulary":
        words = {w: i for i, w in enumerate(fixed_words())}
        begins: tuple[dict[str, int], ...] = ({}, {}, {})
        n = len(words)
        for name in mined:
            where = begins[BEGINNINGS.index(len(name) - 1)] if name.endswith("*") else words
            key = name.rstrip("*")
            if key not in where:
                where[key] = n
                n += 1
        return cls(words, begins, n)


def read_text(text: str, vocabulary: Vocabulary) -> tuple[int, list[int], float, float]:
    """``(vote bits, features that occur, share of capitals, exclamation rate)``."""
    lower = text.lower()
    words = set(WORD.findall(lower))
    hits: set[int] = set()
    bits = 0
    fixed, known = fixed_words(), vocabulary.words
    for word in words & known.keys():
        hits.add(known[word])
        bits |= 1 << (fixed[word] if word in fixed else 7)
    for k, (length, begin) in enumerate(zip(BEGINNINGS, vocabulary.begins)):
        if begin:
            for start in {w[:length] for w in words if len(w) > length} & begin.keys():
                hits.add(begin[start])
                bits |= 1 << (8 + k)
    if ATTACK.search(lower):
        bits |= 1 << 4
    for m in DISGUISED.findall(lower) if any(c in lower for c in "013457@$!*") else ():
        if m.translate(PLAIN) in fixed:
            bits |= 1 << 5
            break
    letters = sum(map(len, words)) and len(WORD.sub("", text)) < len(text)
    capitals = sum(1 for c in text if c.isupper()) / len(text) if letters else 0.0
    shouts = min(1.0, 10 * text.count("!") / len(text)) if text else 0.0
    if capitals > 0.5 or shouts >= 1.0:
        bits |= 1 << 6
    if len(hits) >= 2:
        bits |= 1 << 11
    return bits, sorted(hits), capitals, shouts


def held_out(id_col):
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def _sampled(df: DataFrame, rows: int) -> DataFrame:
    """``rows`` random rows of a written table at most, all if there are no
    more.  Rows are drawn one by one, whatever they hold and repeat."""
    n = df.count()
    if n <= rows:
        return df
    drawn = df.withColumn("__kb_draw", F.rand(17)).where(F.col("__kb_draw") < 1.1 * rows / n)
    return drawn.orderBy("__kb_draw").limit(rows).drop("__kb_draw")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            yield whole.slice(at, SLICE)


def without_copies(texts: DataFrame) -> DataFrame:
    """``(text, toxic)`` with one row of texts that share a minimum hash of
    their shingles: a passage copied many times is one witness for its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes = [min_hashes(shingle_set(t or ""), COPY_HASHES) for t in batch.column("text").to_pylist()]
            columns = [pa.array([h[k] for h in hashes], pa.int64()) for k in range(COPY_HASHES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f"m{k}" for k in range(COPY_HASHES))])

    hashed = texts.mapInArrow(run, "text string, toxic int" + "".join(f", m{k} long" for k in range(COPY_HASHES)))
    for k in range(COPY_HASHES):
        hashed = hashed.groupBy(f"m{k}", "toxic").agg(F.min_by(F.struct("*"), F.struct(*[f"m{j}" for j in range(COPY_HASHES)])).alias("row")).select("row.*")
    return hashed.select("text", "toxic")


def mine(texts: DataFrame) -> list[str]:
    """Words and word beginnings (with ``*``) far more frequent in toxic than
    in clean rows of ``(text, toxic)``, which is a bounded sample."""

    def counter(wanted: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                counts: tuple[Counter, Counter] = (Counter(), Counter())
                rows = [0, 0]
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                    rows[toxic] += 1
                    if wanted is None and not toxic:
                        continue
                    words = set(WORD.findall((text or "").lower()))
                    names = words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}
                    counts[toxic].update(names if wanted is None else names & wanted)
                names = ["", *(counts[0].keys() | counts[1].keys())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([rows[0], *(counts[0][w] for w in names[1:])], pa.int64()),
                     pa.array([rows[1], *(counts[1][w] for w in names[1:])], pa.int64())], ["name", "clean", "toxic"])
        return run

    kind = "name string, clean long, toxic long"
    first = texts.mapInArrow(counter(None), kind).groupBy("name").agg(F.sum("toxic").alias("toxic"))
    total = first.where("name = ''").select("toxic").first()
    least = max(4, int(0.005 * (total["toxic"] if total else 0)))
    wanted = frozenset(r["name"] for r in first.where((F.col("toxic") >= least) & (F.col("name") != "")).select("name").collect())
    rows = texts.mapInArrow(counter(wanted), kind).groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    of = {r["name"]: (r["clean"], r["toxic"]) for r in rows}
    clean, toxic = of.pop("", (0, 0))

    def lift(name: str) -> float:
        c, t = of[name]
        return (t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))

    good = [w for w in of if of[w][1] >= least and of[w][1] >= PRECISION * sum(of[w]) and lift(w) >= 20]
    return sorted(good, key=lambda w: (-lift(w), w))


def label_model(patterns: np.ndarray, counts: np.ndarray, labelled: np.ndarray) -> np.ndarray:
    """Posterior of class 1 for each vote pattern.

    ``patterns`` (m, voters) of 0/1, ``counts`` (m,) of rows without a label to
    use, ``labelled`` (m, 2) of rows by label.  Rates start from the labelled
    rows (a mild prior where there are none) and are refined on all rows.
    """
    x = patterns.astype(float)
    total = labelled.sum(axis=0)
    prior = (total[1] + 1) / (total.sum() + 10)
    # prior belief: a voter rarely fires on clean text and often enough on toxic
    fire = np.array([(labelled[:, c] @ x + (0.02, 0.3)[c] * 4) / (total[c] + 4) for c in (0, 1)])

    def damping(weights: np.ndarray) -> np.ndarray:
        """1 / (1 + correlations with the other voters, averaged over the rows of ``weights``)."""
        rho = np.zeros((x.shape[1], x.shape[1]))
        for w in weights:
            d = x - w @ x / max(w.sum(), 1)
            cov = (d * w[:, None]).T @ d / max(w.sum(), 1)
            sd = np.sqrt(np.diag(cov))
            rho += np.abs(cov) / np.outer(sd, sd).clip(1e-8) / len(weights)
        np.fill_diagonal(rho, 0)
        return 1 / (1 + rho.sum(axis=1))

    # the start has no classes yet: voters that agree overall share their weight
    damp = damping((counts + labelled.sum(axis=1))[None, :])
    for _ in range(ROUNDS):
        fire = fire.clip(1e-6, 1 - 1e-6)
        odds = np.log(prior / (1 - prior)) + ((x * np.log(fire[1] / fire[0]) + (1 - x) * np.log((1 - fire[1]) / (1 - fire[0]))) * damp).sum(axis=1)
        post = 1 / (1 + np.exp(-odds.clip(-50, 50)))
        weight = np.stack([counts * (1 - post) + labelled[:, 0], counts * post + labelled[:, 1]])
        sums = weight.sum(axis=1)
        fire = np.array([(weight[c] @ x + (0.02, 0.3)[c] * 4) / (sums[c] + 4) for c in (0, 1)])
        prior = float(((sums[1] + 1) / (sums.sum() + 10)).clip(0.001, 0.5))
        damp = damping(weight)  # correlations within the classes discount voters that say the same
    return post


def fit_linear(rows: list[tuple[list[int], float, float]], target: np.ndarray, size: int) -> np.ndarray:
    """Ridge logistic regression on sparse 0/1 features and two shape features;
    weights: features, shape, bias."""
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    column = np.fromiter((i for r in rows for i in r[0]), dtype=np.int64, count=len(owner))
    shape = np.array([[r[1], r[2]] for r in rows]).reshape(len(rows), SHAPE)
    w = np.zeros(size + SHAPE + 1)
    w[-1] = -2.0
    speed = np.full_like(w, 1e-8)
    importance = np.where(target > 0.5, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1)) if len(rows) else target
    for _ in range(STEPS if len(rows) else 0):
        z = w[-1] + shape @ w[size:-1] + np.bincount(owner, w[column], minlength=len(rows))
        g = (1 / (1 + np.exp(-z.clip(-50, 50))) - target) * importance
        grad = np.concatenate([np.bincount(column, g[owner], minlength=size), g @ shape, [g.sum()]])
        grad[:-1] += 1e-4 * w[:-1]
        speed += grad ** 2
        w -= 0.3 * grad / np.sqrt(speed)
    return w


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray

    def score(self, hits: list[int], capitals: float, shouts: float) -> float:
        z = self.weights[-1] + self.weights[-3] * capitals + self.weights[-2] * shouts + float(self.weights[hits].sum())
        return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))


VOTE = ("__kb_bits", "__kb_hits", "__kb_capitals", "__kb_shouts")


def _votes(docs: DataFrame, text_col: str, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row, and its votes."""
    at, kept = docs.columns.index(text_col), [docs.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            got = [read_text(t.as_py() or "", vocabulary) for t in batch.column(at)]
            columns = list(zip(*got)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.list_(pa.int32())),
                 pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())], [*keep, *VOTE])

    schema = T.StructType([*(T.StructField(docs.columns[k], docs.schema[k].dataType, True) for k in kept), T.StructField(VOTE[0], T.IntegerType()),
                           T.StructField(VOTE[1], T.ArrayType(T.IntegerType())), T.StructField(VOTE[2], T.DoubleType()), T.StructField(VOTE[3], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        keep: list[str] | None = None) -> tuple[Model, DataFrame]:
    """The model, and the votes on every document: its columns ``keep``
    (default: the id) and those of ``VOTE``, written.  Labels with null ids or
    values, and those of held-out ids (crc32 of the id's text divisible by 5),
    are not used; without usable labels the fixed voters alone make the model."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic")))
    known = written(known, "labels")
    # bounded by FIT_ROWS, so it may be sent to every task
    sample = rows.join(F.broadcast(_sampled(known, FIT_ROWS)), "id").select("text", "toxic")
    vocabulary = Vocabulary.of(mine(written(without_copies(sample), "sample")))
    votes = written(_votes(docs, text_col, vocabulary, [id_col] if keep is None else keep), "votes")
    seen = votes.select(F.col(id_col).cast("long").alias("id"), F.col(VOTE[0]).alias("bits")).join(known, "id", "left").groupBy("bits").agg(
        F.sum(F.when(F.col("toxic").isNull(), 1).otherwise(0)).alias("free"),
        F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).collect()
    bits = np.array([r["bits"] for r in seen], dtype=np.int64)
    patterns = (bits[:, None] >> np.arange(len(VOTERS))) & 1
    post = label_model(patterns, np.array([r["free"] for r in seen], dtype=float),
                       np.array([[r["clean"], r["toxic"]] for r in seen], dtype=float).reshape(len(seen), 2))
    belief = dict(zip(bits.tolist(), post.tolist()))
    train = _sampled(votes.select(*VOTE), FIT_ROWS).collect()
    weights = fit_linear([tuple(r)[1:] for r in train], np.array([belief[r[0]] for r in train]), vocabulary.size)
    return Model(vocabulary, weights), votes


def score_votes(model: Model, votes: DataFrame) -> DataFrame:
    """``votes`` with the ``score`` of each row in place of its votes."""
    kept = [c for c in votes.columns if c not in VOTE]
    where = [votes.columns.index(c) for c in VOTE[1:]]
    schema = T.StructType([*(votes.schema[c] for c in kept), T.StructField("__kb_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            got = [model.score(h, c, s) for h, c, s in zip(*(batch.column(n).to_pylist() for n in where))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, pa.float64())], schema.names)

    return votes.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: ``id, score`` in 0..1.

    Only texts enter a score.  Null texts are empty; empty texts get the score
    of a text without findings.  Texts of any length are read whole.  Null and
    repeated ids are scored row by row; empty tables give no rows.  Other
    columns are not read.
    """
    scored = score_votes(*fit(docs.select(id_col, text_col), labels, id_col, text_col, label_col))
    return scored.select(F.col(id_col).cast("long").alias("id"), F.col("__kb_score").alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, all columns kept.

    Null texts are empty and stay, as clean texts do.  Texts are read once: the
    rows are written with their votes.  Null and repeated ids are judged row by
    row; an empty table gives no rows.  No column of ``docs`` may begin with
    ``__kb_``.
    """
    scored = score_votes(*fit(docs, labels, id_col, text_col, keep=docs.columns))
    return scored.where(F.col("__kb_score") < threshold).select(*docs.columns)
