"""Matching and search (M1-M5): questions against a catalogue.

Every theta join here is planned as an equi-join on a lossless blocking key
and then verified exactly:

* containment (M2's substring branch, M1's LIKE): the literal needles of a
  bounded question set make one multi-pattern automaton per block, which reads
  each text once (``needles.py``).  Beyond that bound the catalogue is joined: a
  literal needle that is contained in a text contains, between two separators,
  only whole tokens of that text.  A needle with such an inner token joins on
  its rarest one (document frequency counted for question tokens only); a
  needle without one joins the catalogue vocabulary on its rarest character
  gram and then the rows holding a matching token.
* fuzzy (M3 at a threshold): a passing pair has length ratio >= r/(2-r) with
  r = (t - 0.5)/100, so it lies in the same or a neighbouring log-length
  bucket; an exact length test and a bound from letter counts follow in the
  join, then the LCS of whole Arrow batches.

Questions are deduplicated by their normalised text first.  The question
side is broadcast only when its measured size is inside the bound: then the
catalogue is read once, its tokens probe the broadcast table and the exact
check runs in the same pipeline with no shuffle of the catalogue.  Beyond the
bound the joins shuffle (AQE splits skewed keys; length buckets of the fuzzy
join are cut into parts by their measured size).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions.fuzzy import ratio_at_least_udf, token_sort_key
from kbspark.functions.text import explode_computed, normalize_text
from kbspark.operators import needles as nd
from kbspark.operators.joins import materialize, maybe_broadcast

# Fixed defaults of the reference: fuzzy threshold, maximum results, cosine
# threshold; URL prefix of a hit.
FUZZY_THRESHOLD = 90
MAX_RESULTS = 5
COSINE_THRESHOLD = 0.60
HIT_URL_PREFIX = "/api/images/"

GRAM = 3
BUCKET_ROWS = 4096  # catalogue rows of one part of a length bucket, about
LETTERS = "aeionrstlducm"  # letters counted apart: common ones tell texts apart best
EMPTY_BUCKET = -(1 << 40)
_QK = "_qk"


def _grams(s: Column, k: int) -> Column:
    """All substrings of length ``k`` (the string itself when shorter)."""
    n = F.length(s)
    return F.when(n <= k, F.array(s)).otherwise(
        F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(s, i, k)))


def _tokens(c: Column, sep: str) -> Column:
    return F.array_remove(F.array_distinct(F.split(c, sep)), "")


def _inner_runs(needle: Column, sep: str) -> Column:
    parts = F.split(needle, sep)
    n = F.size(parts)
    return F.filter(F.when(n >= 3, F.slice(parts, 2, n - 2)).otherwise(F.array().cast("array<string>")),
                    lambda t: t != "")


def _longest_run(needle: Column, sep: str) -> Column:
    parts = F.filter(F.split(needle, sep), lambda t: t != "")
    return F.aggregate(parts, F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))


def containment_candidates(qa: DataFrame, cat: DataFrame, c_id: str, hay: str, sep: str,
                           verify, small: bool, exact: bool = False) -> DataFrame:
    """Rows (_qk, c_id) where ``verify`` holds; ``exact`` says that containing
    the (one) needle is all there is to verify.

    ``qa``: (_qk, needles array<string>, plus the columns ``verify`` reads),
    already materialised and small enough to profile.  ``cat``: (c_id, hay).
    ``verify(hay_col)`` is the exact predicate.  A question with no literal
    character (``every``) is a candidate of every row: it anchors on the empty
    token, which each catalogue row carries once."""
    if small:
        # the longest literal of each question, found by the automaton
        longest = F.aggregate("needles", F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))
        asked = qa.withColumn("_needle", longest)
        blocks = nd.needle_blocks(asked, "_needle")
        if blocks <= nd.MAX_BLOCKS:
            found = nd.texts_with_needles(asked, "_needle", cat, c_id, hay, blocks, keep_text=not exact)
            hits = found.join(F.broadcast(asked.drop("needles")), "_needle")
            return (hits if exact else hits.where(verify(F.col(hay)))).select(_QK, c_id)
    qa = qa.withColumn("_inner", F.array_distinct(F.flatten(F.transform("needles", lambda s: _inner_runs(s, sep)))))
    qa = qa.withColumn("_word", F.aggregate(F.transform("needles", lambda s: _longest_run(s, sep)), F.lit(""),
                                            lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc)))
    qa = qa.withColumn("_kind", F.when(F.size("_inner") > 0, "inner").when(F.col("_word") != "", "word")
                                 .otherwise("every"))
    prof = qa.groupBy("_kind").agg(F.collect_set(F.least(F.length("_word"), F.lit(GRAM))).alias("ks")).collect()
    kinds = {r["_kind"]: sorted(r["ks"]) for r in prof}
    ctok = (cat.select(c_id, explode_computed(_tokens(F.col(hay), sep)).alias("token"))
               .where(F.col("token").isNotNull()))

    def bc(df):
        return F.broadcast(df) if small else df

    parts = []
    if "inner" in kinds:
        inner = qa.where(F.col("_kind") == "inner").select(_QK, F.explode("_inner").alias("token"))
        tok_df = (ctok.join(bc(inner.select("token").distinct()), "token", "left_semi")
                      .groupBy("token").agg(F.count(F.lit(1)).alias("df")))
        parts.append(inner.join(tok_df, "token", "left").groupBy(_QK)
                          .agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), F.col("token"))).alias("token")))
    if "word" in kinds:
        short = qa.where(F.col("_kind") == "word").select(_QK, "_word")
        short = short.withColumn("k", F.least(F.length("_word"), F.lit(GRAM)))
        qgrams = short.select(_QK, "_word", "k", F.explode(F.array_distinct(_grams(F.col("_word"), GRAM))).alias("gram"))
        gram_keys = qgrams.select("k", "gram").distinct()
        vocab = ctok.select("token").distinct()
        vgrams = None
        for k in kinds["word"]:
            g = (vocab.where(F.length("token") >= k)
                      .select("token", F.lit(k).alias("k"),
                              F.explode(F.array_distinct(_grams(F.col("token"), k))).alias("gram")))
            vgrams = g if vgrams is None else vgrams.unionByName(g)
        vgrams = vgrams.join(bc(gram_keys), ["k", "gram"], "left_semi")
        gram_df = vgrams.groupBy("k", "gram").agg(F.count(F.lit(1)).alias("df"))
        rare = (qgrams.join(gram_df, ["k", "gram"], "left").groupBy(_QK, "_word", "k")
                      .agg(F.min_by("gram", F.struct(F.coalesce("df", F.lit(0)), F.col("gram"))).alias("gram")))
        parts.append(vgrams.join(bc(rare), ["k", "gram"])
                           .where(F.col("token").contains(F.col("_word"))).select(_QK, "token"))
    if "every" in kinds:
        parts.append(qa.where(F.col("_kind") == "every").select(_QK, F.lit("").alias("token")))
    if not parts:
        return qa.select(_QK, F.lit(None).cast(cat.schema[c_id].dataType).alias(c_id)).where(F.lit(False))

    anchors = parts[0]
    for p in parts[1:]:
        anchors = anchors.unionByName(p)
    payload = qa.drop("_inner", "_word", "_kind", "needles")
    row_tokens = _tokens(F.col(hay), sep)
    if "every" in kinds:
        row_tokens = F.array_union(row_tokens, F.array(F.lit("")))

    # vocabulary hits and repeated question texts are not bounded by the
    # question size: measure the frame that would be sent
    side = materialize(anchors.join(bc(payload), _QK))
    side, small = maybe_broadcast(side)
    if small:
        probe = cat.select(c_id, hay, explode_computed(row_tokens).alias("token")).where(F.col("token").isNotNull())
        cand = probe.join(side, "token").where(verify(F.col(hay))).select(_QK, c_id)
    else:
        ctok_all = cat.select(c_id, explode_computed(row_tokens).alias("token")).where(F.col("token").isNotNull())
        pairs = ctok_all.join(side.select(_QK, "token"), "token").select(_QK, c_id).distinct()
        cand = (pairs.join(cat.select(c_id, hay), c_id).join(payload, _QK)
                     .where(verify(F.col(hay))).select(_QK, c_id))
    return cand.distinct()


@dataclass(frozen=True)
class Prepared:
    """A catalogue made ready for any number of question sets: ``texts`` with
    the normalised text ``_cn``, and ``keys`` with what fuzzy matching needs."""

    texts: DataFrame
    keys: DataFrame


def fuzzy_keys(cat: DataFrame, c_id: str, c_norm: str) -> DataFrame:
    """(c_id, cs, lc, hc0...): sorted tokens, their length and letter counts.
    The length is non-nullable on purpose, see ``fuzzy_pairs``."""
    cs = cat.select(c_id, token_sort_key(F.col(c_norm)).alias("cs")).withColumn("lc", F.coalesce(F.length("cs"), F.lit(0)))
    return cs.select("*", *[n.alias(f"hc{i}") for i, n in enumerate(letter_counts(F.col("cs")))])


def prepare(catalog: DataFrame, c_id: str = "image_row", c_text: str = "description") -> Prepared:
    """Normalise and tokenise a catalogue once, into written tables that later
    question sets read (streams: before the first micro-batch)."""
    texts = materialize(catalog.where(F.col(c_text).isNotNull()).select(c_id, _non_null(normalize_text(c_text)).alias("_cn")))
    return Prepared(texts, materialize(fuzzy_keys(texts, c_id, "_cn")))


def fuzzy_pairs(q: DataFrame, cat: DataFrame, c_id: str, q_norm: str, c_norm: str,
                threshold: int, keys: DataFrame | None = None) -> DataFrame:
    """(_qk, c_id, match_score) with token-sort ratio >= threshold (exact).
    ``keys`` are the catalogue's ``fuzzy_keys`` where they are at hand.

    Two exact bounds are checked inside the join, so that only near hits reach
    Python: the lengths' ratio, and the characters both strings can share at
    most, from counts per letter taken once per string."""
    r = (threshold - 0.5) / 100.0
    if r <= 0:
        raise ValueError("fuzzy blocking needs a positive threshold")
    rho = min(r / (2.0 - r), 1.0)
    width = math.log(1.0 / rho) if rho < 1.0 else 1.0
    # lengths and buckets are non-nullable on purpose: a nullable join key
    # makes Spark infer an IS NOT NULL filter and push it below the scan-side
    # exchange, which would evaluate the token-sort chain twice per row
    qs = q.select(_QK, token_sort_key(F.col(q_norm)).alias("qs")).withColumn("lq", F.coalesce(F.length("qs"), F.lit(0)))
    cs = fuzzy_keys(cat, c_id, c_norm) if keys is None else keys

    def bucket(c: Column) -> Column:
        # an empty processed string gets its own bucket: it meets only empty
        # strings (equal, score 100); every other pair with an empty side is 0
        return F.coalesce(F.when(c == 0, F.lit(EMPTY_BUCKET)).otherwise(
            F.floor(F.log(c.cast("double")) / F.lit(width)).cast("long")), F.lit(EMPTY_BUCKET))

    qs = qs.select("*", *[n.alias(f"hq{i}") for i, n in enumerate(letter_counts(F.col("qs")))])
    counted = range(len(LETTERS) + 1)
    qb = (qs.withColumn("b0", bucket(F.col("lq")))
            .select(_QK, "qs", "lq", *[f"hq{i}" for i in counted], F.explode(
                F.when(F.col("lq") == 0, F.array(F.col("b0")))
                 .otherwise(F.array(F.col("b0") - 1, F.col("b0"), F.col("b0") + 1))).alias("bucket")))
    cb = cs.withColumn("bucket", bucket(F.col("lc")))
    qb = materialize(qb)
    qb_side, small = maybe_broadcast(qb)
    on = ["bucket"]
    if not small:
        # texts of one kind share a few buckets: each is cut into as many parts
        # as its rows need (at most one row per length bucket here: broadcast)
        cb = materialize(cb)
        parts = cb.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_ROWS)).cast("int").alias("parts"))
        parts = F.broadcast(materialize(parts))
        cb = cb.join(parts, "bucket").withColumn("salt", F.pmod(F.xxhash64(F.col(c_id)), F.col("parts")).cast("int")).drop("parts")
        qb_side = (qb.join(parts, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
        on = ["bucket", "salt"]
    need = F.lit(2 * threshold - 1) * (F.col("lq") + F.col("lc"))
    shared = sum((F.least(f"hq{i}", f"hc{i}") for i in counted), F.lit(0))
    pairs = cb.join(qb_side, on).where((F.lit(400) * F.least("lq", "lc") >= need) & (F.lit(400) * shared >= need))
    return (pairs.select(_QK, c_id, ratio_at_least_udf(threshold)(F.col("qs"), F.col("cs")).alias("match_score"))
                 .where(F.col("match_score") >= threshold))


def letter_counts(text: Column) -> list[Column]:
    """How often each of ``LETTERS`` occurs, and all other characters together."""
    n = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS]
    return [*n, F.length(text) - sum(n, F.lit(0))]


def _non_null(c: Column) -> Column:
    """A derived text column of rows already filtered to non-NULL input, typed
    non-nullable: otherwise Spark infers ``IS NOT NULL`` on it from the joins
    and pushes that below the scan-side exchange, running the regex twice."""
    return F.coalesce(c, F.lit(""))


def _question_keys(questions: DataFrame, q_id: str, q_text: str):
    """(q_id, _qk, _qn): questions keyed by a representative id per distinct
    normalised text; returns (mapping, distinct keys, small?)."""
    qn = questions.where(F.col(q_text).isNotNull()).select(q_id, _non_null(normalize_text(q_text)).alias("_qn"))
    reps = qn.groupBy("_qn").agg(F.min(q_id).alias(_QK))
    reps = materialize(reps)
    _side, small = maybe_broadcast(reps)
    mapping = qn.join(F.broadcast(reps) if small else reps, "_qn").select(q_id, _QK)
    return mapping, reps, small


def _scores_by_key(reps: DataFrame, catalog: DataFrame | Prepared, c_id: str, c_text: str, threshold: int, small: bool) -> DataFrame:
    if isinstance(catalog, Prepared):
        cat, keys = catalog.texts, catalog.keys
    else:  # read by the substring and the fuzzy branch, several times each
        cat, keys = materialize(catalog.where(F.col(c_text).isNotNull()).select(c_id, _non_null(normalize_text(c_text)).alias("_cn"))), None
    qa = reps.select(_QK, "_qn", F.array("_qn").alias("needles"))
    sub = containment_candidates(qa, cat, c_id, "_cn", " ", lambda hay: hay.contains(F.col("_qn")), small, exact=True)
    sub = sub.withColumn("match_score", F.lit(100))
    fz = fuzzy_pairs(reps, cat, c_id, "_qn", "_cn", threshold, keys)
    return (sub.unionByName(fz).groupBy(_QK, c_id).agg(F.max("match_score").alias("match_score"))
               .where(F.col("match_score") >= threshold))


def match_scores(questions: DataFrame, catalog: DataFrame | Prepared, *, q_id: str = "question_id", q_text: str = "question",
                 c_id: str = "image_row", c_text: str = "description", threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """M2 at a threshold: (q_id, c_id, match_score) for every pair scoring
    >= threshold; NULL descriptions are skipped."""
    mapping, reps, small = _question_keys(questions, q_id, q_text)
    s = _scores_by_key(reps, catalog, c_id, c_text, threshold, small)
    return mapping.join(s, _QK).select(q_id, c_id, "match_score")


def top_matches(questions: DataFrame, catalog: DataFrame | Prepared, *, q_id: str = "question_id", q_text: str = "question",
                c_id: str = "image_row", c_text: str = "description", threshold: int = FUZZY_THRESHOLD,
                k: int = MAX_RESULTS) -> DataFrame:
    """M4: best k per question (score desc, ties in catalogue order), ``rank`` 1..k."""
    mapping, reps, small = _question_keys(questions, q_id, q_text)
    s = _scores_by_key(reps, catalog, c_id, c_text, threshold, small)
    top = top_k(s, q_id=_QK, order_id=c_id, k=k)
    return mapping.join(top, _QK).select(q_id, c_id, "match_score", "rank")


def top_k(scored: DataFrame, *, q_id: str = "question_id", order_id: str = "image_row",
          k: int = MAX_RESULTS) -> DataFrame:
    """``row_number() <= k`` per question; planned with a partial
    per-partition group limit ahead of the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(q_id).orderBy(F.col("match_score").desc(), F.col(order_id).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def like_matches(questions: DataFrame, catalog: DataFrame, *, q_id: str = "question_id", q_text: str = "question",
                 c_id: str = "image_row", c_text: str = "description", literal: bool = False) -> DataFrame:
    """M1: ``description LIKE '%q%'`` with SQLite semantics: ASCII-only case
    folding, ``%``/``_`` in the question stay wildcards, backslash is literal.
    With ``literal`` they are plain characters: the folded question must be
    contained as it stands."""
    def fold(c):
        return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    q = questions.where(F.col(q_text).isNotNull()).select(
        F.col(q_id).alias(_QK),
        F.concat(F.lit("%"), F.replace(fold(F.col(q_text)), F.lit("\\"), F.lit("\\\\")), F.lit("%")).alias("_pat"),
        fold(F.col(q_text)).alias("_lit"),
        (F.array(fold(F.col(q_text))) if literal else F.split(fold(F.col(q_text)), "[%_]")).alias("needles"))
    q = materialize(q)
    _s, small = maybe_broadcast(q)
    cat = catalog.where(F.col(c_text).isNotNull()).select(c_id, _non_null(fold(F.col(c_text))).alias("_hay"))
    hits = containment_candidates(q, cat, c_id, "_hay", r"[^\p{L}\p{N}]+",
                                  lambda hay: hay.contains(F.col("_lit")) if literal else F.expr("_hay LIKE _pat"), small)
    return hits.select(F.col(_QK).alias(q_id), c_id)


def hit_rows(top: DataFrame, questions: DataFrame, *, q_id: str = "question_id",
             filename: str = "filename", url_prefix: str = HIT_URL_PREFIX) -> DataFrame:
    """M5 in long form: one row per hit keyed ``image_0001``...; a question
    with no hit keeps one row with NULL key (the empty map)."""
    hits = top.select(q_id, F.format_string("image_%04d", F.col("rank")).alias("image_key"),
                      F.concat(F.lit(url_prefix), F.col(filename)).alias("url"), "match_score")
    return questions.select(q_id).join(hits, q_id, "left")


def hit_map(top: DataFrame, questions: DataFrame, *, q_id: str = "question_id",
            filename: str = "filename", url_prefix: str = HIT_URL_PREFIX) -> DataFrame:
    """M5 as a keyed map ``{image_0001: {url, match_score}}``; empty map when none."""
    entries = top.groupBy(q_id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.format_string("image_%04d", F.col("rank")).alias("key"),
        F.struct(F.concat(F.lit(url_prefix), F.col(filename)).alias("url"), F.col("match_score")).alias("value"))))
    ).alias("images"))
    mt = entries.schema["images"].dataType
    return (questions.select(q_id).join(entries, q_id, "left")
            .select(q_id, F.coalesce(F.col("images"), F.create_map().cast(mt)).alias("images")))
