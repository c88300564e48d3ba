"""Checked queries for matching and search (M1-M9)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kbspark.operators import match
from kbspark.plans.oracle import fuzzy_scores_sql, match_scores_sql, topk_sql
from kbspark.plans.oracle_views import norm, with_views
from kbspark.plans.registry import register
from kbspark.sources.fixtures import Fixtures

_SCORES = match_scores_sql("fx_questions", "question_id", "question", "fx_catalog", "image_row", "description")


@register("m2_match_score", with_views("fx_questions", "fx_catalog", extra=_SCORES, recursive=True) + """
SELECT s.question_id, s.image_row, s.match_score, c.filename FROM scores s JOIN fx_catalog c ON c.image_row = s.image_row""")
def m2_match_score(fx: Fixtures) -> DataFrame:
    """M2: every (question, catalogue row) pair scoring >= 90."""
    s = match.match_scores(fx.questions(), fx.catalog())
    return s.join(fx.catalog().select("image_row", "filename"), "image_row")


@register("m4_topk", with_views("fx_questions", "fx_catalog", extra=_SCORES + ",\n" + topk_sql(), recursive=True) + """
SELECT t.question_id, t.image_row, t.match_score, t.rank, c.filename FROM top t JOIN fx_catalog c ON c.image_row = t.image_row""")
def m4_topk(fx: Fixtures) -> DataFrame:
    """M4: best five catalogue rows per question, score >= 90, ties in catalogue order."""
    top = match.top_matches(fx.questions(), fx.catalog())
    return top.join(fx.catalog().select("image_row", "filename"), "image_row")


@register("m4_topk_documents", "WITH RECURSIVE " + match_scores_sql(
    "benchmark", "item_id", "text", "documents", "doc_id", "text").lstrip() + ",\n" + topk_sql() + """
SELECT question_id, image_row AS doc_id, match_score, rank FROM top""")
def m4_topk_documents(fx: Fixtures) -> DataFrame:
    """Flagship: best five documents for each benchmark passage (score >= 90)."""
    return match.top_matches(fx.table("benchmark"), fx.table("documents"), q_id="item_id", q_text="text",
                             c_id="doc_id", c_text="text").withColumnRenamed("item_id", "question_id")


# ---------------------------------------------------------------- M1 / M3 / M5
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("m1_like_search", with_views("fx_questions", "fx_catalog", extra=f"""
h AS (SELECT q.question_id, c.image_row, c.filename FROM fx_questions q JOIN fx_catalog c
  ON c.description IS NOT NULL AND {_LOWER.format(x='c.description')} LIKE '%' || {_LOWER.format(x='q.question')} || '%')""") + """
SELECT question_id, image_row, filename,
  printf('image_%04d', row_number() OVER (PARTITION BY question_id ORDER BY image_row)) AS image_key FROM h""")
def m1_like_search(fx: Fixtures) -> DataFrame:
    """M1: catalogue descriptions LIKE '%question%' (SQLite semantics), hits
    numbered ``image_0001``… in catalogue order."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    hits = match.like_matches(fx.questions(), fx.catalog())
    w = Window.partitionBy("question_id").orderBy("image_row")
    return (hits.join(fx.catalog().select("image_row", "filename"), "image_row")
                .withColumn("image_key", F.format_string("image_%04d", F.row_number().over(w))))


_NAMES_SQL = """names AS (SELECT DISTINCT p_name AS qn FROM part),
na AS (SELECT qn AS name_a, qn FROM names), nb AS (SELECT qn AS name_b, qn AS cn FROM names)"""


@register("m3_token_sort_pairs", "WITH RECURSIVE " + _NAMES_SQL + ",\n"
          + fuzzy_scores_sql("na", "nb", "name_a", "name_b", 90).lstrip() + """
SELECT name_a, name_b, match_score FROM fz_scores WHERE name_a < name_b""")
def m3_token_sort_pairs(fx: Fixtures) -> DataFrame:
    """M3: pairs of distinct part names with token-sort ratio >= 90 (fuzzy self-join)."""
    from pyspark.sql import functions as F
    names = fx.table("part").select("p_name").distinct()
    q = names.select(F.col("p_name").alias("_qk"), F.col("p_name").alias("_qn"))
    c = names.select(F.col("p_name").alias("name_b"), F.col("p_name").alias("_cn"))
    s = match.fuzzy_pairs(q, c, "name_b", "_qn", "_cn", match.FUZZY_THRESHOLD)
    return s.where(F.col("_qk") < F.col("name_b")).select(F.col("_qk").alias("name_a"), "name_b", "match_score")


@register("m5_hit_map", with_views("fx_questions", "fx_catalog", extra=_SCORES + ",\n" + topk_sql(), recursive=True) + """
SELECT q.question_id, printf('image_%04d', t.rank) AS image_key, '/api/images/' || c.filename AS url, t.match_score
FROM fx_questions q LEFT JOIN top t ON t.question_id = q.question_id LEFT JOIN fx_catalog c ON c.image_row = t.image_row""")
def m5_hit_map(fx: Fixtures) -> DataFrame:
    """M5: the hit map of each question, its entries read back: keys
    ``image_0001``… with URL and score; the empty map gives one NULL-keyed row."""
    from pyspark.sql import functions as F
    top = match.top_matches(fx.questions(), fx.catalog()).join(fx.catalog().select("image_row", "filename"), "image_row")
    maps = match.hit_map(top, fx.questions())
    return (maps.select("question_id", F.explode_outer("images").alias("image_key", "hit"))
            .select("question_id", "image_key", "hit.url", "hit.match_score"))


# ---------------------------------------------------------------- M6 - M9
def _cos_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL "
            f"WHEN list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) = 0 OR list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]) = 0 THEN 0.0 "
            f"ELSE list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) "
            f"* sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))) END")


@register("m6_cosine", with_views("fx_vec_catalog") + f"""
SELECT image_row, round({_cos_sql('title_vec', 'desc_vec')}, 6) AS cosine FROM fx_vec_catalog""")
def m6_cosine(fx: Fixtures) -> DataFrame:
    """M6: cosine of each catalogue row's title and description vectors."""
    from pyspark.sql import functions as F

    from kbspark.operators.vectors import cosine
    c = fx.vec_catalog()
    return c.select("image_row", F.round(cosine("title_vec", "desc_vec"), 6).alias("cosine"))


_VEC_SCORES = f"""vs AS (SELECT q.question_id, c.image_row,
  greatest({_cos_sql('q.q_vec', 'c.title_vec')}, {_cos_sql('q.q_vec', 'c.desc_vec')}) AS score
  FROM fx_vec_questions q, fx_vec_catalog c),
vr AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, image_row) AS INTEGER) AS rank
  FROM vs WHERE score > 0.6)"""


@register("m7_best_match", with_views("fx_vec_catalog", "fx_vec_questions", extra=_VEC_SCORES) + """
SELECT q.question_id, vr.image_row, round(vr.score, 6) AS score FROM fx_vec_questions q
LEFT JOIN vr ON vr.question_id = q.question_id AND vr.rank = 1""")
def m7_best_match(fx: Fixtures) -> DataFrame:
    """M7: best catalogue row per question vector (cosine > 0.60, first maximal row)."""
    from pyspark.sql import functions as F

    from kbspark.operators.vectors import best_match
    b = best_match(fx.vec_questions(), fx.vec_catalog())
    return b.select("question_id", "image_row", F.round("score", 6).alias("score"))


@register("m8_nearest", with_views("fx_vec_catalog", "fx_vec_questions", extra=_VEC_SCORES) + """
SELECT question_id, image_row, round(score, 6) AS score, rank FROM vr WHERE rank <= 5""")
def m8_nearest(fx: Fixtures) -> DataFrame:
    """M8: five nearest catalogue rows per question vector above the threshold."""
    from pyspark.sql import functions as F

    from kbspark.operators.vectors import nearest
    n = nearest(fx.vec_questions(), fx.vec_catalog())
    return n.select("question_id", "image_row", F.round("score", 6).alias("score"), "rank")


@register("m8_pivot_cells", with_views("fx_vec_catalog", "fx_vec_questions", extra=_VEC_SCORES) + """
SELECT question_id, image_row, round(score, 6) AS score, rank FROM vr WHERE rank <= 5""")
def m8_pivot_cells(fx: Fixtures) -> DataFrame:
    """M8 over a catalogue stored by pivot cells (written once, then searched)."""
    from pyspark.sql import functions as F

    from kbspark.operators.joins import materialize
    from kbspark.operators.vector_scan import pivot_cells
    from kbspark.operators.vectors import nearest
    stored = materialize(pivot_cells(fx.vec_catalog(), "image_row", "title_vec"))
    n = nearest(fx.vec_questions(), stored)
    return n.select("question_id", "image_row", F.round("score", 6).alias("score"), "rank")


def lsh_recall(fx: Fixtures) -> DataFrame:
    """One row ``n_exact, n_found``: hits of the exact search over the whole
    tables, and those of them that hashing finds with the same score."""
    from pyspark.sql import functions as F

    from kbspark.operators.vector_lsh import nearest_lsh
    from kbspark.operators.vectors import nearest
    exact = nearest(fx.vec_questions(), fx.vec_catalog()).select("question_id", "image_row", F.round("score", 6).alias("score"))
    found = nearest_lsh(fx.vec_questions(), fx.vec_catalog()).select("question_id", "image_row", F.round("score", 6).alias("score"), F.lit(1).alias("hit"))
    return exact.join(found, ["question_id", "image_row", "score"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))


@register("m8_lsh_recall", with_views("fx_vec_catalog", "fx_vec_questions", extra=_VEC_SCORES) + """
SELECT count(*) AS n_exact, true AS recall_reached FROM vr WHERE rank <= 5""")
def m8_lsh_recall(fx: Fixtures) -> DataFrame:
    """M8's candidate step by hashing, held against the exact search over the
    whole tables: hits, and whether at least 0.9 of them were found."""
    from pyspark.sql import functions as F
    return lsh_recall(fx).select("n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("recall_reached"))


def _tok_sql(x: str) -> str:
    return f"string_split({norm(x)}, ' ')"


def m9_ctes() -> str:
    """CTEs ending in ``m9(question_id, doc_id, score)``: TF-IDF best match (> 0.6)."""
    return f"""d AS (SELECT doc_id, {_tok_sql('text')} AS toks FROM documents),
q AS (SELECT item_id AS question_id, {_tok_sql('text')} AS toks FROM benchmark),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
dtf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM d) WHERE token <> '' GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM dtf GROUP BY token),
qtf AS (SELECT question_id, token, count(*) AS tf FROM (SELECT question_id, unnest(toks) AS token FROM q) WHERE token <> ''
  GROUP BY ALL),
dw0 AS (SELECT doc_id, token, tf * (ln((1 + n.n) / (1 + df.df)) + 1) AS w FROM dtf JOIN df USING (token), n),
dw AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw0),
qw0 AS (SELECT question_id, token, tf * (ln((1 + n.n) / (1 + coalesce(df.df, 0))) + 1) AS w FROM qtf LEFT JOIN df USING (token), n),
qw AS (SELECT question_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY question_id)) AS w FROM qw0),
s AS (SELECT question_id, doc_id, round(sum(qw.w * dw.w), 9) AS score FROM qw JOIN dw USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rk FROM s WHERE score > 0.6),
m9 AS (SELECT b.item_id AS question_id, r.doc_id, r.score FROM benchmark b LEFT JOIN r ON r.question_id = b.item_id AND r.rk = 1)"""


@register("m9_tfidf_best", "WITH " + m9_ctes() + "\nSELECT question_id, doc_id, round(score, 6) AS score FROM m9")
def m9_tfidf_best(fx: Fixtures) -> DataFrame:
    """M9: TF-IDF cosine best document per benchmark passage (> 0.60)."""
    from pyspark.sql import functions as F
    b = tfidf_best(fx)
    return b.select("question_id", "doc_id", F.round("score", 6).alias("score"))


def tfidf_best(fx: Fixtures) -> DataFrame:
    """(question_id, doc_id, score): M9 over benchmark x documents."""
    from pyspark.sql import functions as F

    from kbspark.functions.text import normalize_text
    from kbspark.operators.vectors import tfidf_best_match
    q = fx.table("benchmark").select(F.col("item_id").alias("question_id"),
                                     F.split(normalize_text("text"), " ").alias("toks"))
    d = fx.table("documents").select("doc_id", F.split(normalize_text("text"), " ").alias("toks"))
    return tfidf_best_match(q, d, q_id="question_id", q_tokens="toks", d_id="doc_id", d_tokens="toks")
