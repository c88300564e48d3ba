"""DuckDB oracle SQL for the registered queries (same column names and types).

Floats are rounded to 6 digits on both sides where an operator computes
them.  The oracle is written independently of the Spark plan: nested loops
and a plain dynamic-programming LCS, no blocking except exact bounds.
"""

from __future__ import annotations

from kbspark.plans.oracle_views import norm, token_sort, with_views

def fuzzy_scores_sql(q: str, c: str, qid: str, cid: str, threshold: int = 90, prefix: str = "fz") -> str:
    """CTEs ``{prefix}_scores(qid, cid, match_score)``: exact token-sort ratio
    >= threshold for every pair of ``q(qid, qn)`` x ``c(cid, cn)`` (pairs
    with ``qn`` inside ``cn`` included, scored by the fuzzy rule only).

    Pruning uses exact bounds only: the length ratio and the character-count
    bound on the LCS; survivors get a full DP (one window pass per row)."""
    k = 2 * threshold - 1
    return f"""
{prefix}_qs AS (SELECT {qid}, {token_sort('qn')} AS s FROM {q}),
{prefix}_cs AS (SELECT {cid}, {token_sort('cn')} AS s FROM {c}),
{prefix}_eq AS (SELECT a.{qid}, b.{cid}, 100 AS match_score FROM {prefix}_qs a JOIN {prefix}_cs b ON a.s = b.s),
{prefix}_pairs AS (SELECT row_number() OVER () AS pid, {qid}, {cid},
     CASE WHEN length(x.s) <= length(y.s) THEN x.s ELSE y.s END AS a,
     CASE WHEN length(x.s) <= length(y.s) THEN y.s ELSE x.s END AS b
   FROM {prefix}_qs x JOIN {prefix}_cs y ON length(x.s) > 0 AND length(y.s) > 0 AND x.s <> y.s
    AND 400 * least(length(x.s), length(y.s)) >= {k} * (length(x.s) + length(y.s))),
{prefix}_chars AS (SELECT pid, 'a' AS side, unnest(string_split(a, '')) AS ch FROM {prefix}_pairs
   UNION ALL SELECT pid, 'b', unnest(string_split(b, '')) FROM {prefix}_pairs),
{prefix}_bag AS (SELECT pid, sum(least(na, nb)) AS ub FROM (SELECT pid, ch, count(*) FILTER (WHERE side = 'a') AS na,
   count(*) FILTER (WHERE side = 'b') AS nb FROM {prefix}_chars GROUP BY pid, ch) GROUP BY pid),
{prefix}_cand AS (SELECT p.* FROM {prefix}_pairs p JOIN {prefix}_bag g ON g.pid = p.pid
   WHERE 400 * g.ub >= {k} * (length(p.a) + length(p.b))),
{prefix}_dp(pid, i, j, v) AS (
  SELECT pid, 0, j, 0 FROM {prefix}_cand, LATERAL (SELECT unnest(range(0, length(b) + 1)) AS j)
  UNION ALL
  SELECT pid, i + 1, j, max(t) OVER (PARTITION BY pid ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  FROM (SELECT d.pid, d.i, d.j,
          CASE WHEN d.j = 0 THEN 0 ELSE greatest(d.v, lag(d.v) OVER (PARTITION BY d.pid ORDER BY d.j)
               + CASE WHEN substr(p.a, d.i + 1, 1) = substr(p.b, d.j, 1) THEN 1 ELSE 0 END) END AS t
        FROM {prefix}_dp d JOIN {prefix}_cand p ON p.pid = d.pid WHERE d.i < length(p.a)) s),
{prefix}_lcs AS (SELECT p.{qid}, p.{cid}, CAST(round_even(100.0 * ((2.0 * d.v) / (length(p.a) + length(p.b))), 0) AS INTEGER)
     AS match_score FROM {prefix}_dp d JOIN {prefix}_cand p ON p.pid = d.pid WHERE d.i = length(p.a) AND d.j = length(p.b)),
{prefix}_scores AS (SELECT * FROM {prefix}_eq UNION ALL SELECT * FROM {prefix}_lcs WHERE match_score >= {threshold})"""


def match_scores_sql(q_view: str, q_id: str, q_text: str, c_view: str, c_id: str, c_text: str,
                     threshold: int = 90) -> str:
    """CTE ``scores(question_id, image_row, match_score)`` (M2 at a threshold)."""
    return f"""
mq AS (SELECT {q_id} AS question_id, {norm(q_text)} AS qn FROM {q_view} WHERE {q_text} IS NOT NULL),
mc AS (SELECT {c_id} AS image_row, {norm(c_text)} AS cn FROM {c_view} WHERE {c_text} IS NOT NULL),
msub AS (SELECT question_id, image_row, 100 AS match_score FROM mq JOIN mc ON contains(mc.cn, mq.qn)),
{fuzzy_scores_sql('mq', 'mc', 'question_id', 'image_row', threshold)},
scores AS (SELECT question_id, image_row, max(match_score) AS match_score
   FROM (SELECT * FROM msub UNION ALL SELECT * FROM fz_scores) GROUP BY question_id, image_row
   HAVING max(match_score) >= {threshold})"""


def topk_sql(k: int = 5) -> str:
    return f"""ranked AS (SELECT question_id, image_row, match_score,
   CAST(row_number() OVER (PARTITION BY question_id ORDER BY match_score DESC, image_row) AS INTEGER) AS rank FROM scores),
top AS (SELECT * FROM ranked WHERE rank <= {k})"""


