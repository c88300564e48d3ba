"""Checked queries for threads and replies (T1-T10) and quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators import evaluate as ev
from kbspark.operators import threads as th
from kbspark.plans.matching import m9_ctes, tfidf_best
from kbspark.plans.oracle_views import with_views
from kbspark.plans.registry import register
from kbspark.plans.text_functions import _F7_SQL, IMAGE_BASE_URL, registry_lines
from kbspark.sources.fixtures import Fixtures

# Instruction text of a seeded thread (a deployment parameter).
SEED_INSTRUCTIONS = "Responda sempre em português do Brasil, usando apenas o manual."


def _msgs(fx: Fixtures) -> DataFrame:
    m = fx.messages()
    return m.withColumn("id", F.concat(F.lit("msg_"), F.col("thread_id").cast("string"), F.lit("_"), F.col("seq").cast("string")))


_REG_SQL = """reg AS (SELECT id AS line_no, concat('"assistantName": "', name, '",  "assistantID": ', assistant_key) AS line
  FROM fx_assistants),
regp AS (SELECT line_no, regexp_extract(line, '"assistantName": "([^"]*)"', 1) AS assistant_name,
  nullif(regexp_extract(line, '"assistantName": "[^"]*".*?"assistantID": (asst_\\w+)', 1), '') AS assistant_key FROM reg),
regf AS (SELECT assistant_name, arg_min(assistant_key, line_no) AS assistant_key FROM regp WHERE assistant_key IS NOT NULL
  GROUP BY assistant_name)"""


@register("t1_route", with_views("fx_assistants", "fx_questions", extra=_REG_SQL + """,
rq AS (SELECT question_id, 'as_is' AS variant, assistant_name FROM fx_questions
  UNION ALL SELECT question_id, 'upper', upper(assistant_name) FROM fx_questions)""") + """
SELECT rq.question_id, rq.variant, regf.assistant_key FROM rq LEFT JOIN regf ON regf.assistant_name = rq.assistant_name""")
def t1_route(fx: Fixtures) -> DataFrame:
    """Each question routed by assistant name, as given and upper-cased (case-sensitive: no match)."""
    reg = th.registry(registry_lines(fx).withColumnRenamed("id", "line_no"))
    q = fx.questions()
    rq = (q.select("question_id", F.lit("as_is").alias("variant"), "assistant_name")
           .unionByName(q.select("question_id", F.lit("upper").alias("variant"), F.upper("assistant_name").alias("assistant_name"))))
    return th.route(rq, reg).select("question_id", "variant", "assistant_key")


@register("t2_seed_threads", with_views("fx_questions") + f"""
SELECT 'thread_' || substr(sha256(CAST(question_id AS VARCHAR)), 1, 24) AS thread_id, seq, role, content FROM (
  SELECT question_id, 0 AS seq, 'system' AS role, '{SEED_INSTRUCTIONS}' AS content FROM fx_questions
  UNION ALL SELECT question_id, 1, 'user', question FROM fx_questions)""")
def t2_seed_threads(fx: Fixtures) -> DataFrame:
    """A new thread per question: system instruction row, then the user message."""
    return th.seed_threads(fx.questions(), "question_id", "question", SEED_INSTRUCTIONS)


_LAST_SQL = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS rk
  FROM fx_messages) WHERE rk = 1)"""


@register("t3_latest_message", with_views("fx_messages", extra=_LAST_SQL) + "\nSELECT thread_id, seq, role, text FROM last")
def t3_latest_message(fx: Fixtures) -> DataFrame:
    """The newest message of every thread."""
    return th.latest_message(fx.messages(), ["role", "text"])


@register("t4_thread_json", with_views("fx_messages") + """
SELECT thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) - 1 AS INTEGER) AS pos, seq, role, text
FROM fx_messages""")
def t4_thread_json(fx: Fixtures) -> DataFrame:
    """T4: every thread as a JSON array newest first, read back element by element."""
    j = th.thread_json(fx.messages(), ["role", "text"])
    arr = F.from_json("messages_json", "array<struct<seq:bigint,role:string,text:string>>")
    return j.select("thread_id", F.posexplode(arr).alias("pos", "m")).select("thread_id", "pos", "m.seq", "m.role", "m.text")


@register("t5_reply_record", with_views("fx_messages", extra=_LAST_SQL + f""",
x AS (SELECT thread_id, seq, role, string_split(text, chr(10)) AS content, epoch(created_at)::BIGINT AS created_at,
  regexp_extract_all(text, '{_F7_SQL}') AS images FROM last)""") + """
SELECT thread_id, 'msg_' || CAST(thread_id AS VARCHAR) || '_' || CAST(seq AS VARCHAR) AS id, role, len(content)::INTEGER AS n_blocks,
  array_to_string(content, chr(31)) AS content, created_at, array_to_string(images, chr(31)) AS images, len(images) > 0 AS has_images FROM x""")
def t5_reply_record(fx: Fixtures) -> DataFrame:
    """T5: reply record of each thread's newest message, read back from its JSON."""
    last = th.latest_message(_msgs(fx), ["id", "role", "text", "created_at"])
    names = tx.extract_image_names("text")
    rec = th.reply_record(F.col("id"), F.col("role"), th.content_blocks(F.col("text")), F.col("created_at").cast("long"),
                          F.col("thread_id").cast("string"), names)
    js = F.to_json(rec)
    parsed = F.from_json(js, "id string, role string, content array<string>, created_at bigint, thread_id string, "
                             "images array<string>")
    return last.select("thread_id", parsed.alias("r"), js.alias("js")).select(
        "thread_id", "r.id", "r.role", F.size("r.content").alias("n_blocks"), F.array_join("r.content", "\x1f").alias("content"), "r.created_at",
        F.coalesce(F.array_join("r.images", "\x1f"), F.lit("")).alias("images"), F.col("js").contains('"images"').alias("has_images"))


@register("t6_first_block", with_views("fx_messages") + """
SELECT thread_id, seq, string_split(text, chr(10))[1] AS first_text FROM fx_messages""")
def t6_first_block(fx: Fixtures) -> DataFrame:
    """The first content block of every message."""
    m = fx.messages()
    return m.select("thread_id", "seq", th.first_block(th.content_blocks(F.col("text"))).alias("first_text"))


@register("t7_completed_gate", with_views("fx_messages", "fx_runs_status", extra=_LAST_SQL) + """
SELECT l.thread_id, CASE WHEN s.status = 'completed' THEN l.text END AS reply
FROM last l LEFT JOIN fx_runs_status s ON s.thread_id = l.thread_id""")
def t7_completed_gate(fx: Fixtures) -> DataFrame:
    """Each thread's newest message, released only when its run completed."""
    last = th.latest_message(fx.messages(), ["text"])
    return th.completed_gate(last, fx.runs_status(), F.col("text")).select("thread_id", "reply")


@register("t8_postprocess", with_views("fx_messages", "fx_runs_status", extra=_LAST_SQL + f""",
x AS (SELECT l.thread_id, l.role, l.text, regexp_extract_all(l.text, '{_F7_SQL}') AS names FROM last l
  JOIN fx_runs_status s ON s.thread_id = l.thread_id AND s.status = 'completed')""") + f"""
SELECT thread_id, role, array_to_string(string_split(list_reduce(list_prepend(text, names), lambda acc, f: replace(acc, f, '')), chr(10)), chr(31))
  AS content, CASE WHEN len(names) > 0 THEN array_to_string(list_transform(names, lambda f: '{IMAGE_BASE_URL}' || f), ' ') END
  AS images FROM x""")
def t8_postprocess(fx: Fixtures) -> DataFrame:
    """Full reply post-processing per completed thread, read back from the reply JSON."""
    out = th.postprocess(_msgs(fx), fx.runs_status(), IMAGE_BASE_URL)
    r = F.from_json("reply_json", "role string, content array<string>, images array<string>")
    return out.select("thread_id", r.alias("r")).select(
        "thread_id", "r.role", F.array_join("r.content", "\x1f").alias("content"), F.array_join("r.images", " ").alias("images"))


@register("t9_request_rows", with_views("fx_catalog", extra=m9_ctes() + f""",
h AS (SELECT m9.question_id, '/api/images/' || c.filename AS url FROM m9 LEFT JOIN fx_catalog c ON c.image_row = m9.doc_id),
rows AS (SELECT b.item_id AS question_id, 0 AS k, 'system' AS role, '{th.SYSTEM_TEXT}' AS content FROM benchmark b
  UNION ALL SELECT item_id, 1, 'user', text FROM benchmark
  UNION ALL SELECT question_id, 2, 'assistant', printf('{tx.FOUND_TEMPLATE}', url)
  FROM h WHERE url IS NOT NULL)""") + """
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY k) - 1 AS INTEGER) AS pos, role, content FROM rows""")
def t9_request_rows(fx: Fixtures) -> DataFrame:
    """Model request rows per benchmark question, with the picture hint
    from the TF-IDF best match (M9) when one exists."""
    best = tfidf_best(fx).join(fx.catalog().select(F.col("image_row").alias("doc_id"), "filename"), "doc_id", "left")
    q = fx.table("benchmark").select(F.col("item_id").alias("question_id"), "text").join(
        best.select("question_id", F.concat(F.lit("/api/images/"), F.col("filename")).alias("url")), "question_id", "left")
    return th.request_rows(q, "question_id", "text", F.col("url"))


@register("t10_tool_dispatch", with_views("fx_catalog", "fx_tool_calls", "fx_runs_status", extra="""
fr AS (SELECT filename, arg_min_null(description, image_row) AS description, true AS hit FROM fx_catalog GROUP BY filename),
asked AS (SELECT call_id, json_extract_string(arguments, '$.filename') AS filename FROM fx_tool_calls
    WHERE call_type = 'function' AND function_name IN ('get_image', 'get_images')
  UNION ALL SELECT call_id, unnest(json_extract_string(arguments, '$.query[*]')) FROM fx_tool_calls
    WHERE call_type = 'function' AND function_name IN ('get_image', 'get_images')),
w AS MATERIALIZED (SELECT call_id, call_id AS thread_id, filename FROM asked
  WHERE call_id IN (SELECT thread_id FROM fx_runs_status WHERE status = 'requires_action'))""") + """
SELECT w.call_id, w.thread_id, 'tool' AS role, w.filename,
  CASE WHEN fr.hit THEN fr.description ELSE 'sem descricao' END AS description
FROM w LEFT JOIN fr ON fr.filename = w.filename WHERE w.filename IS NOT NULL""")
def t10_tool_dispatch(fx: Fixtures) -> DataFrame:
    """Tool calls of runs waiting on a tool, answered from the catalogue."""
    calls = fx.tool_calls().withColumn("thread_id", F.col("call_id"))
    out = th.dispatch_tool_calls(calls, fx.runs_status(), fx.catalog())
    return out.select("call_id", "thread_id", "role", "filename", "description")


# ---------------------------------------------------------------- E1 - E3
@register("e1_accuracy", with_views("fx_checklist") + """
SELECT assistant_name, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy,
  avg(CAST(correct AS DOUBLE)) >= 0.9 AS meets_goal FROM fx_checklist GROUP BY ROLLUP (assistant_name)""")
def e1_accuracy(fx: Fixtures) -> DataFrame:
    """Answer accuracy per assistant and overall against the 90 % goal."""
    return ev.accuracy(fx.checklist())


def _cos(a: str, b: str) -> str:
    from kbspark.plans.matching import _cos_sql
    return _cos_sql(a, b)


_ALL_SCORES = f"""vs AS (SELECT q.question_id, c.image_row,
  greatest({_cos('q.q_vec', 'c.title_vec')}, {_cos('q.q_vec', 'c.desc_vec')}) AS score
  FROM fx_vec_questions q, fx_vec_catalog c)"""


@register("e2_knowledge_gaps", with_views("fx_vec_catalog", "fx_vec_questions", extra=_ALL_SCORES) + """
SELECT question_id, round(best, 6) AS best_score FROM (
  SELECT q.question_id, greatest(coalesce(max(vs.score), 0.0), 0.0) AS best FROM fx_vec_questions q
  LEFT JOIN vs ON vs.question_id = q.question_id GROUP BY q.question_id) WHERE best <= 0.6""")
def e2_knowledge_gaps(fx: Fixtures) -> DataFrame:
    """Question vectors with no catalogue row above 0.60, with their best score."""
    g = ev.knowledge_gaps(fx.vec_questions(), fx.vec_catalog(), 0.6)
    return g.select("question_id", F.round("best_score", 6).alias("best_score"))


SWEEP = [0.5, 0.6, 0.7, 0.8, 0.9]


@register("e3_threshold_sweep", with_views("fx_vec_catalog", "fx_vec_questions", extra=_ALL_SCORES + """,
b AS (SELECT q.question_id, r.image_row AS got, r.score FROM fx_vec_questions q LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, image_row) AS rk FROM vs WHERE score > 0.5) r
  ON r.question_id = q.question_id AND r.rk = 1),
t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold)""") + """
SELECT t.threshold, count(*) AS n_questions, sum(CASE WHEN b.score > t.threshold THEN 1 ELSE 0 END) AS n_answered,
  sum(CASE WHEN b.score > t.threshold AND b.got = b.question_id THEN 1 ELSE 0 END) AS n_correct,
  round(sum(CASE WHEN b.score > t.threshold AND b.got = b.question_id THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM b, t GROUP BY t.threshold""")
def e3_threshold_sweep(fx: Fixtures) -> DataFrame:
    """Answered / correct / accuracy per cosine threshold; question v's
    expected answer is catalogue row v (its vector is e[v] + e[v+1])."""
    from kbspark.operators.vectors import best_match
    best = best_match(fx.vec_questions(), fx.vec_catalog(), threshold=min(SWEEP))
    b = best.select("question_id", F.col("question_id").alias("expected"), F.col("image_row").alias("got"), "score")
    return ev.threshold_sweep(b, SWEEP)
