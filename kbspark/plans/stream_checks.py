"""Checked streaming queries (S1-S6, I6): each stream reads slices of a table
that arrive as separate files (out of order where the operator allows it),
runs to the end with ``availableNow`` and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.operators import match
from kbspark.operators.joins import materialize
from kbspark.plans.matching import _SCORES
from kbspark.plans.oracle import topk_sql
from kbspark.plans.oracle_views import with_views
from kbspark.plans.registry import register
from kbspark.plans.text_functions import _F7_SQL, IMAGE_BASE_URL
from kbspark.sources.fixtures import Fixtures
from kbspark.sources.manuals import shared_folder
from kbspark.streaming import jobs

SLICES = 4
FILES = 4  # of a slice; a micro-batch takes one slice
OUT_OF_ORDER = [2, 0, 3, 1]


def _stream_of(fx: Fixtures, df: DataFrame, key: str, name: str, order=OUT_OF_ORDER) -> DataFrame:
    folder = shared_folder(fx.spark, f"in-{name}")
    jobs.write_slices(df, folder, key, SLICES, order, FILES)
    return jobs.read_stream(fx.spark, folder, df.schema, FILES)


def _requests(fx: Fixtures) -> DataFrame:
    c = fx.table("conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("request_id"),
                    F.when(F.col("turn") == 0, "start").otherwise("chat").alias("endpoint"),
                    F.when((F.col("turn") == 0) | (F.col("conv_id") % 10 == 9), F.lit(None).cast("string"))
                     .otherwise(F.col("conv_id").cast("string")).alias("thread_id"),
                    F.col("text").alias("message"))


@register("s1_ingest", """
WITH r AS (SELECT conv_id * 100 + turn AS request_id, CASE WHEN turn = 0 THEN 'start' ELSE 'chat' END AS endpoint,
  CASE WHEN turn = 0 OR conv_id % 10 = 9 THEN NULL ELSE CAST(conv_id AS VARCHAR) END AS thread_id, text AS message
  FROM conversations WHERE role = 'user')
SELECT request_id, coalesce(thread_id, 'thread_' || substr(sha256(CAST(request_id AS VARCHAR)), 1, 24)) AS thread_id,
  thread_id IS NULL AS new_thread, CAST(NULL AS VARCHAR) AS reason FROM r WHERE endpoint = 'start' OR thread_id IS NOT NULL
UNION ALL SELECT request_id, NULL, NULL, 'missing threadId' FROM r WHERE NOT (endpoint = 'start' OR thread_id IS NOT NULL)""")
def s1_ingest(fx: Fixtures) -> DataFrame:
    """Arriving chat requests -> thread assignment, malformed ones to an error output."""
    stream = _stream_of(fx, _requests(fx), "request_id", "requests")
    ok_dir, bad_dir = shared_folder(fx.spark, "s1-ok"), shared_folder(fx.spark, "s1-err")

    def sink(batch: DataFrame, batch_id: int) -> None:
        ok, bad = jobs.ingest_requests(batch)
        jobs.replace_batch(ok, ok_dir, batch_id)
        jobs.replace_batch(bad, bad_dir, batch_id)

    jobs.run_batches(stream, sink, shared_folder(fx.spark, "s1-ckpt"))
    ok = fx.spark.read.parquet(ok_dir).select("request_id", "thread_id", "new_thread",
                                             F.lit(None).cast("string").alias("reason"))
    bad = fx.spark.read.parquet(bad_dir).select("request_id", F.lit(None).cast("string").alias("thread_id"),
                                               F.lit(None).cast("boolean").alias("new_thread"), "reason")
    return ok.unionByName(bad)


_LAST_SQL = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS rk
  FROM fx_messages) WHERE rk = 1)"""


@register("s2_latest_reply", with_views("fx_messages", extra=_LAST_SQL) + "\nSELECT thread_id, seq, role, text FROM last")
def s2_latest_reply(fx: Fixtures) -> DataFrame:
    """Latest message per thread kept as streaming state; micro-batches
    append changed threads, readers take each thread's newest version."""
    m = fx.messages().select("thread_id", "seq", "role", "text")
    stream = _stream_of(fx, m.withColumn("_k", F.concat_ws(":", "thread_id", "seq")), "_k", "messages").drop("_k")
    out = shared_folder(fx.spark, "s2-out")

    def sink(batch: DataFrame, batch_id: int) -> None:
        jobs.replace_batch(batch, out, batch_id)

    jobs.run_batches(jobs.latest_reply_state(stream), sink, shared_folder(fx.spark, "s2-ckpt"), mode="update")
    return jobs.latest_versions(fx.spark, out, ["thread_id"], m.schema)


DELAYED_TURN = "thread_id % 10 = 3 AND seq = 1"
DELAY = "2 hours"


@register("s2_event_time", with_views("fx_messages", extra=f"""
width AS (SELECT greatest(1, ceil((max(thread_id) + 1) / {SLICES}.0))::BIGINT AS w FROM fx_messages),
arr AS (SELECT m.*, CASE WHEN {DELAYED_TURN} THEN {SLICES} ELSE thread_id // w END AS b FROM fx_messages m, width),
marks AS (SELECT k, (SELECT max(created_at) FROM arr WHERE b < k) - INTERVAL 2 HOUR AS mark FROM (SELECT unnest(range(0, {SLICES + 1})) AS k)),
cut AS (SELECT arr.*, coalesce(created_at < mark, false) AS late FROM arr JOIN marks ON marks.k = arr.b),
best AS (SELECT thread_id, max(seq) AS seq FROM cut WHERE NOT late GROUP BY thread_id)""") + """
SELECT thread_id, seq, role, text, late FROM cut WHERE late
UNION ALL SELECT thread_id, seq, role, text, late FROM cut JOIN best USING (thread_id, seq) WHERE NOT late""")
def s2_event_time(fx: Fixtures) -> DataFrame:
    """S2 by event time: threads arrive slice by slice in time order, but one
    turn of every tenth thread only at the end.  Rows later than the delay go to
    an error output; the others keep each thread's latest reply in state that
    expires a day after its last message."""
    m = fx.messages().select("thread_id", "seq", "role", "text", "created_at")
    n = m.agg(F.max("thread_id")).first()[0] + 1
    width = max(1, -(-n // SLICES))
    arrivals, in_time, late, marks, out = (shared_folder(fx.spark, f"s2e-{name}") for name in ("in", "ok", "late", "marks", "out"))
    slot = F.when(F.expr(DELAYED_TURN), F.lit(SLICES)).otherwise(F.floor(F.col("thread_id") / width))
    for k in range(SLICES + 1):
        m.where(slot == k).coalesce(1).write.mode("append").parquet(arrivals)

    def split(batch: DataFrame, batch_id: int) -> None:
        ok, bad = jobs.split_late(batch, batch_id, marks, "created_at", DELAY)
        jobs.replace_batch(ok, in_time, batch_id)
        jobs.replace_batch(bad, late, batch_id)

    jobs.run_batches(jobs.read_stream(fx.spark, arrivals, m.schema, 1), split, shared_folder(fx.spark, "s2e-ckpt"))
    split_schema = T.StructType([*m.schema.fields, T.StructField("mark", T.TimestampType())])
    replies = jobs.latest_reply_expiring(jobs.read_stream(fx.spark, f"{in_time}/batch_id=*", split_schema, FILES), 24 * 3600)
    jobs.run_batches(replies, lambda batch, batch_id: jobs.replace_batch(batch, out, batch_id), shared_folder(fx.spark, "s2e-ckpt2"), mode="update")
    said = T.StructType([f for f in m.schema.fields if f.name != "created_at"])
    kept = jobs.latest_versions(fx.spark, out, ["thread_id"], said).select("thread_id", "seq", "role", "text", F.lit(False).alias("late"))
    lost = fx.spark.read.schema(m.schema).parquet(late).select("thread_id", "seq", "role", "text", F.lit(True).alias("late"))
    return kept.unionByName(lost)


@register("s3_postprocess", with_views("fx_messages", extra=f"""
x AS (SELECT thread_id, seq, text, regexp_extract_all(text, '{_F7_SQL}') AS names FROM fx_messages)""") + f"""
SELECT thread_id, seq, list_reduce(list_prepend(text, names), lambda acc, f: replace(acc, f, '')) AS clean_text,
  CASE WHEN len(names) > 0 THEN array_to_string(list_transform(names, lambda f: '{IMAGE_BASE_URL}' || f), ' ') END AS images
FROM x""")
def s3_postprocess(fx: Fixtures) -> DataFrame:
    """S3: reply post-processing on the message stream, upserted by message."""
    m = fx.messages().select("thread_id", "seq", "text")
    stream = _stream_of(fx, m.withColumn("_k", F.concat_ws(":", "thread_id", "seq")), "_k", "s3").drop("_k")
    out = shared_folder(fx.spark, "s3-out")
    clean = jobs.postprocess_messages(stream, IMAGE_BASE_URL)
    jobs.run_batches(clean, lambda batch, batch_id: jobs.replace_batch(batch, out, batch_id), shared_folder(fx.spark, "s3-ckpt"))
    return jobs.latest_versions(fx.spark, out, ["thread_id", "seq"], clean.schema)


def _chunks(fx: Fixtures) -> DataFrame:
    a = fx.table("conversations").where(F.col("role") == "assistant")
    a = a.select((F.col("conv_id") * 100 + F.col("turn")).alias("response_id"), "text")
    return jobs.answer_chunks(a, "response_id", "text")


_CHUNKS_SQL = """ch AS (SELECT conv_id * 100 + turn AS response_id, text,
  CAST(greatest(1, ceil(length(text) / 16)) AS INTEGER) AS n FROM conversations WHERE role = 'assistant')"""


@register("s4_assemble_chunks", "WITH " + _CHUNKS_SQL + "\nSELECT response_id, text, n AS n_chunks FROM ch")
def s4_assemble_chunks(fx: Fixtures) -> DataFrame:
    """Streamed answer chunks, arriving out of order across files, assembled
    per response once complete."""
    ch = _chunks(fx).withColumn("_k", F.concat_ws(":", "response_id", "seq"))
    stream = _stream_of(fx, ch, "_k", "chunks").drop("_k")
    out = shared_folder(fx.spark, "s4-out")
    received = stream.withColumn("arrived", F.current_timestamp())
    jobs.run_append(jobs.assemble_pieces(received), out, shared_folder(fx.spark, "s4-ckpt"))
    return jobs.whole_answers(fx.spark.read.parquet(out))


@register("i6_ndjson_sink", "WITH " + _CHUNKS_SQL + """
SELECT response_id, CAST(i AS INTEGER) AS seq, substr(text, CAST(i * 16 + 1 AS BIGINT), 16) AS delta, i = n - 1 AS done
FROM ch, LATERAL (SELECT unnest(range(0, n)) AS i)""")
def i6_ndjson_sink(fx: Fixtures) -> DataFrame:
    """The chunk stream relayed to a newline-delimited JSON sink, read back."""
    ch = _chunks(fx)
    stream = _stream_of(fx, ch.withColumn("_k", F.concat_ws(":", "response_id", "seq")), "_k", "relay").drop("_k")
    out = shared_folder(fx.spark, "i6-out")
    q = (stream.writeStream.format("json").option("path", out)
               .option("checkpointLocation", shared_folder(fx.spark, "i6-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return fx.spark.read.schema(ch.schema).json(out)


def _run_messages(fx: Fixtures) -> DataFrame:
    """Messages with the run they belong to: two turns a run, several runs a thread."""
    return fx.messages().select("thread_id", "seq", F.format_string("run_%d_%d", F.col("thread_id"), F.floor(F.col("seq") / 2)).alias("run_id"), "created_at")


def _status(fx: Fixtures) -> DataFrame:
    runs = _run_messages(fx).groupBy("thread_id", "run_id").agg(F.max("created_at").alias("last"), F.min("seq").alias("first"))
    k = (F.col("thread_id") + F.col("first") / 2) % 3
    return runs.select("thread_id", "run_id", F.when(k == 0, "failed").otherwise("completed").alias("status"),
                       (F.col("last") + F.expr("INTERVAL 30 SECONDS")).alias("ts"))


@register("s5_completed_join", with_views("fx_messages", extra="""
m AS (SELECT thread_id, seq, printf('run_%d_%d', thread_id, seq // 2) AS run_id, created_at FROM fx_messages),
st AS (SELECT thread_id, run_id, CASE WHEN (thread_id + min(seq) // 2) % 3 = 0 THEN 'failed' ELSE 'completed' END AS status,
  max(created_at) + INTERVAL 30 SECOND AS ts FROM m GROUP BY thread_id, run_id)""") + """
SELECT m.thread_id, m.seq, m.run_id, st.status FROM m JOIN st ON st.thread_id = m.thread_id AND st.run_id = m.run_id AND st.status = 'completed'
  AND st.ts >= m.created_at AND st.ts <= m.created_at + INTERVAL 1 HOUR""")
def s5_completed_join(fx: Fixtures) -> DataFrame:
    """Stream-stream join of messages and run-status events (watermarked,
    time-bounded), completed runs only; threads arrive in time order by slice."""
    m, s = _run_messages(fx), _status(fx)
    n = fx.table("conversations").select(F.max("conv_id")).first()[0] + 1
    width = max(1, -(-n // SLICES))
    m_dir, s_dir = shared_folder(fx.spark, "s5-msg"), shared_folder(fx.spark, "s5-status")
    for k in range(SLICES):  # in time order: one slice of threads after another
        for df, folder in ((m, m_dir), (s, s_dir)):
            df.where(F.floor(F.col("thread_id") / width) == k).repartition(FILES).write.mode("append").parquet(folder)
    ms, sts = jobs.read_stream(fx.spark, m_dir, m.schema, FILES), jobs.read_stream(fx.spark, s_dir, s.schema, FILES)
    out = shared_folder(fx.spark, "s5-out")
    jobs.run_append(jobs.completed_messages(ms, sts, delay="2 hours"), out, shared_folder(fx.spark, "s5-ckpt"))
    return fx.spark.read.parquet(out)


@register("s6_image_lookup", with_views("fx_questions", "fx_catalog", extra=_SCORES + ",\n" + topk_sql(), recursive=True) + """
SELECT t.question_id, t.image_row, t.match_score, t.rank, c.filename FROM top t JOIN fx_catalog c ON c.image_row = t.image_row""")
def s6_image_lookup(fx: Fixtures) -> DataFrame:
    """Arriving questions matched against the static catalogue inside
    ``foreachBatch`` (ranking windows run per micro-batch)."""
    stream = _stream_of(fx, fx.questions(), "question_id", "questions")
    out = shared_folder(fx.spark, "s6-out")
    # the catalogue is normalised and tokenised once, before the first micro-batch
    names = materialize(fx.catalog().select("image_row", "filename"))
    catalog = match.prepare(fx.catalog())

    def sink(batch: DataFrame, batch_id: int) -> None:
        top = match.top_matches(batch, catalog)
        jobs.replace_batch(top.join(names, "image_row"), out, batch_id)

    jobs.run_batches(stream, sink, shared_folder(fx.spark, "s6-ckpt"))
    return fx.spark.read.parquet(out).drop("batch_id")
