"""Structured Streaming jobs.

Each job is a DataFrame -> DataFrame function that runs unchanged on a batch
frame (its batch twin) and on a stream; the ``run_*`` helpers start the stream
with ``availableNow`` and a checkpoint in the shared folder, so a restarted
job resumes from its last committed micro-batch after executor or driver loss.
``foreachBatch`` sinks write each micro-batch to a folder of its own id, so a
batch that is replayed after a failure replaces its rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from kbspark.functions import text as tx
from kbspark.operators.threads import COMPLETED, thread_id_for

CHUNK_CHARS = 16
EMITTED = -2
MISSING_THREAD = "missing threadId"


# ---------------------------------------------------------------- sources
def write_slices(df: DataFrame, folder: str, key: str, n: int, order: list[int] | None = None, files: int = 4) -> None:
    """Cut a frame into ``n`` hash slices of ``key`` and append them to one
    folder one after another (``order``), ``files`` files per slice, so a file
    stream sees them as separate, possibly out-of-order arrivals."""
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(F.col(key)), F.lit(n)))
    for k in (order if order is not None else range(n)):
        sliced.where(F.col("_slice") == k).drop("_slice").repartition(files).write.mode("append").parquet(folder)


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def replace_batch(batch: DataFrame, folder: str, batch_id: int) -> None:
    """Write a micro-batch under its id; a replay overwrites the same folder."""
    batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch_id={batch_id}")


def latest_versions(spark: SparkSession, folder: str, keys: list[str], schema) -> DataFrame:
    """The newest version of each key among the batches written by
    ``replace_batch``: an upsert without rewriting earlier rows."""
    with_id = schema if "batch_id" in schema.names else T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(with_id).parquet(folder)
    cols = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*cols), F.col("batch_id")).alias("_v")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"_v.`{c}`").alias(c) for c in cols])


def run_append(stream: DataFrame, out: str, checkpoint: str) -> None:
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
               .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(stream: DataFrame, fn, checkpoint: str, mode: str = "append") -> None:
    q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode)
               .trigger(availableNow=True).start())
    q.awaitTermination()


# ---------------------------------------------------------------- S1
def ingest_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, errors).  A chat request must name its thread; a start
    request without one gets a new thread id (T2's rule); stateless."""
    valid = (F.col("endpoint") == "start") | F.col("thread_id").isNotNull()
    ok = requests.where(valid).select(
        "request_id", F.coalesce(F.col("thread_id"), thread_id_for(F.col("request_id"))).alias("thread_id"),
        F.col("thread_id").isNull().alias("new_thread"), "message")
    bad = requests.where(~valid).select("request_id", F.lit(MISSING_THREAD).alias("reason"))
    return ok, bad


# ---------------------------------------------------------------- S2
def latest_reply_state(messages: DataFrame) -> DataFrame:
    """Latest message per thread as streaming aggregate state (update
    mode emits only the threads a micro-batch touched)."""
    return messages.groupBy("thread_id").agg(
        F.max_by(F.struct("seq", "role", "text"), F.col("seq")).alias("m")).select(
        "thread_id", "m.seq", "m.role", "m.text")


def latest_reply_ttl(messages: DataFrame, ttl_ms: int) -> DataFrame:
    """S2 with a time-to-live: a thread idle for ``ttl_ms`` drops its state and
    restarts from its next message (``applyInPandasWithState``)."""
    out = "thread_id long, seq long, role string, text string"
    st = "seq long, role string, text string"

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else (-1, None, None)
        for pdf in pdfs:
            i = pdf["seq"].idxmax()
            if int(pdf.at[i, "seq"]) > best[0]:
                best = (int(pdf.at[i, "seq"]), pdf.at[i, "role"], pdf.at[i, "text"])
        state.update(best)
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([{"thread_id": key[0], "seq": best[0], "role": best[1], "text": best[2]}])

    return messages.groupBy("thread_id").applyInPandasWithState(
        fn, out, st, "update", GroupStateTimeout.ProcessingTimeTimeout)


def split_late(batch: DataFrame, batch_id: int, marks: str, time_col: str, delay: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a micro-batch, for use in ``foreachBatch``.

    A row is late if its event time is more than ``delay`` before the latest one
    of the earlier micro-batches, whose latest times are kept below ``marks`` by
    batch id; so a replayed batch is split as before.  Rows in time carry that
    mark (the watermark they met; null in the first batch), rows without an
    event time are late."""
    spark = batch.sparkSession
    latest = batch.agg(F.max(time_col).alias("latest"))
    replace_batch(latest, marks, batch_id)
    kept = spark.read.schema("latest timestamp, batch_id long").parquet(marks).where(F.col("batch_id") < batch_id)
    mark = kept.select((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
    bound = F.lit(mark).cast("timestamp")
    in_time = F.col(time_col).isNotNull() & (bound.isNull() | (F.col(time_col) >= bound))
    return batch.where(in_time).withColumn("mark", bound), batch.where(~in_time)


def latest_reply_expiring(messages: DataFrame, ttl_seconds: int) -> DataFrame:
    """S2 with an event-time limit: the latest message per thread of the rows
    that ``split_late`` let through.  A thread's state is dropped when the
    watermark (their ``mark``) passes its last message by ``ttl_seconds``; a
    later message starts it anew.  Emits the threads a micro-batch touched
    (update mode), with the number of messages since the start."""
    out = "thread_id long, seq long, role string, text string, n_messages long"
    st = "seq long, role string, text string, n_messages long, last_ms long"

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        seq, role, text, n, last = state.get if state.exists else (-1, None, None, 0, 0)
        if n and state.getCurrentWatermarkMs() > last + 1000 * ttl_seconds:  # expired, but not timed out yet
            seq, role, text, n, last = -1, None, None, 0, 0
        for pdf in pdfs:
            i = pdf["seq"].idxmax()
            if int(pdf.at[i, "seq"]) > seq:
                seq, role, text = int(pdf.at[i, "seq"]), pdf.at[i, "role"], pdf.at[i, "text"]
            n += len(pdf)
            last = max(last, int(pdf["at_ms"].max()))
        state.update((seq, role, text, n, last))
        state.setTimeoutTimestamp(max(last + 1000 * ttl_seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{"thread_id": key[0], "seq": seq, "role": role, "text": text, "n_messages": n}])

    # rows at the watermark itself count as late, so it stays a second behind
    timed = (messages.withColumn("mark", F.coalesce("mark", F.lit(1).cast("timestamp"))).withWatermark("mark", "1 second")
             .withColumn("at_ms", F.unix_millis("created_at")))
    return timed.groupBy("thread_id").applyInPandasWithState(fn, out, st, "update", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- S3
def postprocess_messages(messages: DataFrame, base_url: str) -> DataFrame:
    """S3: reply post-processing per arriving message (F7 -> F9 -> F10); stateless."""
    names = tx.extract_image_names("text")
    urls = tx.image_urls(names, base_url)
    return messages.select("thread_id", "seq", tx.remove_names("text", names).alias("clean_text"),
                           F.when(F.size(urls) > 0, F.array_join(urls, " ")).alias("images"))


# ---------------------------------------------------------------- S4 / I6
def answer_chunks(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Streamed answer chunks (response_id, seq, delta, done): fixed-size
    pieces of each answer, the last one flagged ``done``."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text_col) / F.lit(CHUNK_CHARS)).cast("int"))
    return (answers.select(F.col(id_col).alias("response_id"), F.col(text_col).alias("_t"), n.alias("_n"))
                   .select("response_id", "_t", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("seq"))
                   .select("response_id", "seq", F.substring("_t", F.col("seq") * CHUNK_CHARS + 1, CHUNK_CHARS).alias("delta"),
                           (F.col("seq") == F.col("_n") - 1).alias("done")))


def assemble_chunks(chunks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Per response, buffer chunks in state and emit the answer once the
    ``done`` chunk and every earlier ``seq`` have arrived (any arrival order;
    replayed chunks are idempotent).  With ``ttl_ms`` an unfinished response is
    dropped after that much idle processing time, and an emitted one leaves a
    mark that long, so that late replays start no new state; use it with a
    continuous trigger (a processing-time timeout keeps an ``availableNow`` run
    firing empty micro-batches)."""
    out = "response_id long, text string, n_chunks int"
    st = "seqs array<int>, deltas array<string>, done_seq int"

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            seqs, deltas, done = state.get
            if done == EMITTED:
                state.setTimeoutDuration(ttl_ms)
                return
            parts = dict(zip(seqs, deltas))
        else:
            parts, done = {}, -1
        for pdf in pdfs:
            for s, d, fin in zip(pdf["seq"], pdf["delta"], pdf["done"]):
                parts[int(s)] = d
                if fin:
                    done = int(s)
        if done >= 0 and all(i in parts for i in range(done + 1)):
            if ttl_ms:
                state.update(([], [], EMITTED))
                state.setTimeoutDuration(ttl_ms)
            else:
                state.remove()
            yield pd.DataFrame([{"response_id": key[0], "text": "".join(parts[i] or "" for i in range(done + 1)),
                                 "n_chunks": done + 1}])
        else:
            state.update((list(parts.keys()), list(parts.values()), done))
            if ttl_ms:
                state.setTimeoutDuration(ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("response_id").applyInPandasWithState(fn, out, st, "append", timeout)


def assemble_pieces(chunks: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """S4 with small state: per response the chunks that follow on without a gap
    leave at once, as a piece ``(response_id, first_seq, n_chunks, text,
    done)``; only chunks behind a gap are kept, and the next number expected.
    Replayed chunks are dropped by their number.  ``ttl`` is event time of the
    column ``arrived`` (when a chunk was received): a response without news for
    that long is dropped, and a finished one leaves a mark that long, so that
    late replays start no new state.  ``whole_answers`` puts the pieces
    together."""
    out = "response_id long, first_seq int, n_chunks int, text string, done boolean"
    st = "next_seq int, seqs array<int>, deltas array<string>, done_seq int"
    length = pd.Timedelta(ttl).value // 1_000_000

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        at, seqs, deltas, done = state.get if state.exists else (0, [], [], -1)
        waiting = dict(zip(seqs, deltas))
        newest = 0
        for pdf in pdfs:
            newest = max(newest, int(pdf["arrived_ms"].to_numpy().max()))
            for s, d, fin in zip(*(pdf[c].tolist() for c in ("seq", "delta", "done"))):
                if s >= at:
                    waiting[int(s)] = d
                if fin:
                    done = int(s)
        first, text = at, []
        while at in waiting:
            text.append(waiting.pop(at) or "")
            at += 1
        finished = 0 <= done < at
        if finished:
            waiting = {}
        state.update((at, list(waiting), list(waiting.values()), done))
        state.setTimeoutTimestamp(max(newest + length, state.getCurrentWatermarkMs() + 1))
        if text:
            yield pd.DataFrame({"response_id": [key[0]], "first_seq": [first], "n_chunks": [len(text)], "text": ["".join(text)], "done": [finished]})

    timed = chunks.withWatermark("arrived", "1 minute").withColumn("arrived_ms", F.unix_millis("arrived"))
    return timed.groupBy("response_id").applyInPandasWithState(fn, out, st, "append", GroupStateTimeout.EventTimeTimeout)


def whole_answers(pieces: DataFrame) -> DataFrame:
    """Finished responses from the pieces of ``assemble_pieces``."""
    parts = F.array_sort(F.collect_list(F.struct("first_seq", "text")))
    whole = pieces.groupBy("response_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
                                              F.sum("n_chunks").cast("int").alias("n_chunks"), F.max("done").alias("finished"))
    return whole.where("finished").drop("finished")


def assemble_chunks_batch(chunks: DataFrame) -> DataFrame:
    """S4's batch twin: ordered concatenation per response."""
    items = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return chunks.groupBy("response_id").agg(
        F.array_join(F.transform(items, lambda x: F.coalesce(x["delta"], F.lit(""))), "").alias("text"),
        F.size(items).alias("n_chunks"))


# ---------------------------------------------------------------- S5
def completed_messages(messages: DataFrame, status: DataFrame, delay: str, within: str = "1 hour") -> DataFrame:
    """Messages joined to their run's status events (same thread and run,
    status time within ``within`` after the message), completed runs only;
    both sides watermarked by ``delay`` so join state is bounded."""
    m = messages.withWatermark("created_at", delay).alias("m")
    s = status.where(F.col("status") == COMPLETED).withWatermark("ts", delay).alias("s")
    cond = ((F.col("m.thread_id") == F.col("s.thread_id")) & (F.col("m.run_id") == F.col("s.run_id"))
            & (F.col("s.ts") >= F.col("m.created_at"))
            & (F.col("s.ts") <= F.col("m.created_at") + F.expr(f"INTERVAL {within}")))
    return m.join(s, cond, "inner").select(F.col("m.thread_id").alias("thread_id"), F.col("m.seq").alias("seq"),
                                           F.col("m.run_id").alias("run_id"), F.col("s.status").alias("status"))
