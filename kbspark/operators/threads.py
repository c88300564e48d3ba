"""Threads and replies (T1-T10): routing, thread seeding, latest message,
reply records, completed-run gate, reply post-processing, model request rows,
tool-call dispatch.

A thread is the unit of work: per-thread aggregates (``max_by`` for the
latest message) are partial aggregates; only T4 collects a whole thread,
which is bounded by one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators.joins import maybe_broadcast

# Fixed values of the reference: the status that releases a reply, the one
# that asks for a tool call, and the type and names of calls that look up images.
COMPLETED = "completed"
REQUIRES_ACTION = "requires_action"
TOOL_CALL_TYPE = "function"
LOOKUP_FUNCTIONS = ("get_image", "get_images")

#: Default instruction of the request builder; deployments pass their own.
SYSTEM_TEXT = "Responda dúvidas sobre os manuais. Quando o manual não trouxer a resposta, diga isso."


def registry(lines: DataFrame, line_col: str = "line", order_col: str = "line_no") -> DataFrame:
    """F16 over a registry frame -> (line_no, assistant_name, assistant_key)."""
    return lines.select(order_col, tx.registry_name(line_col).alias("assistant_name"),
                        tx.registry_id(line_col).alias("assistant_key")).where(F.col("assistant_key").isNotNull())


def route(requests: DataFrame, reg: DataFrame, name_col: str = "assistant_name", order_col: str = "line_no") -> DataFrame:
    """Exact, case-sensitive name match; first registry line wins; NULL when none."""
    first = reg.groupBy("assistant_name").agg(F.min_by("assistant_key", order_col).alias("assistant_key"))
    side, _ = maybe_broadcast(first.withColumnRenamed("assistant_name", name_col))
    return requests.join(side, name_col, "left")


def thread_id_for(key: Column) -> Column:
    """Deterministic thread id for a message without one."""
    return F.concat(F.lit("thread_"), F.substring(F.sha2(key.cast("string"), 256), 1, 24))


def seed_threads(messages: DataFrame, key_col: str, text_col: str, instructions: str) -> DataFrame:
    """A new thread per message: system instruction row (seq 0) then the
    user message (seq 1)."""
    rows = F.array(F.struct(F.lit(0).alias("seq"), F.lit("system").alias("role"), F.lit(instructions).alias("content")),
                   F.struct(F.lit(1).alias("seq"), F.lit("user").alias("role"), F.col(text_col).alias("content")))
    return (messages.select(thread_id_for(F.col(key_col)).alias("thread_id"), F.explode(rows).alias("m"))
                    .select("thread_id", "m.seq", "m.role", "m.content"))


def latest_message(messages: DataFrame, cols: list[str], thread: str = "thread_id", seq: str = "seq") -> DataFrame:
    """The newest message of each thread whatever its role (partial ``max_by``)."""
    s = F.max_by(F.struct(F.col(seq), *[F.col(c) for c in cols]), F.col(seq)).alias("_m")
    return messages.groupBy(thread).agg(s).select(thread, F.col(f"_m.{seq}").alias(seq), *[F.col(f"_m.{c}").alias(c) for c in cols])


def thread_json(messages: DataFrame, cols: list[str], thread: str = "thread_id", seq: str = "seq") -> DataFrame:
    """T4: the whole thread newest first as a JSON array."""
    items = F.collect_list(F.struct(F.col(seq), *[F.col(c) for c in cols]))
    return messages.groupBy(thread).agg(F.to_json(F.reverse(F.array_sort(items))).alias("messages_json"))


def content_blocks(text: Column) -> Column:
    """Nested message content ``array<struct<text:struct<value>>>``: one block per paragraph."""
    return F.transform(F.split(text, "\n"), lambda p: F.struct(F.struct(p.alias("value")).alias("text")))


def reply_record(id_col: Column, role: Column, content: Column, created_at: Column, thread: Column,
                 images: Column) -> Column:
    """T5: reply struct; ``images`` only when non-empty (NULL is dropped by ``to_json``)."""
    return F.struct(id_col.alias("id"), role.alias("role"),
                    F.transform(content, lambda b: b["text"]["value"]).alias("content"),
                    created_at.alias("created_at"), thread.alias("thread_id"),
                    F.when(F.size(images) > 0, images).alias("images"))


def first_block(content: Column) -> Column:
    """The first content block's text, NULL when there is none."""
    return F.try_element_at(content, F.lit(1))["text"]["value"]


def completed_gate(replies: DataFrame, status: DataFrame, value: Column, out: str = "reply",
                   thread: str = "thread_id") -> DataFrame:
    """The reply only for threads whose run completed; NULL otherwise."""
    st, _ = maybe_broadcast(status.select(thread, "status"))
    return replies.join(st, thread, "left").withColumn(out, F.when(F.col("status") == COMPLETED, value))


def postprocess(messages: DataFrame, status: DataFrame, base_url: str) -> DataFrame:
    """Completed-run gate -> latest message -> image names -> names
    removed -> image URLs -> reply record (JSON), per thread."""
    done = messages.join(status.where(F.col("status") == COMPLETED).select("thread_id"), "thread_id", "left_semi")
    last = latest_message(done, ["id", "role", "text", "created_at"])
    names = tx.extract_image_names("text")
    clean = tx.remove_names("text", names)
    urls = tx.image_urls(names, base_url)
    rec = reply_record(F.col("id"), F.col("role"), content_blocks(clean), F.col("created_at"),
                       F.col("thread_id").cast("string"), urls)
    return last.select("thread_id", rec.alias("reply")).withColumn("reply_json", F.to_json("reply"))


def request_rows(questions: DataFrame, q_id: str, text_col: str, hint_url: Column, system_text: str = SYSTEM_TEXT) -> DataFrame:
    """System + user + (when a picture matched) assistant hint rows."""
    hint = F.when(hint_url.isNotNull(), F.format_string(tx.FOUND_TEMPLATE, hint_url))
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("content")),
                   F.struct(F.lit("user").alias("role"), F.col(text_col).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), hint.alias("content")))
    kept = F.filter(msgs, lambda m: m["content"].isNotNull())
    return questions.select(q_id, F.posexplode(kept).alias("pos", "m")).select(q_id, "pos", "m.role", "m.content")


def dispatch_tool_calls(calls: DataFrame, status: DataFrame, catalog: DataFrame, thread: str = "thread_id",
                        functions: tuple[str, ...] = LOOKUP_FUNCTIONS) -> DataFrame:
    """Function calls of runs waiting on a tool (``requires_action``) ->
    parsed arguments -> catalogue lookup (C9) -> tool-output rows.

    A call asks for one ``filename`` or for a ``query`` list of them; calls of
    another type or function are not answered."""
    from kbspark.operators.catalog import lookup_description
    st, _ = maybe_broadcast(status.where(F.col("status") == REQUIRES_ACTION).select(thread))
    waiting = (calls.where((F.col("call_type") == TOOL_CALL_TYPE) & F.col("function_name").isin(*functions))
               .join(st, thread, "left_semi"))
    parsed = waiting.select("call_id", thread, tx.parse_tool_arguments("arguments").alias("a"))
    names = F.concat(F.array("a.filename"), F.coalesce("a.query", F.array().cast("array<string>")))
    req = parsed.select("call_id", thread, F.explode(names).alias("filename")).where(F.col("filename").isNotNull())
    found = lookup_description(req, catalog)
    out = F.to_json(F.struct(F.col("filename"), F.col("description")))
    return found.select("call_id", thread, F.lit("tool").alias("role"), "filename", "description", out.alias("content"))
