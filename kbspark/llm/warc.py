"""WARC archives: writing captures, reading them back, assembling transactions.

A capture is written as three records: the response (or a revisit of an
earlier response with the same payload), the request, and a metadata record.
Request and metadata name the response in ``WARC-Concurrent-To``.  The reader
splits archives into records and joins the three by that identifier into one
nested row per capture.

Archives are written and read by Spark's own text source, so they may lie in
any store Spark reaches and are streamed record by record: records end with
CR LF CR LF, and the reader splits at the version line that starts one.
A payload that contains that line itself is sent with a content coding that
breaks each occurrence by a backslash, so that splitting stays exact.  So is a
payload that ends in the version, which the closing CR LF would complete; a url
that ends in it is percent-encoded there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import written
from kbspark.session import intermediate_path

CRLF = "\r\n"
VERSION = "WARC/1.1"
MARK = VERSION + CRLF
#: Content coding of payloads that contain a mark: backslashes doubled, marks broken.
CODING = "Content-Encoding: x-backslash"
#: Records in one archive file at most.
FILE_RECORDS = 300_000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 8 groups of 20 bits, each as 4 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: Column, ident: Column, concurrent: Column | None, url: Column, extra: list[Column], block: Column) -> Column:
    """One record without its version line and without the closing CR LF CR LF."""
    head = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <urn:capture:"), ident, F.lit(">")),
            F.lit("WARC-Date: " + DATE), F.concat(F.lit("WARC-Target-URI: "), url), *extra,
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    if concurrent is not None:
        head.insert(2, F.concat(F.lit("WARC-Concurrent-To: <urn:capture:"), concurrent, F.lit(">")))
    return F.concat(F.lit(MARK), F.concat_ws(CRLF, *head), F.lit(CRLF + CRLF), block)


def _coded(payload: Column) -> Column:
    broken = F.replace(F.replace(payload, F.lit("\\"), F.lit("\\\\")), F.lit(MARK), F.lit("\\" + MARK[0] + "\\" + MARK[1:]))
    return F.when(broken.endswith(VERSION), F.concat(F.substring(broken, F.lit(1), F.length(broken) - len(VERSION)), F.lit("\\" + VERSION[0] + "\\" + VERSION[1:]))).otherwise(broken)


def plan_captures(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``(cid, url, payload, digest, refers)`` of each row.  Of equal payloads of
    at least ``least_bytes`` bytes the one with the largest id is the response
    and the others refer to it.  ``least_bytes`` 0 includes empty payloads."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("cid"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "%0A"), r"WARC/1\.1\z", "WARC%2F1.1").alias("url"),
                        payload.alias("payload"))
    keyed = base.select("*", F.sha2("payload", 256).alias("key"), F.octet_length("payload").alias("size"))
    # the written table lets the join split a payload that many rows share
    latest = written(keyed.where(F.col("size") >= least_bytes).groupBy("key", "size").agg(F.max("cid").alias("last"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1").drop("n"), "latest")
    return (keyed.join(latest, ["key", "size"], "left")
            .select("cid", "url", "payload", F.when(F.col("last") != F.coalesce(F.col("cid"), F.lit(-1)), F.col("last")).alias("refers")))


def write_captures(captures: DataFrame, path: str) -> None:
    """Write ``plan_captures`` rows as archives under ``path``."""
    cid = F.coalesce(F.col("cid").cast("string"), F.lit("null"))
    unique = F.concat(cid, F.lit(":"), F.col("serial"))
    has_mark = F.col("payload").contains(MARK) | F.col("payload").endswith(VERSION)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload")))
    size = F.concat(F.lit("X-Payload-Bytes: "), F.octet_length("payload").cast("string"))
    body = F.when(has_mark, _coded(F.col("payload"))).otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF),
                    F.when(has_mark, F.lit(CODING + CRLF)).otherwise(""), F.lit(CRLF))
    is_revisit = F.col("refers").isNotNull()
    refers = F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: <urn:capture:"), F.col("refers").cast("string"),
                                         F.lit(">" + CRLF + "WARC-Profile: " + REVISIT_PROFILE)))
    main = _record(F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")), unique, None, F.col("url"),
                   [digest, refers], F.when(is_revisit, http).otherwise(F.concat(http, body)))
    request = _record(F.lit("request"), F.concat(unique, F.lit("/request")), unique, F.col("url"), [],
                      F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + CRLF + CRLF)))
    meta = _record(F.lit("metadata"), F.concat(unique, F.lit("/metadata")), unique, F.col("url"), [],
                   F.concat(F.lit("capture: "), cid, F.lit(CRLF), size, F.lit(CRLF)))
    rows = captures.withColumn("serial", F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 16))
    rows = rows.select(F.array(main, request, meta).alias("records")).select(F.explode("records").alias("value"))
    rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, record_id, concurrent_to, refers_to, url, digest, payload_bytes,
    payload_digest, block)``; one row per record.  The payload columns are
    taken from the payload read (null but for responses).  A record whose block
    is not as long as its header says is an error: ``block`` is then null."""
    raw = spark.read.option("lineSep", MARK).text(path).where(F.col("value") != "")
    head_len = F.instr("value", CRLF + CRLF)
    head = F.concat(F.lit(CRLF), F.substring("value", F.lit(1), head_len - 1), F.lit(CRLF))
    parts = raw.select(head.alias("head"), F.substring("value", head_len + 4, F.length("value")).alias("rest"))

    def field(name: str) -> Column:
        got = F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(got != "", got)

    def ident(name: str) -> Column:
        return F.regexp_replace(field(name), "^<urn:capture:|>$", "")

    block = F.substring("rest", F.lit(1), F.length("rest") - 4)
    records = parts.select(field("WARC-Type").alias("kind"), ident("WARC-Record-ID").alias("record_id"),
                        ident("WARC-Concurrent-To").alias("concurrent_to"), ident("WARC-Refers-To").alias("refers_to"),
                        F.coalesce(field("WARC-Target-URI"), F.lit("")).alias("url"), field("WARC-Payload-Digest").alias("digest"),
                        F.when(F.octet_length(block) == field("Content-Length").cast("long"), block).alias("block"))
    payload = F.when(F.col("kind") == "response", http_payload(F.col("block")))
    with_payload = records.select("*", payload.alias("payload"))
    return with_payload.select(*records.columns[:-1], F.octet_length("payload").cast("long").alias("payload_bytes"),
                               base32_sha1(F.col("payload")).alias("payload_digest"), "block")


def http_payload(block: Column) -> Column:
    """The payload of an HTTP message, with the writer's content coding undone."""
    cut = F.instr(block, CRLF + CRLF)
    head, body = F.substring(block, F.lit(1), cut - 1), F.substring(block, cut + 4, F.length(block))
    return F.when(head.contains(CODING), F.regexp_replace(body, r"(?s)\\(.)", "$1")).otherwise(body)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, kind, refers_to, url, digest,
    payload_bytes, payload_digest, response, request, metadata``.  Request and metadata records are joined by
    ``concurrent_to``; a capture without them has nulls there, and of several
    of one kind the one with the smallest record id counts.  Requests or
    metadata without a capture give no row."""
    part = F.struct("record_id", "block")

    def side(kind: str) -> DataFrame:
        return (records.where(F.col("kind") == kind).where("concurrent_to is not null")
                .groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(part).alias(kind)))

    main = records.where(F.col("kind").isin("response", "revisit"))
    return (main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")
            .select("record_id", "kind", "refers_to", "url", F.regexp_replace("digest", "^sha1:", "").alias("digest"), "payload_bytes", "payload_digest",
                    F.col("block").alias("response"), F.col("request.block").alias("request"), F.col("metadata.block").alias("metadata")))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and
    assemble the captures (see ``assemble``).

    Null payloads are empty and null urls empty; line breaks in urls are
    percent-encoded.  Rows with a null id are written under the id ``null`` and
    never refer nor are referred to by id.  Repeated rows give a capture each.
    Empty tables give empty archives and no rows.
    """
    path = intermediate_path(pages.sparkSession, "warc")
    write_captures(plan_captures(pages, id_col, url_col, payload_col, least_bytes), path)
    return assemble(read_records(pages.sparkSession, path))
