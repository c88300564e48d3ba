"""Checked queries for the scalar text functions (F1-F18), each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.plans.oracle_views import norm, with_views
from kbspark.plans.registry import register
from kbspark.sources.fixtures import Fixtures

# URL prefix for image links (a deployment parameter).
IMAGE_BASE_URL = "/api/getImage/"

_F7_SQL = r"\b[\p{L}\p{N}_]+_(?:figura|image|picture)[^\s]+\.(?:png|jpg|jpeg)\b"
_F8_SQL = tx.IMAGE_NAME_PATTERN_V0
_NL2 = "concat(' ', chr(10), chr(10))"


@register("f1_normalize", f"SELECT doc_id, {norm('text')} AS norm_text FROM documents")
def f1_normalize(fx: Fixtures) -> DataFrame:
    """F1 over every document."""
    return fx.table("documents").select("doc_id", tx.normalize_text("text").alias("norm_text"))


@register("f2_filename_from_alt", with_views("fx_catalog", extra=r"""
t AS (SELECT image_row, ext, lower(regexp_replace(title, '^\s+|\s+$', '', 'g')) AS t FROM fx_catalog)""") + r"""
SELECT image_row, CASE WHEN t IS NULL THEN NULL
  WHEN regexp_matches(t, '^figura\s*\d+') THEN concat('figura', printf('%02d', CAST(regexp_extract(t, '^figura\s*(\d+)', 1) AS HUGEINT)), '.', ext)
  WHEN regexp_matches(t, '^picture\s*\d+') THEN concat('picture', CAST(CAST(regexp_extract(t, '^picture\s*(\d+)', 1) AS HUGEINT) AS VARCHAR), '.', ext)
  ELSE strip_accents(regexp_replace(t, '\s+', '', 'g')) END AS alt_filename FROM t""")
def f2_filename_from_alt(fx: Fixtures) -> DataFrame:
    """F2 with the catalogue title as alt text."""
    c = fx.catalog()
    return c.select("image_row", tx.filename_from_alt_text("title", "ext").alias("alt_filename"))


@register("f3_strip_accents", "SELECT doc_id, strip_accents(text) AS stripped FROM documents")
def f3_strip_accents(fx: Fixtures) -> DataFrame:
    """F3 over every document."""
    return fx.table("documents").select("doc_id", tx.strip_accents("text").alias("stripped"))


_ASCII_WS = r"[\t\n\x0B\f\r \x1C-\x1F]"


@register("f4_slug", f"""
SELECT doc_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'),
  '[^A-Za-z0-9_\\t\\n\\x0B\\f\\r \\x1C-\\x1F-]', '', 'g'), '^{_ASCII_WS}+|{_ASCII_WS}+$', '', 'g')), '[-\\t\\n\\x0B\\f\\r \\x1C-\\x1F]+', '_', 'g') AS slug
FROM documents""")
def f4_slug(fx: Fixtures) -> DataFrame:
    """F4 over every document."""
    return fx.table("documents").select("doc_id", tx.ascii_slug("text").alias("slug"))


@register("f5_alt_text", with_views("fx_doc_runs", "fx_doc_images") + """
SELECT doc_id, img_idx, coalesce(nullif(CASE WHEN img_idx % 3 > 0 THEN descr END, ''), nullif(CASE WHEN img_idx % 2 = 0 THEN name END, ''),
  printf('image_%04d', img_idx)) AS alt_text FROM fx_doc_images""")
def f5_alt_text(fx: Fixtures) -> DataFrame:
    """description, else name, else ``image_%04d`` of the ordinal within the manual."""
    i = fx.doc_images()
    return i.select("doc_id", "img_idx", tx.alt_text_fallback(
        F.when(F.col("img_idx") % 3 > 0, F.col("descr")), F.when(F.col("img_idx") % 2 == 0, F.col("name")), "img_idx").alias("alt_text"))


@register("f6_ext_default", with_views("fx_catalog") + r"""
SELECT image_row, coalesce(nullif(regexp_extract(title, '\.([A-Za-z0-9]+)$', 1), ''), 'png') AS ext FROM fx_catalog""")
def f6_ext_default(fx: Fixtures) -> DataFrame:
    """the extension found at the end of the title, else ``png``."""
    c = fx.catalog()
    return c.select("image_row", tx.extension_default(F.regexp_extract("title", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))


def _explode_sql(pattern: str, col: str) -> str:
    return with_views("fx_messages", extra=f"""
n AS (SELECT thread_id, seq, regexp_extract_all(text, '{pattern}') AS names FROM fx_messages)""") + f"""
SELECT thread_id, seq, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS pos, unnest(names) AS {col} FROM n"""


@register("f7_image_names", _explode_sql(_F7_SQL, "name"))
def f7_image_names(fx: Fixtures) -> DataFrame:
    """image filenames in every message, with their position."""
    m = fx.messages()
    return m.select("thread_id", "seq", F.posexplode(tx.extract_image_names("text")).alias("pos", "name"))


@register("f8_image_names_v0", _explode_sql(_F8_SQL, "name"))
def f8_image_names_v0(fx: Fixtures) -> DataFrame:
    """F8: older non-greedy pattern over every message."""
    m = fx.messages()
    return m.select("thread_id", "seq", F.posexplode(tx.extract_image_names_v0("text")).alias("pos", "name"))


@register("f9_remove_names", with_views("fx_messages", extra=f"""
n AS (SELECT thread_id, seq, text, regexp_extract_all(text, '{_F7_SQL}') AS names FROM fx_messages)""") + """
SELECT thread_id, seq, list_reduce(list_prepend(text, names), lambda acc, f: replace(acc, f, '')) AS clean_text FROM n""")
def f9_remove_names(fx: Fixtures) -> DataFrame:
    """every message with its image filenames deleted."""
    m = fx.messages()
    return m.select("thread_id", "seq", tx.remove_names("text", tx.extract_image_names("text")).alias("clean_text"))


@register("f10_image_urls", with_views("fx_messages", extra=f"""
n AS (SELECT thread_id, seq, list_transform(regexp_extract_all(text, '{_F7_SQL}'), lambda f: concat('{IMAGE_BASE_URL}', f)) AS urls
  FROM fx_messages)""") + """
SELECT thread_id, seq, CAST(generate_subscripts(urls, 1) - 1 AS INTEGER) AS pos, unnest(urls) AS url FROM n""")
def f10_image_urls(fx: Fixtures) -> DataFrame:
    """one URL per extracted filename."""
    m = fx.messages()
    urls = tx.image_urls(tx.extract_image_names("text"), IMAGE_BASE_URL)
    return m.select("thread_id", "seq", F.posexplode(urls).alias("pos", "url"))


@register("f11_html_links", with_views("fx_messages", extra=f"""
n AS (SELECT thread_id, seq, text, list_transform(regexp_extract_all(text, '{_F8_SQL}'),
  lambda f: concat('{IMAGE_BASE_URL}', f)) AS urls FROM fx_messages)""") + f"""
SELECT thread_id, seq, CASE WHEN len(urls) > 0 THEN concat(text, {_NL2}, array_to_string(list_transform(urls,
  lambda u, i: printf('{tx.LINK_TEMPLATE}', u, i)), chr(10))) ELSE text END AS text_out FROM n""")
def f11_html_links(fx: Fixtures) -> DataFrame:
    """numbered links appended to each message (F8 names, as in the
    embedding-server variant)."""
    m = fx.messages()
    urls = tx.image_urls(tx.extract_image_names_v0("text"), IMAGE_BASE_URL)
    return m.select("thread_id", "seq", tx.append_html_links("text", urls).alias("text_out"))


@register("f12_found_line", with_views("fx_messages", extra=f"""
n AS (SELECT thread_id, seq, text, '{IMAGE_BASE_URL}' || regexp_extract_all(text, '{_F7_SQL}')[1] AS url FROM fx_messages)""")
    + f"""
SELECT thread_id, seq, CASE WHEN url IS NOT NULL THEN concat(text, {_NL2},
  printf('{tx.FOUND_TEMPLATE}', url)) ELSE text END AS text_out FROM n""")
def f12_found_line(fx: Fixtures) -> DataFrame:
    """the "found this picture" line for the first image of a message."""
    m = fx.messages()
    url = F.concat(F.lit(IMAGE_BASE_URL), F.try_element_at(tx.extract_image_names("text"), F.lit(1)))
    return m.select("thread_id", "seq", tx.append_found_line("text", url).alias("text_out"))


@register("f13_image_path_mime", with_views("fx_catalog") + r"""
SELECT image_row, concat(split_part(filename, '_', 1), '/', filename) AS path,
  (SELECT kind FROM (VALUES """ + ", ".join(f"('{e}', '{k}')" for e, k in tx.MIME_BY_EXTENSION.items()) + r""") AS m(ext, kind)
   WHERE m.ext = lower(regexp_extract(filename, '\.([^./]*)$', 1))) AS mime
FROM fx_catalog""")
def f13_image_path_mime(fx: Fixtures) -> DataFrame:
    """storage path and MIME type of every catalogue filename."""
    c = fx.catalog()
    return c.select("image_row", tx.image_path("filename").alias("path"), tx.image_mime("filename").alias("mime"))


def stored_images(fx: Fixtures) -> DataFrame:
    """Stored image files: one per catalogue filename (first row), bytes = the
    UTF-8 of its title (else of its filename)."""
    c = fx.catalog()
    first = c.groupBy("filename").agg(F.min_by("title", "image_row").alias("title"))
    return first.select("filename", F.encode(F.coalesce("title", "filename"), "UTF-8").alias("content"))


@register("f14_resolve_images", with_views("fx_catalog", "fx_tool_calls", extra="""
st AS (SELECT filename, encode(coalesce(arg_min_null(title, image_row), filename)) AS content FROM fx_catalog GROUP BY filename),
rq AS (SELECT call_id, json_extract_string(arguments, '$.filename') AS filename FROM fx_tool_calls)""") + """
SELECT rq.call_id, rq.filename, CASE WHEN st.content IS NULL THEN 'Image not found' ELSE 'ok' END AS status,
  base64(st.content) AS content_b64 FROM rq LEFT JOIN st ON st.filename = rq.filename""")
def f14_resolve_images(fx: Fixtures) -> DataFrame:
    """requested filenames resolved to stored bytes or "Image not found"."""
    rq = fx.tool_calls().select("call_id", tx.parse_tool_arguments("arguments").getField("filename").alias("filename"))
    st = stored_images(fx)
    return (rq.join(st, "filename", "left")
              .select("call_id", "filename",
                      F.when(F.col("content").isNull(), F.lit("Image not found")).otherwise(F.lit("ok")).alias("status"),
                      tx.to_base64("content").alias("content_b64")))


@register("f15_base64", with_views("fx_catalog") + """
SELECT image_row, base64(encode(coalesce(title, filename))) AS content_b64 FROM fx_catalog""")
def f15_base64(fx: Fixtures) -> DataFrame:
    """base64 of each catalogue image's bytes."""
    c = fx.catalog()
    return c.select("image_row", tx.to_base64(F.encode(F.coalesce("title", "filename"), "UTF-8")).alias("content_b64"))


def registry_lines(fx: Fixtures) -> DataFrame:
    """Assistant registry lines (``"assistantName": "…",  "assistantID": asst_…``)."""
    a = fx.assistants()
    return a.select("id", F.concat(F.lit('"assistantName": "'), F.col("name"), F.lit('",  "assistantID": '),
                                   F.col("assistant_key")).alias("line"))


@register("f16_registry", with_views("fx_assistants", extra="""
r AS (SELECT id, concat('"assistantName": "', name, '",  "assistantID": ', assistant_key) AS line FROM fx_assistants)""") + """
SELECT id, regexp_extract(line, '"assistantName": "([^"]*)"', 1) AS assistant_name,
  nullif(regexp_extract(line, '"assistantName": "[^"]*".*?"assistantID": (asst_\\w+)', 1), '') AS assistant_key FROM r""")
def f16_registry(fx: Fixtures) -> DataFrame:
    """F16: registry lines parsed into (name, id)."""
    r = registry_lines(fx)
    return r.select("id", tx.registry_name("line").alias("assistant_name"), tx.registry_id("line").alias("assistant_key"))


@register("f17_tool_args", with_views("fx_tool_calls") + """
SELECT call_id, json_extract_string(arguments, '$.filename') AS filename, array_to_string(json_extract_string(arguments, '$.query[*]'), chr(31)) AS query FROM fx_tool_calls""")
def f17_tool_args(fx: Fixtures) -> DataFrame:
    """tool-call JSON arguments parsed with a fixed schema."""
    t = fx.tool_calls()
    args = t.select("call_id", tx.parse_tool_arguments("arguments").alias("a"))
    return args.select("call_id", "a.filename", F.coalesce(F.array_join("a.query", "\x1f"), F.lit("")).alias("query"))


@register("f17_event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f17_event_props(fx: Fixtures) -> DataFrame:
    """F17 on the events table's JSON properties."""
    e = fx.table("events")
    return e.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@register("f18_strip_citations", """
SELECT conv_id, turn, regexp_replace(concat(substr(text, 1, 10), '【4:', CAST(turn AS VARCHAR), '†source】', substr(text, 11)),
  '【[^】]*】', '', 'g') AS text_out FROM conversations""")
def f18_strip_citations(fx: Fixtures) -> DataFrame:
    """a citation marker planted in every message, then removed."""
    c = fx.table("conversations")
    marked = F.concat(F.substring("text", 1, 10), F.lit("【4:"), F.col("turn").cast("string"), F.lit("†source】"),
                      F.expr("substring(text, 11)"))
    return c.select("conv_id", "turn", tx.strip_citations(marked).alias("text_out"))
