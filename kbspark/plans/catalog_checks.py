"""Checked queries for catalogue maintenance (C1-C11) and the catalogue scan (I4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark import schemas
from kbspark.operators import catalog as cat
from kbspark.plans.oracle_views import with_views
from kbspark.plans.registry import register
from kbspark.sources import catalog_store as store
from kbspark.sources.fixtures import Fixtures
from kbspark.sources.manuals import shared_folder

_IMG_COLS = "image_row, filepath, filename, content_type, title, description, assistant_id"


@register("c1_conform_catalog", with_views("fx_catalog") + f"\nSELECT {_IMG_COLS} FROM fx_catalog")
def c1_conform_catalog(fx: Fixtures) -> DataFrame:
    """The catalogue conformed to the explicit images schema."""
    return schemas.conform(fx.catalog(), schemas.IMAGES)


def _batch(fx: Fixtures) -> DataFrame:
    q = fx.questions()
    return q.select(F.col("question_id").alias("ord"), F.col("assistant_name").alias("name"),
                    F.concat(F.lit("asst_"), F.col("assistant_name")).alias("assistant_key"))


_BATCH_SQL = """batch AS (SELECT question_id AS ord, assistant_name AS name, concat('asst_', assistant_name) AS assistant_key
  FROM fx_questions)"""


@register("c2_insert_or_ignore", with_views("fx_assistants", "fx_questions", extra=_BATCH_SQL + """,
firsts AS (SELECT assistant_key, arg_min(name, ord) AS name, min(ord) AS ord FROM batch GROUP BY assistant_key),
new AS (SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM fx_assistants a WHERE a.assistant_key = f.assistant_key))""") + """
SELECT id, name, assistant_key FROM fx_assistants
UNION ALL SELECT (SELECT max(id) FROM fx_assistants) + row_number() OVER (ORDER BY ord), name, assistant_key FROM new""")
def c2_insert_or_ignore(fx: Fixtures) -> DataFrame:
    """Question routes inserted as assistants; known keys ignored, first row per new key wins."""
    return cat.insert_or_ignore_assistants(fx.assistants(), _batch(fx), "ord")


@register("c3_resolve_ids", with_views("fx_assistants", "fx_questions") + """
SELECT q.question_id, a.id AS assistant_id FROM fx_questions q
LEFT JOIN fx_assistants a ON a.assistant_key = concat('asst_', q.assistant_name)""")
def c3_resolve_ids(fx: Fixtures) -> DataFrame:
    """Assistant surrogate id for each question's route (NULL when unknown)."""
    q = fx.questions().select("question_id", F.concat(F.lit("asst_"), F.col("assistant_name")).alias("assistant_key"))
    return cat.resolve_assistant_ids(q, fx.assistants()).select("question_id", "assistant_id")


@register("c4_append_images", with_views("fx_assistants", "fx_catalog", "fx_doc_runs", "fx_doc_images", "fx_kb_catalog")
          + f"\nSELECT {_IMG_COLS} FROM fx_kb_catalog")
def c4_append_images(fx: Fixtures) -> DataFrame:
    """C4: every manual's extracted images appended to the catalogue, with captions where supplied."""
    return cat.append_images(fx.catalog(), fx.new_images(), fx.assistants(), fx.captions())


_REQ_SQL = """req AS (SELECT concat('asst_', assistant_name) AS assistant_key,
  concat('src', CAST((question_id * 7) % 20 AS VARCHAR)) AS filepath FROM fx_questions)"""


def _requests(fx: Fixtures) -> DataFrame:
    q = fx.questions()
    return q.select(F.concat(F.lit("asst_"), F.col("assistant_name")).alias("assistant_key"),
                    F.concat(F.lit("src"), ((F.col("question_id") * 7) % 20).cast("string")).alias("filepath"))


def _stored(fx: Fixtures, name: str):
    """A store holding the catalogue, and its schema."""
    root = shared_folder(fx.spark, name)
    catalog = fx.catalog().select(*store.COLUMNS)
    store.save_catalog(catalog, root)
    return root, catalog.schema


@register("c5_delete_images", with_views("fx_assistants", "fx_catalog", "fx_questions", extra=_REQ_SQL) + """
SELECT image_row, filepath, filename, assistant_id FROM fx_catalog c WHERE NOT EXISTS (
  SELECT 1 FROM req r JOIN fx_assistants a ON a.assistant_key = r.assistant_key
  WHERE a.id = c.assistant_id AND r.filepath = c.filepath)""")
def c5_delete_images(fx: Fixtures) -> DataFrame:
    """Cleanup requests (assistant key, folder) applied to the stored catalogue, read back."""
    root, schema = _stored(fx, "c5")
    req = _requests(fx)
    store.replace_folders(fx.spark, root, schema, req, lambda c: cat.delete_images(c, req, fx.assistants()))
    return store.load_catalog(fx.spark, root, schema).select("image_row", "filepath", "filename", "assistant_id")


def _reingest_sql() -> str:
    appended = """SELECT coalesce((SELECT max(image_row) FROM {base}), 0) + row_number() OVER (ORDER BY n.doc_id, n.img_idx) AS image_row,
      n.filepath, concat(n.filepath, '_', n.filename) AS filename, {desc} AS description
      FROM fx_new_images n LEFT JOIN fx_captions c ON c.filename = concat(n.filepath, '_', n.filename)"""
    return with_views("fx_assistants", "fx_catalog", "fx_doc_runs", "fx_doc_images", "fx_kb_catalog", extra="""
rq AS (SELECT DISTINCT assistant_key, filepath FROM fx_new_images),
kept AS (SELECT * FROM fx_catalog c WHERE NOT EXISTS (SELECT 1 FROM rq JOIN fx_assistants a ON a.assistant_key = rq.assistant_key
  WHERE a.id = c.assistant_id AND rq.filepath = c.filepath))""") + f"""
SELECT false AS cleanup, false AS captions, image_row, filepath, filename, description FROM fx_catalog
UNION ALL SELECT true, false, image_row, filepath, filename, description FROM kept
UNION ALL SELECT true, false, * FROM ({appended.format(base='kept', desc='CAST(NULL AS VARCHAR)')})
UNION ALL SELECT false, true, image_row, filepath, filename, description FROM fx_catalog
UNION ALL SELECT false, true, * FROM ({appended.format(base='fx_catalog', desc='c.description')})
UNION ALL SELECT true, true, image_row, filepath, filename, description FROM kept
UNION ALL SELECT true, true, * FROM ({appended.format(base='kept', desc='c.description')})"""


@register("c6_reingest_matrix", _reingest_sql())
def c6_reingest_matrix(fx: Fixtures) -> DataFrame:
    """The stored catalogue after re-ingesting every manual, for all four (cleanup, captions) flag pairs, read back."""
    req = fx.new_images().select("assistant_key", "filepath").distinct()
    root, schema = _stored(fx, "c6")
    out = None
    for cleanup in (False, True):
        for captions in (False, True):
            # four branches of one stored catalogue
            version = store.replace_folders(fx.spark, root, schema, req, lambda c, cleanup=cleanup, captions=captions: cat.reingest(
                c, fx.new_images(), fx.assistants(), req, cleanup, fx.captions() if captions else None), publish=False)
            c = store.load_catalog(fx.spark, root, schema, version).select(F.lit(cleanup).alias("cleanup"), F.lit(captions).alias("captions"),
                         "image_row", "filepath", "filename", "description")
            out = c if out is None else out.unionByName(c)
    return out


@register("c7_delete_worklist", with_views("fx_assistants", "fx_catalog", "fx_questions", "fx_doc_runs", "fx_doc_images",
                                           "fx_kb_catalog") + """
SELECT DISTINCT a.assistant_key, c.filename FROM fx_kb_catalog c JOIN fx_assistants a ON c.assistant_id = a.id
WHERE a.assistant_key IN (SELECT concat('asst_', assistant_name) FROM fx_questions)
  AND c.filename IN (SELECT concat(filepath, '_', filename) FROM fx_new_images)""")
def c7_delete_worklist(fx: Fixtures) -> DataFrame:
    """Files to delete for the questions' assistants: catalogue x assistant
    join, kept where the image file was stored by the ingest (I3)."""
    keys = _batch(fx).select("assistant_key")
    stored = fx.new_images().select(F.concat(F.col("filepath"), F.lit("_"), F.col("filename")).alias("filename"))
    return cat.delete_worklist(fx.kb_catalog(), fx.assistants(), keys, stored).distinct()


@register("c8_integrity_audit", with_views("fx_assistants", "fx_catalog", "fx_questions", "fx_doc_runs", "fx_doc_images",
                                           "fx_kb_catalog", extra="""
asst AS (SELECT id, name, assistant_key FROM fx_assistants
  UNION ALL SELECT question_id + 1000, assistant_name, concat('asst_', assistant_name) FROM fx_questions)""") + """
SELECT 'not_null:images.' || col AS "check", CAST(NULL AS VARCHAR) AS subject, n FROM (
  SELECT 'filepath' AS col, count(*) FILTER (WHERE filepath IS NULL) AS n FROM fx_kb_catalog
  UNION ALL SELECT 'filename', count(*) FILTER (WHERE filename IS NULL) FROM fx_kb_catalog
  UNION ALL SELECT 'content_type', count(*) FILTER (WHERE content_type IS NULL) FROM fx_kb_catalog) WHERE n > 0
UNION ALL SELECT 'not_null:assistant.' || col, NULL, n FROM (
  SELECT 'name' AS col, count(*) FILTER (WHERE name IS NULL) AS n FROM asst
  UNION ALL SELECT 'assistant_key', count(*) FILTER (WHERE assistant_key IS NULL) FROM asst) WHERE n > 0
UNION ALL SELECT 'unique:assistant.assistant_key', assistant_key, count(*) FROM asst GROUP BY assistant_key HAVING count(*) > 1
UNION ALL SELECT 'unique:assistant.id', CAST(id AS VARCHAR), count(*) FROM asst GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'fk:images.assistant_id', CAST(assistant_id AS VARCHAR), count(*) FROM fx_kb_catalog
  WHERE assistant_id IS NOT NULL AND assistant_id NOT IN (SELECT id FROM asst) GROUP BY assistant_id""")
def c8_integrity_audit(fx: Fixtures) -> DataFrame:
    """Constraint audit of the ingested catalogue against the assistants
    table plus the raw (not yet deduplicated) question routes."""
    raw = fx.questions().select((F.col("question_id") + 1000).alias("id"), F.col("assistant_name").alias("name"),
                                F.concat(F.lit("asst_"), F.col("assistant_name")).alias("assistant_key"))
    return cat.integrity_audit(fx.kb_catalog(), fx.assistants().unionByName(raw))


@register("c9_lookup_description", with_views("fx_catalog", "fx_tool_calls", extra="""
rq AS (SELECT call_id, json_extract_string(arguments, '$.filename') AS filename FROM fx_tool_calls),
fr AS (SELECT filename, arg_min_null(title, image_row) AS title, arg_min_null(description, image_row) AS description, true AS hit
  FROM fx_catalog GROUP BY filename)""") + """
SELECT rq.call_id, rq.filename, CASE WHEN fr.hit THEN fr.title ELSE 'sem titulo' END AS title,
  CASE WHEN fr.hit THEN fr.description ELSE 'sem descricao' END AS description
FROM rq LEFT JOIN fr ON fr.filename = rq.filename""")
def c9_lookup_description(fx: Fixtures) -> DataFrame:
    """(title, description) for each tool-call filename; first row wins, defaults only when no row."""
    from kbspark.functions.text import parse_tool_arguments
    rq = fx.tool_calls().select("call_id", parse_tool_arguments("arguments").getField("filename").alias("filename"))
    return cat.lookup_description(rq, fx.catalog()).select("call_id", "filename", "title", "description")


@register("c10_lookup_filename", with_views("fx_catalog", "fx_questions", extra="""
fr AS (SELECT title, arg_min(filename, image_row) AS filename FROM fx_catalog WHERE title IS NOT NULL GROUP BY title)""") + """
SELECT q.question_id, concat('Picture ', CAST(q.question_id AS VARCHAR)) AS title, coalesce(fr.filename, '') AS filename
FROM fx_questions q LEFT JOIN fr ON fr.title = concat('Picture ', CAST(q.question_id AS VARCHAR))""")
def c10_lookup_filename(fx: Fixtures) -> DataFrame:
    """Filename of the first row titled ``Picture <question_id>``, else ''."""
    rq = fx.questions().select("question_id", F.concat(F.lit("Picture "), F.col("question_id").cast("string")).alias("title"))
    return cat.lookup_filename_by_title(rq, fx.catalog()).select("question_id", "title", "filename")


@register("c11_caption_worklist", with_views("fx_catalog", "fx_tool_calls") + """
SELECT image_row, filename FROM fx_catalog WHERE description IS NULL
  AND filename NOT IN (SELECT json_extract_string(arguments, '$.filename') FROM fx_tool_calls
    WHERE json_extract_string(arguments, '$.filename') IS NOT NULL)""")
def c11_caption_worklist(fx: Fixtures) -> DataFrame:
    """C11: images still without description and without a supplied caption
    (captions arrive for the tool-call filenames)."""
    from kbspark.functions.text import parse_tool_arguments
    caps = fx.tool_calls().select(parse_tool_arguments("arguments").getField("filename").alias("filename"),
                                  F.col("arguments").alias("description"))
    return cat.caption_worklist(fx.catalog(), caps).select("image_row", "filename")


@register("i4_catalog_scan", with_views("fx_catalog") + "\nSELECT filename, title, description FROM fx_catalog")
def i4_catalog_scan(fx: Fixtures) -> DataFrame:
    """I4: catalogue scan with projection (column pruning reaches the Parquet scan)."""
    return fx.catalog().select("filename", "title", "description")
