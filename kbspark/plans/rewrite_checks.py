"""Checked queries for document rewriting (D1-D8) over every manual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.operators import rewrite as rw
from kbspark.plans.oracle_views import with_views
from kbspark.plans.registry import register
from kbspark.sources.fixtures import Fixtures

_KB = ("fx_assistants", "fx_catalog", "fx_doc_runs", "fx_doc_images", "fx_kb_catalog")


def _first(view: str, name: str) -> str:
    return f"""{name} AS (SELECT filename, arg_min_null(title, image_row) AS title,
  arg_min_null(description, image_row) AS description, true AS hit FROM {view} GROUP BY filename)"""


def _runs(fx: Fixtures) -> DataFrame:
    """doc_runs with the embed id of each drawing."""
    r = fx.doc_runs()
    emb = F.concat(F.lit("rId"), (F.col("doc_id") % 20 + 20 * ((F.col("para_idx") + F.col("run_idx")) % 3)).cast("string"))
    return r.withColumn("embed_id", F.when(F.col("kind") == "drawing", emb))


_EMB_SQL = "concat('rId', CAST(doc_id % 20 + 20 * ((para_idx + run_idx) % 3) AS VARCHAR))"


@register("d8_image_ordinals", with_views("fx_doc_runs", "fx_doc_images") + """
SELECT doc_id, para_idx, run_idx, img_idx FROM fx_doc_images""")
def d8_image_ordinals(fx: Fixtures) -> DataFrame:
    """Image ordinal per document over the drawings with a valid relation."""
    drawings = fx.doc_runs().where((F.col("kind") == "drawing") & ((F.col("para_idx") + F.col("run_idx")) % 3 != 2))
    return rw.image_ordinals(drawings).select("doc_id", "para_idx", "run_idx", "img_idx")


_D1_SQL = with_views(*_KB, extra=_first("fx_kb_catalog", "fr") + """,
dr AS (SELECT doc_id, para_idx, run_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, run_idx) AS INTEGER) AS ord
  FROM fx_doc_runs WHERE kind = 'drawing'),
im AS (SELECT doc_id, img_idx AS ord, concat(filepath, '_', filename) AS image_filename FROM fx_new_images),
hits AS (SELECT dr.doc_id, dr.para_idx, dr.run_idx, printf('%s IMAGE_URI: "%s".',
    CASE WHEN fr.hit THEN coalesce(fr.description, '') ELSE 'sem descricao' END, im.image_filename) AS out_text
  FROM dr JOIN im ON im.doc_id = dr.doc_id AND im.ord = dr.ord LEFT JOIN fr ON fr.filename = im.image_filename),
d1 AS (SELECT doc_id, para_idx, run_idx, text AS out_text FROM fx_doc_runs WHERE kind <> 'drawing'
  UNION ALL SELECT * FROM hits)""")


@register("d1_replace_by_position", _D1_SQL + "\nSELECT * FROM d1")
def d1_replace_by_position(fx: Fixtures) -> DataFrame:
    """I-th drawing -> i-th image's description + IMAGE_URI marker; extra drawings vanish."""
    return rw.replace_by_position(fx.doc_runs(), fx.doc_images(), fx.kb_catalog(), fx.filepaths())


def _d23_sql(prefixed: bool, drop_lines: bool) -> str:
    key = "concat(d.source, '_image_', e.embed_id, '.png')" if prefixed else "concat('image_', e.embed_id, '.png')"
    filt = ("AND NOT (starts_with(text, 'Figura') OR starts_with(text, 'Fonte: Aplicativo'))" if drop_lines else "")
    return with_views(*_KB, extra=_first("fx_kb_catalog", "fr") + f""",
e AS (SELECT doc_id, source, para_idx, run_idx, {_EMB_SQL} AS embed_id FROM fx_doc_runs WHERE kind = 'drawing'),
k AS (SELECT e.doc_id, e.para_idx, e.run_idx, concat(e.source, '_image_', e.embed_id, '.png') AS complete,
  {key.replace('d.source', 'e.source')} AS key FROM e),
l AS (SELECT k.*, CASE WHEN fr.hit THEN coalesce(fr.title, '') ELSE 'sem titulo' END AS title,
  CASE WHEN fr.hit THEN coalesce(fr.description, '') ELSE 'sem descricao' END AS description FROM k LEFT JOIN fr ON fr.filename = k.key)""") + f"""
SELECT doc_id, para_idx, run_idx, 0 AS seg, text AS out_text FROM fx_doc_runs WHERE kind <> 'drawing' {filt}
UNION ALL SELECT doc_id, para_idx, run_idx, 0, printf('%s IMAGE_FILENAME: (%s), Descrição: ', title, complete) FROM l
UNION ALL SELECT doc_id, para_idx, run_idx, 1, printf('%s IMAGE_FILENAME: (%s)', description, complete) FROM l"""


@register("d2_replace_by_embed", _d23_sql(True, False))
def d2_replace_by_embed(fx: Fixtures) -> DataFrame:
    """Drawings replaced through their embed id (title and description segments)."""
    return rw.replace_by_embed(_runs(fx), fx.kb_catalog(), fx.filepaths(), prefixed_lookup=True)


@register("d3_replace_ignore_lines", _d23_sql(False, True))
def d3_replace_ignore_lines(fx: Fixtures) -> DataFrame:
    """D3: D2 with the unprefixed lookup, dropping ``Figura``/``Fonte: Aplicativo`` runs."""
    return rw.replace_by_embed(_runs(fx), fx.kb_catalog(), fx.filepaths(), prefixed_lookup=False,
                               drop_caption_lines=True)


@register("d4_replace_plain", with_views(*_KB, "fx_kb_catalog_v1", extra=_first("fx_kb_catalog_v1", "fr") + f""",
e AS (SELECT doc_id, para_idx, run_idx, concat('image_', {_EMB_SQL}, '.png') AS key FROM fx_doc_runs WHERE kind = 'drawing')""")
    + """
SELECT doc_id, para_idx, run_idx, text AS out_text FROM fx_doc_runs WHERE kind <> 'drawing'
UNION ALL SELECT e.doc_id, e.para_idx, e.run_idx, CASE WHEN fr.hit THEN coalesce(fr.description, '') ELSE 'sem descricao' END
FROM e LEFT JOIN fr ON fr.filename = e.key""")
def d4_replace_plain(fx: Fixtures) -> DataFrame:
    """Drawing -> caption text only (v1 catalogue names)."""
    return rw.replace_plain(_runs(fx), fx.kb_catalog_v1())


_PARAS_SQL = """paras AS (SELECT DISTINCT doc_id, para_idx FROM fx_doc_runs),
d5p AS (SELECT p.doc_id, p.para_idx, coalesce(string_agg(coalesce(d1.out_text, ''), '' ORDER BY d1.run_idx), '') AS text
  FROM paras p LEFT JOIN d1 ON d1.doc_id = p.doc_id AND d1.para_idx = p.para_idx GROUP BY p.doc_id, p.para_idx)"""


@register("d5_paragraphs", _D1_SQL + ",\n" + _PARAS_SQL + "\nSELECT doc_id, para_idx, text FROM d5p")
def d5_paragraphs(fx: Fixtures) -> DataFrame:
    """D5 (level 1): D1's runs reassembled into paragraph texts in run order;
    paragraphs whose runs all vanished stay as empty text."""
    d1 = rw.replace_by_position(fx.doc_runs(), fx.doc_images(), fx.kb_catalog(), fx.filepaths())
    return rw.paragraph_texts(d1, all_paragraphs=fx.doc_runs())


@register("d5_documents", _D1_SQL + ",\n" + _PARAS_SQL + """
SELECT doc_id, string_agg(text, chr(10) ORDER BY para_idx) AS text FROM d5p GROUP BY doc_id""")
def d5_documents(fx: Fixtures) -> DataFrame:
    """D5 (level 2): the rewritten manual as one text, paragraphs joined by newlines."""
    d1 = rw.replace_by_position(fx.doc_runs(), fx.doc_images(), fx.kb_catalog(), fx.filepaths())
    return rw.document_text(rw.paragraph_texts(d1, all_paragraphs=fx.doc_runs()))


@register("d6_caption_paragraphs", with_views(*_KB, extra=_first("fx_kb_catalog", "fr") + """,
orig AS (SELECT doc_id, para_idx, 0 AS sub, string_agg(CASE WHEN kind = 'drawing' THEN '' ELSE coalesce(text, '') END, ''
  ORDER BY run_idx) AS text FROM fx_doc_runs GROUP BY doc_id, para_idx),
syn AS (SELECT n.doc_id, i.para_idx, CAST(row_number() OVER (PARTITION BY n.doc_id, i.para_idx ORDER BY n.img_idx DESC) AS INTEGER) AS sub,
  printf('%s IMAGE_FILENAME: (%s)', CASE WHEN fr.hit THEN coalesce(fr.description, '') ELSE 'sem descricao' END, n.filename) AS text
  FROM fx_new_images n JOIN fx_doc_images i ON i.doc_id = n.doc_id AND i.img_idx = n.img_idx
  LEFT JOIN fr ON fr.filename = concat(n.filepath, '_', n.filename))""") + """
SELECT doc_id, para_idx, sub, text FROM orig UNION ALL SELECT doc_id, para_idx, sub, text FROM syn""")
def d6_caption_paragraphs(fx: Fixtures) -> DataFrame:
    """A caption paragraph after each image's paragraph (last image first)."""
    return rw.caption_paragraphs(fx.doc_runs(), fx.doc_images(), fx.kb_catalog(), fx.filepaths())


@register("d7_enrich_alt_text", with_views(*_KB, "fx_kb_catalog_v1", extra="""
fr AS (SELECT filename, arg_min_null(description, image_row) AS description, true AS hit FROM fx_kb_catalog_v1 GROUP BY filename),
x AS (SELECT i.doc_id, i.img_idx, coalesce(nullif(i.descr, ''), nullif(i.name, ''),
    'image_http://schemas.openxmlformats.org/drawingml/2006/picture') AS existing,
  CASE WHEN fr.hit THEN fr.description ELSE 'sem descricao' END AS description
  FROM fx_doc_images i LEFT JOIN fr ON fr.filename = concat('image_', i.embed_id, '.png'))""") + """
SELECT doc_id, img_idx, CASE WHEN coalesce(description, '') <> '' THEN concat(existing, chr(10), chr(10), description)
  ELSE existing END AS alt_text FROM x""")
def d7_enrich_alt_text(fx: Fixtures) -> DataFrame:
    """Alt text enriched with the catalogue description (v1 names)."""
    return rw.enrich_alt_text(fx.doc_images(), fx.kb_catalog_v1())
