"""Checked queries for manual files (I1-I3, I5): every document is written as
a .docx by a Spark job, then scanned and parsed back; the parsed rows must
equal the SQL views the files were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import to_base64
from kbspark.operators.joins import materialize
from kbspark.plans.oracle_views import with_views
from kbspark.plans.registry import register
from kbspark.plans.rewrite_checks import _D1_SQL, _PARAS_SQL
from kbspark.plans import manual_files
from kbspark.session import derived_once
from kbspark.sources import docx, manuals
from kbspark.sources.fixtures import Fixtures


def _written(fx: Fixtures) -> tuple[str, DataFrame]:
    def build() -> tuple[str, DataFrame]:
        folder = manuals.shared_folder(fx.spark, "manuals")
        files = manual_files.write_manuals(manual_files.manual_runs(fx.doc_runs(), fx.doc_images()), folder)
        return folder, materialize(files.select("doc_id", "n_bytes"))
    return derived_once(fx.spark, fx.sf_dir, "written manuals", build)


def written_manuals(fx: Fixtures) -> str:
    """Folder with every document as a manual, written once per application and table folder."""
    return _written(fx)[0]


def _doc_id(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"manual_(\d+)\.docx$", 1).cast("long")


@register("i1_scan_manuals", "SELECT doc_id, true AS has_content FROM documents")
def i1_scan_manuals(fx: Fixtures) -> DataFrame:
    """The written manuals scanned as binary files (one row per file), each
    with as many bytes as its writer counted."""
    folder, sizes = _written(fx)
    files = docx.scan_manuals(fx.spark, folder).select(_doc_id().alias("doc_id"), "length", F.length("content").alias("n_content"))
    whole = (F.col("length") == F.col("n_bytes")) & (F.col("n_content") == F.col("n_bytes"))
    return files.join(sizes, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("has_content"))


@register("i2_parse_runs", with_views("fx_doc_runs") + """
SELECT doc_id, para_idx, run_idx, kind, CASE WHEN kind = 'drawing' THEN '' ELSE text END AS text FROM fx_doc_runs""")
def i2_parse_runs(fx: Fixtures) -> DataFrame:
    """Manuals exploded into ordered runs (drawing runs carry no text)."""
    runs = docx.explode_runs(docx.scan_manuals(fx.spark, written_manuals(fx)))
    return runs.select(_doc_id().alias("doc_id"), "para_idx", "run_idx", "kind", "text")


@register("i2_parse_images", with_views("fx_doc_runs", "fx_doc_images") + """
SELECT doc_id, img_idx, para_idx, run_idx, descr, name, ext, base64(content) AS content_b64 FROM fx_doc_images""")
def i2_parse_images(fx: Fixtures) -> DataFrame:
    """Manuals exploded into their inline images (unresolved relations skipped)."""
    imgs = docx.explode_images(docx.scan_manuals(fx.spark, written_manuals(fx)))
    return imgs.select(_doc_id().alias("doc_id"), "img_idx", "para_idx", "run_idx", "descr", "name", "ext",
                       to_base64("content").alias("content_b64"))


@register("i3_store_images", with_views("fx_assistants", "fx_catalog", "fx_doc_runs", "fx_doc_images", "fx_kb_catalog",
                                        extra="""
ni AS (SELECT n.filepath, n.filename, n.doc_id, n.img_idx, i.content FROM fx_new_images n
  JOIN fx_doc_images i ON i.doc_id = n.doc_id AND i.img_idx = n.img_idx)""") + """
SELECT filepath, concat(filepath, '/', filepath, '_', filename) AS path,
  base64(arg_max(content, doc_id * 1000000 + img_idx)) AS content_b64 FROM ni GROUP BY 1, 2""")
def i3_store_images(fx: Fixtures) -> DataFrame:
    """Extracted images stored under {filepath}/{filepath}_{filename}, read
    back; of several images of one path the last stays."""
    imgs = fx.new_images().join(fx.doc_images().select("doc_id", "img_idx", "content"), ["doc_id", "img_idx"])
    back = manuals.store_images(imgs, manuals.shared_folder(fx.spark, "images"))
    return back.select("filepath", "path", to_base64("content").alias("content_b64"))


@register("i5_write_manuals", _D1_SQL + ",\n" + _PARAS_SQL + """
SELECT 'manual_' || CAST(doc_id AS VARCHAR) || '_data' AS out_name, string_agg(text, chr(10) ORDER BY para_idx) AS text
FROM d5p GROUP BY doc_id""")
def i5_write_manuals(fx: Fixtures) -> DataFrame:
    """Each rewritten manual (D1 -> D5) written as ordered paragraphs under
    ``{stem}_data``, read back whole."""
    from kbspark.operators import rewrite as rw
    d1 = rw.replace_by_position(fx.doc_runs(), fx.doc_images(), fx.kb_catalog(), fx.filepaths())
    paras = rw.paragraph_texts(d1, all_paragraphs=fx.doc_runs())
    names = fx.table("documents").select(
        "doc_id", manuals.output_name(F.concat(F.lit("manual_"), F.col("doc_id").cast("string"), F.lit(".docx"))).alias("out_name"))
    return manuals.write_rewritten(paras, names, manuals.shared_folder(fx.spark, "rewritten"))
