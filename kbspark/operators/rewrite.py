"""Document rewriting (D1-D8): ordered multi-row transforms over manuals held
as rows ``doc_runs(doc_id, para_idx, run_idx, kind, text, embed_id)`` and
``doc_images(doc_id, img_idx, …)``.

Order is data: every ordinal is a window partitioned by ``doc_id`` (never a
global order), every reassembly sorts by explicit indices.  A manual is the
unit of work; a whole document only becomes one value in
``document_text`` (paragraph rows stay rows everywhere else).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators.catalog import DEFAULT_DESCRIPTION, DEFAULT_TITLE, first_by
from kbspark.operators.joins import materialize, maybe_broadcast

# Bytes of distinct names up to which the catalogue is reduced to them first.
LOOKUP_BYTES = 16 * 1024 * 1024
# Fixed output templates of the reference.
URI_TEMPLATE = '%s IMAGE_URI: "%s".'
FILENAME_TITLE_TEMPLATE = "%s IMAGE_FILENAME: (%s), Descrição: "
FILENAME_DESC_TEMPLATE = "%s IMAGE_FILENAME: (%s)"
DROPPED_PREFIXES = ("Figura", "Fonte: Aplicativo")
DEFAULTS = {"title": DEFAULT_TITLE, "description": DEFAULT_DESCRIPTION}
GRAPHIC_URI = "http://schemas.openxmlformats.org/drawingml/2006/picture"


def image_ordinals(rows: DataFrame, out: str = "img_idx") -> DataFrame:
    """1-based ordinal of each image (or drawing) within its document."""
    w = Window.partitionBy("doc_id").orderBy("para_idx", "run_idx")
    return rows.withColumn(out, F.row_number().over(w))


def image_filename(images: DataFrame) -> Column:
    """F5 -> F6 -> F2: the filename the ingest derives for an extracted image."""
    alt = tx.alt_text_fallback("descr", "name", "img_idx")
    return tx.filename_from_alt_text(alt, tx.extension_default("ext"))


def _lookup(keys: DataFrame, catalog: DataFrame, key: str, null_as: str | None, cols: tuple[str, ...] = ("description",)) -> DataFrame:
    """C9 on a key column: ``cols`` of the first catalogue row, defaults when no
    row; a found NULL becomes ``null_as``."""
    first = first_by(catalog, "filename", list(cols)).withColumnRenamed("filename", key)
    out = keys.join(first.withColumn("_hit", F.lit(True)), key, "left")
    for c in cols:
        found = F.col(c) if null_as is None else F.coalesce(F.col(c), F.lit(null_as))
        out = out.withColumn(c, F.when(F.col("_hit"), found).otherwise(F.lit(DEFAULTS[c])))
    return out.drop("_hit")


def replace_by_position(runs: DataFrame, images: DataFrame, catalog: DataFrame, filepaths: DataFrame) -> DataFrame:
    """The i-th drawing run becomes ``{description} IMAGE_URI: "{filepath}_{filename}".``
    for the i-th image; text runs are copied; drawings past the last image vanish.

    ``filepaths``: (doc_id, filepath) — the folder each manual is ingested to."""
    drawings = image_ordinals(runs.where(F.col("kind") == "drawing"), "_ord")
    imgs = (images.select("doc_id", F.col("img_idx").alias("_ord"), image_filename(images).alias("_fname"))
                  .join(filepaths, "doc_id")
                  .select("doc_id", "_ord", F.concat(F.col("filepath"), F.lit("_"), F.col("_fname")).alias("image_filename")))
    hit = drawings.join(imgs, ["doc_id", "_ord"])  # inner: drawings with no image vanish
    hit = _lookup(hit, catalog.withColumnRenamed("filename", "filename"), "image_filename", "")
    hit = hit.withColumn("out_text", F.format_string(URI_TEMPLATE, F.col("description"), F.col("image_filename")))
    texts = runs.where(F.col("kind") != "drawing").withColumn("out_text", F.col("text"))
    cols = ["doc_id", "para_idx", "run_idx", "out_text"]
    return texts.select(*cols).unionByName(hit.select(*cols))


def _embed_filename(c: Column) -> Column:
    return F.concat(F.lit("image_"), c, F.lit(".png"))


def replace_by_embed(runs: DataFrame, catalog: DataFrame, filepaths: DataFrame,
                     prefixed_lookup: bool = True, drop_caption_lines: bool = False) -> DataFrame:
    """D2 (``prefixed_lookup``) / D3 (unprefixed lookup + caption-line filter):
    each drawing becomes two segments ``{title} IMAGE_FILENAME: (…), Descrição: ``
    and ``{description} IMAGE_FILENAME: (…)`` for ``{filepath}_image_{embed}.png``.
    Output rows carry ``seg`` (0, 1) to keep the two segments ordered."""
    d = (runs.where((F.col("kind") == "drawing") & F.col("embed_id").isNotNull())
             .join(filepaths, "doc_id")
             .withColumn("complete", F.concat(F.col("filepath"), F.lit("_"), _embed_filename(F.col("embed_id"))))
             .withColumn("key", F.col("complete") if prefixed_lookup else _embed_filename(F.col("embed_id"))))
    # few names are asked for often: only their rows of the catalogue are sorted
    # and sent, and the drawings are not dealt by name
    asked = materialize(d.select("key").distinct())
    few, small = maybe_broadcast(asked, max_bytes=LOOKUP_BYTES)
    if small:
        catalog = catalog.join(few.withColumnRenamed("key", "filename"), "filename", "left_semi")
    d = _lookup(d, catalog, "key", "", ("title", "description"))
    seg0 = d.select("doc_id", "para_idx", "run_idx", F.lit(0).alias("seg"),
                    F.format_string(FILENAME_TITLE_TEMPLATE, F.col("title"), F.col("complete")).alias("out_text"))
    seg1 = d.select("doc_id", "para_idx", "run_idx", F.lit(1).alias("seg"),
                    F.format_string(FILENAME_DESC_TEMPLATE, F.col("description"), F.col("complete")).alias("out_text"))
    t = runs.where(F.col("kind") != "drawing")
    if drop_caption_lines:
        cond = None
        for p in DROPPED_PREFIXES:
            c = F.col("text").startswith(p)
            cond = c if cond is None else cond | c
        t = t.where(~F.coalesce(cond, F.lit(False)))
    t = t.select("doc_id", "para_idx", "run_idx", F.lit(0).alias("seg"), F.col("text").alias("out_text"))
    return t.unionByName(seg0).unionByName(seg1)


def replace_plain(runs: DataFrame, catalog_v1: DataFrame) -> DataFrame:
    """Drawing -> catalogue description of ``image_{embed}.png`` (v1
    names), default text when missing; a found NULL adds an empty run."""
    d = runs.where((F.col("kind") == "drawing") & F.col("embed_id").isNotNull()).withColumn(
        "key", _embed_filename(F.col("embed_id")))
    d = _lookup(d, catalog_v1, "key", "")
    t = runs.where(F.col("kind") != "drawing").withColumn("description", F.col("text"))
    cols = ["doc_id", "para_idx", "run_idx", F.col("description").alias("out_text")]
    return t.select(*cols).unionByName(d.select(*cols))


def paragraph_texts(rows: DataFrame, text_col: str = "out_text", order=("run_idx",),
                    all_paragraphs: DataFrame | None = None) -> DataFrame:
    """D5 level 1: runs -> paragraph text, concatenated in run order.
    ``all_paragraphs`` (doc_id, para_idx) keeps paragraphs whose runs all
    vanished, as empty text."""
    items = F.struct(*[F.col(c) for c in order], F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    own = rows.select("doc_id", "para_idx", items.alias("_i"), F.lit(False).alias("_listed"))
    if all_paragraphs is not None:
        listed = all_paragraphs.select("doc_id", "para_idx").distinct()
        own = own.unionByName(listed.select("doc_id", "para_idx", F.lit(None).cast(own.schema["_i"].dataType).alias("_i"), F.lit(True).alias("_listed")))
    # dealt by document once: its paragraphs and its whole text come from the same tasks
    p = (own.repartition("doc_id").groupBy("doc_id", "para_idx")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("_i")), lambda x: x["_t"]), "").alias("text"), F.max("_listed").alias("_listed")))
    if all_paragraphs is not None:
        known = F.col("doc_id").isNotNull() & F.col("para_idx").isNotNull()
        p = p.where("_listed").withColumn("text", F.when(known, F.col("text")).otherwise(F.lit("")))
    return p.drop("_listed")


def document_text(paragraphs: DataFrame, text_col: str = "text", order=("para_idx",)) -> DataFrame:
    """D5 level 2: paragraphs -> one document text joined by newlines, in order."""
    items = F.struct(*[F.col(c) for c in order], F.col(text_col).alias("_t"))
    return paragraphs.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["_t"]), "\n").alias("text"))


def caption_paragraphs(runs: DataFrame, images: DataFrame, catalog: DataFrame, filepaths: DataFrame) -> DataFrame:
    """Original paragraphs plus, after each image's paragraph, a paragraph
    ``{description} IMAGE_FILENAME: ({filename})``; several images in one
    paragraph put the last image's caption first (``sub`` orders them)."""
    orig = paragraph_texts(runs.withColumn("_t", F.when(F.col("kind") == "drawing", F.lit("")).otherwise(F.col("text"))),
                           "_t").withColumn("sub", F.lit(0))
    imgs = (images.withColumn("_fname", image_filename(images)).join(filepaths, "doc_id")
                  .withColumn("image_filename", F.concat(F.col("filepath"), F.lit("_"), F.col("_fname"))))
    imgs = _lookup(imgs, catalog, "image_filename", "")
    w = Window.partitionBy("doc_id", "para_idx").orderBy(F.col("img_idx").desc())
    syn = imgs.select("doc_id", "para_idx", F.row_number().over(w).alias("sub"),
                      F.format_string(FILENAME_DESC_TEMPLATE, F.col("description"), F.col("_fname")).alias("text"))
    return orig.select("doc_id", "para_idx", "sub", "text").unionByName(syn)


def enrich_alt_text(images: DataFrame, catalog_v1: DataFrame) -> DataFrame:
    """``existing + "\\n\\n" + description``; a found NULL or empty
    description leaves the alt text unchanged, a missing row appends the
    default text."""
    existing = F.coalesce(F.nullif(F.col("descr"), F.lit("")), F.nullif(F.col("name"), F.lit("")),
                          F.lit("image_" + GRAPHIC_URI))
    d = images.withColumn("existing", existing).withColumn("key", _embed_filename(F.col("embed_id")))
    first = first_by(catalog_v1, "filename", ["description"]).withColumnRenamed("filename", "key")
    first = first.withColumn("_hit", F.lit(True))
    d = d.join(first, "key", "left")
    desc = F.when(F.col("_hit"), F.col("description")).otherwise(F.lit(DEFAULT_DESCRIPTION))
    return d.select("doc_id", "img_idx", F.when(F.coalesce(desc, F.lit("")) != "",
                                                F.concat(F.col("existing"), F.lit("\n\n"), desc))
                    .otherwise(F.col("existing")).alias("alt_text"))
