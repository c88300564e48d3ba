"""Fixture views over the driver tables.

The driver tables hold no manuals, images or image references, so these views
derive them from ``documents``, ``benchmark``, ``conversations``, ``labels``
and ``embeddings`` by fixed rules.  Every view reads its whole source table.
The DuckDB twins of these views live in ``kbspark.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.joins import materialize
from kbspark.session import derived_once, read_table


class Fixtures:
    """Lazily built fixture frames for one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def _ingested(self, name, build):
        """As ``_get``, but written once per application and table folder, as an
        ingest would: every later query reads the written table."""
        return derived_once(self.spark, self.sf_dir, name, lambda: materialize(build()))

    # ------------------------------------------------------------ catalogue
    def assistants(self) -> DataFrame:
        """(id, name, assistant_key): one assistant per document source."""
        def build():
            d = self.table("documents")
            return (d.select((F.substring("source", 4, 1 << 20).cast("bigint") + 1).alias("id"),
                             F.col("source").alias("name"),
                             F.concat(F.lit("asst_"), F.col("source")).alias("assistant_key"))
                     .distinct())
        return self._ingested("assistants", build)

    def catalog(self) -> DataFrame:
        """images: one catalogue row per document; each filename occurs many
        times (first-row-wins), titles follow four figure/picture/text/NULL
        patterns, one description in five is NULL."""
        def build():
            d = self.table("documents")
            did = F.col("doc_id")
            k4 = did % 4
            title = (F.when(k4 == 0, F.concat(F.lit("Figura "), did.cast("string"), F.lit(": "), F.substring_index("text", "\n", 1)))
                      .when(k4 == 1, F.concat(F.lit("Picture "), did.cast("string")))
                      .when(k4 == 2, F.substring_index("text", "\n", 1)))
            return d.select(
                did.alias("image_row"),
                F.col("source").alias("filepath"),
                F.concat(F.col("source"), F.lit("_image_rId"), (did % 40).cast("string"), F.lit(".png")).alias("filename"),
                title.alias("title"),
                F.when(did % 2 == 0, F.lit("png")).otherwise(F.lit("jpg")).alias("ext"),
                F.when(did % 2 == 0, F.lit("image/png")).otherwise(F.lit("image/jpeg")).alias("content_type"),
                F.when(did % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("description"),
                (F.substring("source", 4, 1 << 20).cast("bigint") + 1).alias("assistant_id"))
        return self._get("catalog", build)

    def questions(self) -> DataFrame:
        """(question_id, question, assistant_name): benchmark passages as questions."""
        def build():
            b = self.table("benchmark")
            return b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"),
                            F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("assistant_name"))
        return self._get("questions", build)

    # ------------------------------------------------------------ threads
    def messages(self) -> DataFrame:
        """(thread_id, seq, role, text, created_at): conversations, assistant
        turns carrying image references (repeated, and one outside the ``smt``
        folder)."""
        def build():
            c = self.table("conversations")
            ref = F.concat(F.lit(" smt_figura"), F.col("turn").cast("string"), F.lit(".png (x_image_a.jpg) smt_figura"),
                           F.col("turn").cast("string"), F.lit(".png"))
            text = F.when(F.col("role") == "assistant", F.concat(F.col("text"), ref)).otherwise(F.col("text"))
            created = (F.lit("2024-01-01 00:00:00").cast("timestamp")
                       + F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int")))
            return c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role",
                            text.alias("text"), created.alias("created_at"))
        return self._get("messages", build)

    def runs_status(self) -> DataFrame:
        def build():
            c = self.table("conversations")
            return (c.select(F.col("conv_id").alias("thread_id")).distinct()
                     .select("thread_id", F.when(F.col("thread_id") % 4 == 0, "failed")
                             .when(F.col("thread_id") % 4 == 1, "requires_action")
                             .otherwise("completed").alias("status")))
        return self._get("runs_status", build)

    def tool_calls(self) -> DataFrame:
        def build():
            b = self.table("benchmark")
            i = F.col("item_id")
            k, k2 = (i % 25).cast("string"), (i % 20).cast("string")
            one = F.concat(F.lit('"src'), k, F.lit("_image_rId"), k, F.lit('.png"'))
            two = F.concat(F.lit('"src'), k2, F.lit("_image_rId"), k2, F.lit('.png"'))
            return b.select(i.alias("call_id"),
                            F.when(i % 7 == 3, "code_interpreter").otherwise("function").alias("call_type"),
                            F.when(i % 11 == 5, "other").when(i % 2 == 0, "get_image").otherwise("get_images").alias("function_name"),
                            F.when(i % 2 == 0, F.concat(F.lit('{"filename":'), one, F.lit("}")))
                             .otherwise(F.concat(F.lit('{"query":['), one, F.lit(","), two, F.lit("]}"))).alias("arguments"))
        return self._get("tool_calls", build)

    def checklist(self) -> DataFrame:
        def build():
            l, d = self.table("labels"), self.table("documents")
            return (l.join(d.select("doc_id", "source"), "doc_id")
                     .select(F.col("doc_id").alias("question_id"), F.col("source").alias("assistant_name"),
                             F.col("quality").alias("correct")))
        return self._get("checklist", build)

    # ------------------------------------------------------------ vectors
    def vec_catalog(self) -> DataFrame:
        """(image_row, title_vec, desc_vec): row v has title e[v] and
        description e[v+1] (NULL for the last vector)."""
        def build():
            e = self.table("embeddings").select("vec_id", "embedding")
            nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("desc_vec"))
            return (e.join(nxt, "vec_id", "left")
                     .select(F.col("vec_id").alias("image_row"), F.col("embedding").alias("title_vec"), "desc_vec"))
        return self._get("vec_catalog", build)

    def vec_questions(self) -> DataFrame:
        """(question_id, q_vec): question v is e[v] + e[v+1]."""
        def build():
            e = self.table("embeddings").select("vec_id", "embedding")
            nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
            return (e.join(nxt, "vec_id")
                     .select(F.col("vec_id").alias("question_id"),
                             F.zip_with("embedding", "e2", lambda x, y: x + y).alias("q_vec")))
        return self._get("vec_questions", build)

    # ------------------------------------------------------------ ingest
    def filepaths(self) -> DataFrame:
        """(doc_id, filepath): each manual is ingested into its source folder."""
        return self._get("filepaths", lambda: self.table("documents").select("doc_id", F.col("source").alias("filepath")))

    def new_images(self) -> DataFrame:
        """C4 input: extracted images named by F5 -> F6 -> F2, per manual."""
        def build():
            from kbspark.functions import text as tx
            from kbspark.operators.rewrite import image_filename
            i = self.doc_images()
            return i.select("doc_id", "img_idx", F.col("source").alias("filepath"), image_filename(i).alias("filename"),
                            "content_type", tx.alt_text_fallback("descr", "name", "img_idx").alias("title"),
                            F.concat(F.lit("asst_"), F.col("source")).alias("assistant_key"))
        return self._ingested("new_images", build)

    def captions(self) -> DataFrame:
        """Captions supplied by an outside captioner for the odd-numbered
        images, keyed by stored filename (first image wins on a shared name)."""
        def build():
            n = self.new_images().where(F.col("img_idx") % 2 == 1)
            return (n.select(F.concat(F.col("filepath"), F.lit("_"), F.col("filename")).alias("filename"),
                             F.concat(F.lit("Legenda: "), F.col("title")).alias("description"), "doc_id", "img_idx")
                     .groupBy("filename").agg(F.min_by("description", F.struct("doc_id", "img_idx")).alias("description")))
        return self._ingested("captions", build)

    def kb_catalog(self) -> DataFrame:
        """The catalogue after ingesting every manual's images with captions (C4)."""
        def build():
            from kbspark.operators.catalog import append_images
            return append_images(self.catalog(), self.new_images(), self.assistants(), self.captions())
        return self._ingested("kb_catalog", build)

    def kb_catalog_v1(self) -> DataFrame:
        """v1 projection: filenames without the ``{filepath}_`` prefix."""
        return self._get("kb_catalog_v1", lambda: self.kb_catalog().withColumn(
            "filename", F.regexp_replace("filename", "^[^_]*_", "")))

    # ------------------------------------------------------------ manuals
    def doc_images(self) -> DataFrame:
        """Inline images extracted from the manuals: one per drawing run whose
        relation resolves (a drawing with ``(para_idx + run_idx) % 3 = 2`` has
        none and yields no image, so drawings and images drift apart as in a
        real manual).  ``img_idx`` numbers the images of a document (D8)."""
        def build():
            from kbspark.operators.rewrite import image_ordinals
            r = self.doc_runs().where(F.col("kind") == "drawing")
            r = r.where((F.col("para_idx") + F.col("run_idx")) % 3 != 2)
            r = image_ordinals(r)
            emb = F.concat(F.lit("rId"), (F.col("doc_id") % 20 + 20 * ((F.col("para_idx") + F.col("run_idx")) % 3)).cast("string"))
            return r.select("doc_id", "source", "img_idx", "para_idx", "run_idx",
                            F.col("text").alias("descr"),
                            F.concat(F.lit("Imagem "), F.col("img_idx").cast("string")).alias("name"),
                            emb.alias("embed_id"),
                            F.when((F.col("para_idx") + F.col("run_idx")) % 2 == 0, F.lit("png")).otherwise(F.lit("")).alias("ext"),
                            F.lit("image/png").alias("content_type"),
                            F.encode(F.col("text"), "UTF-8").alias("content"))
        return self._ingested("doc_images", build)

    def doc_runs(self) -> DataFrame:
        """(doc_id, source, para_idx, run_idx, kind, text): every document
        split into paragraphs (newline) and runs ('. '); one run in seven is a
        drawing."""
        def build():
            d = self.table("documents")
            p = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("para_idx", "para"))
            r = p.select("doc_id", "source", "para_idx", F.posexplode(F.split("para", "[.] ")).alias("run_idx", "text"))
            kind = F.when((F.col("doc_id") + F.col("para_idx") + F.col("run_idx")) % 7 == 0, "drawing").otherwise("text")
            return r.select("doc_id", "source", "para_idx", "run_idx", kind.alias("kind"), "text")
        return self._ingested("doc_runs", build)
