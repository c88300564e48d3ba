"""Writer of the .docx manuals that the ingest checks read: test data, derived
from the tables by a Spark job.  Not part of the library's operators."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.sources.docx import IMAGE_REL, NS

_CT = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
       '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
       '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
       '<Default Extension="xml" ContentType="application/xml"/>'
       '<Default Extension="png" ContentType="image/png"/>'
       '<Override PartName="/word/document.xml" '
       'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>{over}</Types>')
_ROOT_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
              '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
              '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/'
              'officeDocument" Target="word/document.xml"/></Relationships>')
_XML_BAD = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def _esc(s: str) -> str:
    s = _XML_BAD.sub("", s)
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _drawing(descr: str, name: str, emb: str, pid: int) -> str:
    return ('<w:drawing><wp:inline><wp:docPr id="{pid}" name="{name}"/><a:graphic><a:graphicData '
            'uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic><pic:nvPicPr>'
            '<pic:cNvPr id="{pid}" name="{name}" descr="{descr}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill>'
            '<a:blip r:embed="{emb}"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing>'
            ).format(pid=pid, name=_esc(name), descr=_esc(descr), emb=emb)


def build_docx(paragraphs: list[list[dict]]) -> bytes:
    """A minimal docx: paragraphs of runs; a run is ``{"text": …}`` or
    ``{"drawing": True, "descr", "name", "embed", "media": bytes|None, "ext"}``
    (``media`` None leaves the relation out)."""
    body, rels, over = [], [], []
    pid = 0
    for runs in paragraphs:
        out = []
        for r in runs:
            if r.get("drawing"):
                pid += 1
                out.append(f"<w:r>{_drawing(r['descr'], r['name'], r['embed'], pid)}</w:r>")
                if r.get("media") is not None:
                    part = f"media/image{pid}" + (f".{r['ext']}" if r.get("ext") else "")
                    rels.append((r["embed"], part, r["media"]))
                    if not r.get("ext"):
                        over.append(f'<Override PartName="/word/{part}" ContentType="image/png"/>')
            else:
                out.append(f'<w:r><w:t xml:space="preserve">{_esc(r["text"])}</w:t></w:r>')
        body.append("<w:p>" + "".join(out) + "</w:p>")
    doc = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           f'<w:document xmlns:w="{NS["w"]}" xmlns:wp="{NS["wp"]}" xmlns:a="{NS["a"]}" xmlns:pic="{NS["pic"]}" '
           f'xmlns:r="{NS["r"]}"><w:body>' + "".join(body) + "</w:body></w:document>")
    drels = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
             f'<Relationships xmlns="{NS["rel"]}">'
             + "".join(f'<Relationship Id="{i}" Type="{IMAGE_REL}" Target="{p}"/>' for i, p, _ in rels)
             + "</Relationships>")
    buf = io.BytesIO()
    # the body is packed; small parts and pictures are stored as they are
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        z.writestr("[Content_Types].xml", _CT.format(over="".join(over)))
        z.writestr("_rels/.rels", _ROOT_RELS)
        z.writestr("word/document.xml", doc, zipfile.ZIP_DEFLATED, 1)
        z.writestr("word/_rels/document.xml.rels", drels)
        for _i, p, blob in rels:
            z.writestr("word/" + p, blob)
    return buf.getvalue()


# Files of one subfolder.
FOLDER_FILES = 1000
MANUAL_RESULT = "doc_id long, path string, n_bytes long"


def write_manuals(runs: DataFrame, folder: str) -> DataFrame:
    """One ``manual_<doc_id>.docx`` per document from run rows
    (doc_id, para_idx, run_idx, kind, text, descr, name, embed, media, ext),
    in subfolders of a bounded number of files.  Returns (doc_id, path, n_bytes)
    lazily.  A task reads its runs in order and holds one manual at a time."""
    names = ["doc_id", "para_idx", "run_idx", "kind", "text", "descr", "name", "embed", "media", "ext"]
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # through the folder's own file system (local, file:, hdfs:, s3: ...),
        # so executors write to the shared folder wherever it lives
        fs, base = pafs.FileSystem.from_uri(folder)
        part, n = f"part-{TaskContext.get().partitionId():05d}", 0  # a task run again writes the same files
        done: list[tuple[int, str, int]] = []

        def close(doc_id: int, paras: list[list[dict]]) -> None:
            nonlocal n
            sub = f"{part}-{n // FOLDER_FILES}"
            if n % FOLDER_FILES == 0:
                fs.create_dir(f"{base.rstrip('/')}/{sub}", recursive=True)
            n += 1
            doc_id, blob = int(doc_id), build_docx(paras)
            with fs.open_output_stream(f"{base.rstrip('/')}/{sub}/manual_{doc_id}.docx") as out:
                out.write(blob)
            done.append((doc_id, f"{folder.rstrip('/')}/{sub}/manual_{doc_id}.docx", len(blob)))

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done) if done else ((), (), ()), (pa.int64(), pa.string(), pa.int64()))],
                                             ["doc_id", "path", "n_bytes"])
            done.clear()
            return out

        none = object()
        at, last, paras = none, None, []
        for batch in batches:
            for doc_id, para, _, kind, text, descr, name, embed, media, ext in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not none and doc_id != at:
                    close(at, paras)
                    paras, last = [], None
                at = doc_id
                if para != last or not paras:
                    paras.append([])
                    last = para
                if kind == "drawing":
                    paras[-1].append(dict(drawing=True, descr=descr or "", name=name or "", embed=embed, media=media, ext=ext or ""))
                else:
                    paras[-1].append(dict(text=text or ""))
            if len(done) >= FOLDER_FILES:
                yield rows()
        if at is not none:
            close(at, paras)
        yield rows()

    ordered = runs.select(*names).repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "para_idx", "run_idx")
    return ordered.mapInArrow(write, MANUAL_RESULT)


def manual_runs(doc_runs: DataFrame, doc_images: DataFrame) -> DataFrame:
    """Run rows for ``write_manuals``: drawings carry their picture attributes;
    a drawing with no extracted image keeps an embed id without relation."""
    d = doc_runs.withColumn("_dord", F.when(F.col("kind") == "drawing", F.row_number().over(
        Window.partitionBy("doc_id", F.col("kind")).orderBy("para_idx", "run_idx"))))
    img = doc_images.select("doc_id", "para_idx", "run_idx", "name", "ext", "content")
    d = d.join(img, ["doc_id", "para_idx", "run_idx"], "left")
    return d.select("doc_id", "para_idx", "run_idx", "kind", "text",
                    F.when(F.col("kind") == "drawing", F.col("text")).alias("descr"),
                    F.when(F.col("kind") == "drawing", F.coalesce("name", F.concat(F.lit("Imagem "), F.col("_dord").cast("string"))))
                     .alias("name"),
                    F.concat(F.lit("rId"), (F.lit(1000) + F.col("_dord")).cast("string")).alias("embed"),
                    F.col("content").alias("media"), "ext")
