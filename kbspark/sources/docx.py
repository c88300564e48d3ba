"""Manuals as ``.docx`` files (I1, I2): list folders and read files in tasks, so
that the driver holds no list of files, and explode each file into ordered runs and inline images in tasks (stdlib ``zipfile`` and one
incremental ``ElementTree`` pass per file); everything after is native columns.

The pass yields runs and images as one stream of tagged rows and forgets each
run, and each other part of the body, once its rows are out; rows leave in
batches of bounded size.  So memory is bounded by the file, its largest run and
its largest image, however many runs it has.

Parsing rules (python-docx behaviour the reference relies on):
* paragraphs are the body-level ``w:p``; runs are their direct ``w:r``; a run
  holding a ``w:drawing`` is a drawing run (its text is empty here), other
  runs' text joins ``w:t`` (``w:tab`` -> tab, ``w:br``/``w:cr`` -> newline);
* images are every ``wp:inline`` in document order (tables included) whose
  ``pic:cNvPr`` exists and whose ``a:blip`` relation resolves to an image
  part; an unresolved relation yields no image (the drawing still counts as
  a drawing run); ``img_idx`` numbers the images kept.
A file that is not a readable docx yields one row with ``error`` set.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from kbspark.operators.joins import materialize

# The Office Open XML namespaces and relationship type.
NS = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "pic": "http://schemas.openxmlformats.org/drawingml/2006/picture",
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "rel": "http://schemas.openxmlformats.org/package/2006/relationships",
    "ct": "http://schemas.openxmlformats.org/package/2006/content-types",
}
IMAGE_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"

RUNS_SCHEMA = ("path string, para_idx int, run_idx int, kind string, text string, embed_id string, "
               "n_drawings int, error string")
IMAGES_SCHEMA = ("path string, img_idx int, para_idx int, run_idx int, descr string, name string, embed_id string, "
                 "ext string, content_type string, content binary, error string")
PARTS_SCHEMA = ("part string, path string, para_idx int, run_idx int, kind string, text string, embed_id string, n_drawings int, "
                "img_idx int, descr string, name string, ext string, content_type string, content binary, error string")
# Rows of one batch, and bytes of images after which a batch is closed.
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20


def _q(prefix: str, tag: str) -> str:
    return f"{{{NS[prefix]}}}{tag}"


P, R, BODY, T_, DRAWING = (_q("w", t) for t in ("p", "r", "body", "t", "drawing"))
TEXT_OF = {_q("w", "tab"): "\t", _q("w", "br"): "\n", _q("w", "cr"): "\n"}


def _run_text(r) -> str:
    return "".join([(el.text or "") if el.tag == T_ else TEXT_OF[el.tag] for el in r.iter() if el.tag == T_ or el.tag in TEXT_OF])


class _Unread:
    """A parser target that keeps nothing."""

    def close(self) -> None:
        return None


class _Package:
    """The parts of a readable docx: its body as a stream, relations and images."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        # read through once, so that a broken document gives no rows at all
        checked = ET.XMLParser(target=_Unread())
        with self.zip.open("word/document.xml") as xml:
            while piece := xml.read(1 << 16):
                checked.feed(piece)
        checked.close()
        self.rels = {}
        for rel in self._part("word/_rels/document.xml.rels"):
            self.rels[rel.get("Id")] = (rel.get("Type"), rel.get("Target"), rel.get("TargetMode"))
        self.default, self.override = {}, {}
        for el in self._part("[Content_Types].xml"):
            if el.tag == _q("ct", "Default"):
                self.default[el.get("Extension", "").lower()] = el.get("ContentType")
            elif el.tag == _q("ct", "Override"):
                self.override[el.get("PartName")] = el.get("ContentType")

    def _part(self, name: str):
        try:
            return ET.fromstring(self.zip.read(name))
        except KeyError:
            return ()

    def body_parts(self) -> Iterator[tuple[str, int | None, int | None, ET.Element]]:
        """The body bit by bit: ``("run", para, run, element)``, ``("other",
        None, None, element)`` for what else a body holds, and ``("empty",
        para, None, paragraph)`` for paragraphs without runs.  An element is
        forgotten when the next one is asked for."""
        stack: list[ET.Element] = []
        body = None
        para, runs = -1, 0
        with self.zip.open("word/document.xml") as xml:
            for event, el in ET.iterparse(xml, events=("start", "end")):
                if event == "start":
                    stack.append(el)
                    if len(stack) == 2 and el.tag == BODY and body is None:
                        body = el
                    elif len(stack) == 3 and stack[1] is body and el.tag == P:
                        para, runs = para + 1, 0
                    continue
                stack.pop()
                if body is None or len(stack) < 2 or stack[1] is not body:
                    continue
                if len(stack) == 2:
                    if el.tag != P:
                        yield "other", None, None, el
                    elif not runs:
                        yield "empty", para, None, el
                    body.remove(el)
                elif len(stack) == 3 and stack[2].tag == P:
                    if el.tag == R:
                        yield "run", para, runs, el
                        runs += 1
                    else:
                        yield "other", None, None, el
                    stack[2].remove(el)

    def image(self, inline: ET.Element) -> tuple | None:
        """``(descr, name, embed id, ext, content type, content)`` of an inline
        picture whose relation resolves."""
        c, blip = inline.find(f".//{_q('pic', 'cNvPr')}"), inline.find(f".//{_q('a', 'blip')}")
        if c is None or blip is None:
            return None
        emb = blip.get(_q("r", "embed"))
        rel = self.rels.get(emb)
        if rel is None or rel[0] != IMAGE_REL or rel[2] == "External":
            return None
        part = "word/" + rel[1] if not rel[1].startswith("/") else rel[1][1:]
        part = re.sub(r"/[^/]+/\.\./", "/", part)
        try:
            blob = self.zip.read(part)
        except KeyError:
            return None
        m = re.search(r"\.([^./]+)$", part)
        ext = m.group(1).lower() if m else ""
        return c.get("descr"), c.get("name"), emb, ext, self.override.get("/" + part) or self.default.get(ext), blob


def parse_manual(path: str, content: bytes, parts: tuple[str, ...] = ("run", "image")) -> Iterator[dict]:
    """Tagged rows of one file in document order: ``part`` is ``run``,
    ``image`` or, for an unreadable file, ``error``."""
    try:
        package = _Package(content)
    except Exception as e:  # corrupt or not a docx: error row, job goes on
        yield dict(part="error", path=path, n_drawings=0, error=f"{type(e).__name__}: {e}")
        return
    images = 0
    for what, para, run, el in package.body_parts():
        if what != "other" and "run" in parts:
            drawings = list(el.iter(DRAWING)) if what == "run" else []
            blip = drawings[0].find(f".//{_q('a', 'blip')}") if drawings else None
            kind = "empty" if what == "empty" else "drawing" if drawings else "text"
            yield dict(part="run", path=path, para_idx=para, run_idx=run, kind=kind, text=_run_text(el) if kind == "text" else "",
                       embed_id=None if blip is None else blip.get(_q("r", "embed")), n_drawings=len(drawings))
        if what != "empty" and "image" in parts:
            for drawing in el.iter(DRAWING):
                for inline in drawing.findall(_q("wp", "inline")):
                    if found := package.image(inline):
                        images += 1
                        yield dict(zip(("descr", "name", "embed_id", "ext", "content_type", "content"), found),
                                   part="image", path=path, img_idx=images, para_idx=para, run_idx=run)


def _file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder named as Spark names it, and its path there."""
    if root.startswith("file:/"):  # not percent-encoded
        return pafs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(root)


def _wanted(entry: pafs.FileInfo) -> bool:
    """Folders and manuals, without what Spark's readers leave out: what is
    hidden or still being copied, and empty files."""
    name = entry.base_name
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    if entry.type == pafs.FileType.Directory:
        return not hidden or name.startswith(("_common_metadata", "_metadata"))
    return entry.type == pafs.FileType.File and not hidden and name.endswith(".docx") and entry.size > 0


def _folders(spark: SparkSession, folder: str) -> list[str]:
    """Full names of the folders meant by ``folder`` (which may be a pattern) if
    tasks can open them without Spark's readers, else none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(store.makeQualified(path))
    roots = [(f.getPath().toString().rstrip("/"), f.isDirectory()) for f in found or []]
    try:
        reached = [fs.get_file_info(at).type == pafs.FileType.Directory for fs, at in (_file_system(root) for root, _ in roots)]
    except (OSError, ValueError, NotImplementedError):
        return []
    return [root for root, _ in roots] if all(reached) and all(is_folder for _, is_folder in roots) else []


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over ``(root, path)`` of folders: their manuals, and their
    folders with a null length."""
    for batch in batches:
        for root, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, base = _file_system(root)
            base = base.rstrip("/")
            found = [(root, root + i.path[len(base):], i.size if i.type == pafs.FileType.File else None)
                     for i in fs.get_file_info(pafs.FileSelector(base + folder[len(root):] or "/")) if _wanted(i)]
            for a in range(0, len(found), BATCH_ROWS):
                columns = zip(*found[a:a + BATCH_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["root", "path", "length"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over ``(root, path, length)`` of files: each with its content."""
    rows: list[tuple[str, int, bytes]] = []
    held = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["path", "length", "content"])

    for batch in batches:
        for root, path, length in zip(*(c.to_pylist() for c in batch.columns)):
            fs, base = _file_system(root)
            with fs.open_input_stream(base.rstrip("/") + path[len(root):], compression=None) as file:
                rows.append((path, length, file.read()))
            held += len(rows[-1][2])
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


def scan_manuals(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``.docx`` under ``folder`` as (path, length, content).  Folders
    are listed level by level in tasks, the list is a written table, and the
    files are read in a number of tasks that follows the cluster: Spark's reader
    would keep each file's status and place in a task on the driver.  It remains
    for stores that only it can open, single files and folders that are missing.
    A task holds the names in one folder at a time."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    roots = _folders(spark, folder)
    if not roots:
        return (spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true")
                     .load(folder).select("path", "length", "content").coalesce(tasks))
    level = spark.createDataFrame([(root, root) for root in roots], "root string, path string")
    files = None
    while files is None or not level.isEmpty():
        found = materialize((level if files is None else level.repartition(tasks, "path")).mapInArrow(_list, "root string, path string, length long"))
        level, here = found.where("length is null").select("root", "path"), found.where("length is not null")
        files = here if files is None else files.unionByName(here)
    return files.repartition(tasks, "path").mapInArrow(_read, "path string, length long, content binary")


def explode_parts(files: DataFrame, parts: tuple[str, ...] = ("run", "image")) -> DataFrame:
    """Every manual's runs and images from one parse, as tagged rows
    (``PARTS_SCHEMA``); an unreadable file has one ``error`` row."""
    names = [c.split()[0] for c in PARTS_SCHEMA.split(", ")]
    kinds = [{"int": pa.int32(), "binary": pa.binary()}.get(c.split()[1], pa.string()) for c in PARTS_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for row in parse_manual(path.as_py(), content.as_py(), parts):
                    rows.append(row)
                    held += len(row.get("content") or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return files.select("path", "content").mapInArrow(run, PARTS_SCHEMA)


def runs_of(parts: DataFrame) -> DataFrame:
    """The runs among tagged rows, and the files that could not be read."""
    return parts.where("part in ('run', 'error')").select(*[c.split()[0] for c in RUNS_SCHEMA.split(", ")])


def images_of(parts: DataFrame) -> DataFrame:
    """The inline images among tagged rows, and the files that could not be read."""
    return parts.where("part in ('image', 'error')").select(*[c.split()[0] for c in IMAGES_SCHEMA.split(", ")])


def explode_runs(files: DataFrame) -> DataFrame:
    """One row per paragraph run (paragraphs without runs keep one ``empty`` row)."""
    return runs_of(explode_parts(files, ("run",)))


def explode_images(files: DataFrame) -> DataFrame:
    """One row per extracted inline image."""
    return images_of(explode_parts(files, ("image",)))
