"""Main-text extraction by template deduction over the pages of a host.

Every tag path and every block of text is a token.  Tokens of one host that
occur equally often on every page share an occurrence vector and form an
equivalence class; the vectors are compared by an order-free hash sum, so that
a host of any size is counted with map-side partial sums and no task ever holds
a vector.  A class is valid if enough different pages carry it and a tag belongs
to it.  The tags of valid classes are the host's template.  They nest by their
paths, and need no join for it: a page with a tag has the tag's parent, so the
parent is on at least as many different pages and valid too.  Texts with the
vector of a valid class are fixed, and what varies between them are the slots.  A page's main
text are its slots inside the content element, without page furniture; a page
that marks no content element keeps all its slots.  Where no template covers a
place, a lone label there (short bare text in a container of its own) is dropped
unless the page has nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import written
from kbspark.llm.html_pages import Block, read_page

#: Different pages of a host that a class must be on before its texts count as fixed.
SUPPORT = 20
TAG, TEXT, SLOT = 0, 1, 2
#: A page is one token of its own: its vector is 1 everywhere, and so is the root class's.
ROOT = "#page"
#: Characters that bare text of a container, which no template covers, may have as a label.
LABEL = 40
SENTENCE = re.compile(r"""[.!?:;…。！？]["'”’)\]]*$""")
LEAF = re.compile(r"/(?:p|li|h[1-6]|dt|dd|td|th|tr|blockquote|pre)(?:\.[^/]*)?$")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def token(path: str, text: str = "") -> int:
    return signed(xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "replace")))


def container(path: str) -> str:
    while (m := LEAF.search(path)):
        path = path[:m.start()]
    return path


def _host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def page_tokens(pages: DataFrame) -> DataFrame:
    """``(host, page, copies, token, kind, n, path, parent)`` of ``(host, html,
    page, copies)``: tags and texts with their counts on the page, and the places of text on unmarked
    pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                rows = []
                for host, page, key, copies in zip(*(column.to_pylist() for column in batch.columns)):
                    blocks, tags = read_page(page)
                    key = key, copies
                    rows.append((host, *key, token(ROOT), TAG, 1, ROOT, None))
                    rows += [(host, *key, token(path), TAG, n, path, None) for path, n in tags.items()]
                    counts: dict[tuple[str, str], int] = {}
                    marked = content_kind(blocks)
                    for b in blocks:
                        counts[b.path, b.text] = counts.get((b.path, b.text), 0) + 1
                    rows += [(host, *key, token(path, text), TEXT, n, None, token(path)) for (path, text), n in counts.items()]
                    if not marked:
                        rows += [(host, *key, token(path), SLOT, 1, None, None) for path in {container(b.path) for b in blocks if not b.furniture}]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["host", "page", "copies", "token", "kind", "n", "path", "parent"])

    return pages.select("host", "html", "page", "copies").mapInArrow(run, "host string, page long, copies long, token long, kind int, n long, path string, parent long")


def deduce_templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """One row per host: ``host, fixed`` (tokens of its fixed texts) and
    ``slots`` (tokens of the template's containers with text on unmarked pages)."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("host", html.alias("html"), F.xxhash64(html).alias("page"))
    copies = written(keyed.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    keyed = keyed.join(copies, ["host", "page"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    # the copies of a page count as one page together, so that partial sums give the exact number of different pages
    different = F.round(F.sum(F.lit(1.0) / F.col("copies"))).cast("long").alias("different")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector")
    counted = written(page_tokens(keyed).groupBy("host", "kind", "token")
                      .agg(F.count(F.lit(1)).alias("pages"), different, vector,
                           F.min("path").alias("path"), F.min("parent").alias("parent"))
                      .where((F.col("kind") != TEXT) | (F.col("pages") >= support)), "tokens")
    valid = counted.where((F.col("kind") == TAG) & (F.col("different") >= support))
    classes = valid.select("host", "vector", "pages").distinct()
    # a text is fixed if its vector is a class's and its tag lies in the template
    texts = counted.where(F.col("kind") == TEXT).select("host", "vector", "pages", F.col("token").alias("text_token"), "parent")
    tags = valid.select("host", F.col("token").alias("parent"))
    fixed = (texts.join(classes, ["host", "vector", "pages"], "left_semi")
             .join(tags, ["host", "parent"], "left_semi")
             .groupBy("host").agg(F.collect_set("text_token").alias("fixed")))
    places = counted.where(F.col("kind") == SLOT).select("host", F.col("token").alias("parent"))
    slots = places.join(tags, ["host", "parent"], "left_semi").groupBy("host").agg(F.collect_set("parent").alias("slots"))
    hosts = counted.where(F.col("path") == ROOT).select("host")
    return hosts.join(fixed, "host", "left").join(slots, "host", "left")


def content_kind(blocks: list[Block]) -> str | None:
    """The element that marks the content of a page, if one does."""
    return next((k for k in ("main", "article") if any(b.content == k and not b.furniture for b in blocks)), None)


def _without_labels(blocks: list[Block], slots: set[int]) -> list[Block]:
    """The blocks of an unmarked page without lone labels outside the template."""
    texts: dict[str, list[Block]] = {}
    for b in blocks:
        texts.setdefault(container(b.path), []).append(b)
    labels = {path for path, (first, *more) in texts.items()
              if not more and first.path == path and len(first.text) <= LABEL and not SENTENCE.search(first.text) and token(path) not in slots}
    return [b for b in blocks if container(b.path) not in labels] or blocks


def main_blocks(blocks: list[Block], fixed: set[int], slots: set[int] | None) -> list[Block]:
    """The blocks of a page that are its main text."""
    kind = content_kind(blocks)
    own = [b for b in blocks if not b.furniture and (not kind or b.content == kind) and not (fixed and token(b.path, b.text) in fixed)]
    return own if kind else _without_labels(own, slots or set())


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: int = SUPPORT) -> DataFrame:
    """One row per row of ``df``: ``id, url, text, blocks``.

    ``text`` joins the main blocks by one space (empty if there are none);
    ``blocks`` lists them with their paths.  Null pages are empty, and rows
    without a readable url share one host.  Pages on hosts with fewer than
    ``support`` different pages lose no text as fixed.  Repeated rows give equal
    rows; an empty table gives none.  Other columns are not read.
    """
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), _host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    templates = written(deduce_templates(pages, support), "templates").select("host", "fixed", "slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, tuple[set[int], set[int]]] = {}
        for whole in batches:
            for batch in (whole.slice(at, 512) for at in range(0, whole.num_rows, 512)):
                texts, found = [], []
                for host, page, fixed, slots in zip(*(batch.column(name).to_pylist() for name in ("host", "html", "fixed", "slots"))):
                    if host not in kinds:
                        if len(kinds) > 1000:
                            kinds.clear()
                        kinds[host] = set(fixed or ()), set(slots or ())
                    own = main_blocks(read_page(page or "")[0], *kinds[host])
                    texts.append(" ".join(b.text for b in own))
                    found.append([{"path": b.path, "text": b.text} for b in own])
                struct = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(found, struct)], ["id", "url", "text", "blocks"])

    return pages.join(templates, "host", "left").select("id", "url", "host", "html", "fixed", "slots").mapInArrow(
        run, "id long, url string, text string, blocks array<struct<path:string,text:string>>")
