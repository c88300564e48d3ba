"""Scalar text functions (F1-F18) as Spark Column expressions.

Everything here is a JVM-side expression except the narrow Arrow fallbacks of
``strip_accents`` / ``ascii_slug`` that only receive rows holding characters a
one-to-one ``translate`` table cannot express.
"""

from __future__ import annotations

import mimetypes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.functions import unicode_tables as ut
from kbspark.functions.unicode_tables import ascii_fold_py, strip_marks_py

# Python's str.isspace / str.split() whitespace: Unicode White_Space plus the
# four information separators U+001C..U+001F.
_WS = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]"

# Fixed values that must equal the reference's output for right results.
# F2 prefixes, F7/F8 patterns, F11/F12 templates, F18 marker.
FIGURA_PREFIX = "figura"
PICTURE_PREFIX = "picture"
IMAGE_NAME_PATTERN = r"\b\w+_(?:figura|image|picture)[^\s]+\.(?:png|jpg|jpeg)\b"
IMAGE_NAME_PATTERN_V0 = r"image_.*?\.(?:png|jpg)"
LINK_TEMPLATE = '<a href="%s">Imagem: %d</a>'
FOUND_TEMPLATE = "Encontrei este print no manual: [Clique aqui para ver](%s)"
APPEND_SEPARATOR = " \n\n"
# MIME types as the standard library's own table has them (no system files).
MIME_BY_EXTENSION = {ext[1:]: kind for ext, kind in sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items())}
CITATION_PATTERN = "【[^】]*】"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def explode_computed(arr) -> Column:
    """``explode`` of an array built by an expensive expression (tokenising
    whole texts).  For a plain explode Spark infers ``size(arr) > 0 AND arr IS
    NOT NULL`` and pushes it below the projection, and below an exchange, so
    the expression runs twice per row; ``explode_outer`` infers nothing.  It
    gives one NULL element for an empty or NULL array: callers drop it."""
    return F.explode_outer(_col(arr))


# ---------------------------------------------------------------- F1
def normalize_text(c) -> Column:
    """lower, runs of non-word characters to one space, strip.

    Python's ``\\W`` is Unicode-aware; Java's is not, so the class is spelled
    out as letters, numbers and underscore."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_]+", " "))


# ---------------------------------------------------------------- F3 / F4
@F.pandas_udf(T.StringType())
def _strip_marks_udf(s: pd.Series) -> pd.Series:
    return s.map(strip_marks_py, na_action="ignore")


@F.pandas_udf(T.StringType())
def _ascii_fold_udf(s: pd.Series) -> pd.Series:
    return s.map(ascii_fold_py, na_action="ignore")


def _needs_fallback(c: Column, ranges) -> Column:
    """Rows holding a character whose rewritten form is longer than one
    character, or any supplementary-plane character: deleting the listed
    characters with ``translate`` (a hash lookup per character) shortens the
    string, or the one-range regex finds a surrogate pair."""
    listed = "".join(chr(x) for a, b in ranges for x in range(a, b + 1))
    shorter = F.length(F.translate(c, listed, "")) < F.length(c)
    return shorter | c.rlike("[\\x{10000}-\\x{10FFFF}]")


def strip_accents(c) -> Column:
    """NFD, then drop combining marks (category Mn)."""
    c = _col(c)
    src, dst, deleted, long_ranges = ut.accent_table()
    fast = F.translate(c, src + deleted, dst)
    slow = _needs_fallback(c, long_ranges)
    return F.when(slow, _strip_marks_udf(F.when(slow, c))).otherwise(fast)


def ascii_fold(c) -> Column:
    """NFKD, then keep ASCII characters only."""
    c = _col(c)
    src, dst, _deleted, long_ranges = ut.ascii_fold_table()
    fast = F.regexp_replace(F.translate(c, src, dst), r"[^\x{0}-\x{7F}]", "")
    slow = _needs_fallback(c, long_ranges)
    return F.when(slow, _ascii_fold_udf(F.when(slow, c))).otherwise(fast)


def ascii_slug(c) -> Column:
    """NFKD to ASCII, drop ``[^\\w\\s-]``, strip, lower, ``[-\\s]+`` to ``_``."""
    t = F.regexp_replace(ascii_fold(c), r"[^\w\s-]", "")
    t = F.lower(F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.regexp_replace(t, r"[-\s]+", "_")


# ---------------------------------------------------------------- F2 / F5 / F6
def _python_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def _number_text(digits: Column, width: int) -> Column:
    """Decimal digit string (any script) -> ``int()`` printed with ``%0{width}d``,
    without a numeric cast so that long digit runs cannot overflow."""
    src, dst = ut.digit_table()
    ascii_digits = F.translate(digits, src, dst)
    trimmed = F.regexp_replace(ascii_digits, "^0+", "")
    trimmed = F.when(trimmed == "", F.lit("0")).otherwise(trimmed)
    if width <= 1:
        return trimmed
    return F.when(F.length(trimmed) < width, F.lpad(trimmed, width, "0")).otherwise(trimmed)


def filename_from_alt_text(alt, ext) -> Column:
    """``figura N`` -> ``figuraNN.ext``; ``picture N`` -> ``pictureN.ext``;
    otherwise whitespace removed and accents stripped, no extension added."""
    t = F.lower(_python_strip(_col(alt)))
    ext = _col(ext)
    fig = F.regexp_extract(t, rf"(?U)^{FIGURA_PREFIX}{_WS}*(\d+)", 1)
    pic = F.regexp_extract(t, rf"(?U)^{PICTURE_PREFIX}{_WS}*(\d+)", 1)
    plain = strip_accents(F.regexp_replace(t, f"{_WS}+", ""))
    return (F.when(fig != "", F.concat(F.lit(FIGURA_PREFIX), _number_text(fig, 2), F.lit("."), ext))
             .when(pic != "", F.concat(F.lit(PICTURE_PREFIX), _number_text(pic, 1), F.lit("."), ext))
             .otherwise(plain))


def alt_text_fallback(descr, name, ordinal) -> Column:
    """descr, else name, else ``image_%04d`` of the 1-based ordinal; empty counts as missing."""
    return F.coalesce(F.nullif(_col(descr), F.lit("")), F.nullif(_col(name), F.lit("")),
                      F.format_string("image_%04d", _col(ordinal)))


def extension_default(ext) -> Column:
    """missing or empty extension becomes ``png``."""
    return F.coalesce(F.nullif(_col(ext), F.lit("")), F.lit("png"))


# ---------------------------------------------------------------- F7 - F12
def extract_image_names(c) -> Column:
    """every image filename in the text, in order, duplicates kept."""
    return F.regexp_extract_all(_col(c), F.lit("(?U)" + IMAGE_NAME_PATTERN), F.lit(0))


def extract_image_names_v0(c) -> Column:
    """F8: older non-greedy pattern; ``.`` stops only at ``\\n`` as in Python."""
    return F.regexp_extract_all(_col(c), F.lit("(?d)" + IMAGE_NAME_PATTERN_V0), F.lit(0))


def remove_names(text, names) -> Column:
    """delete every extracted filename from the text, one after another
    (literal match; see README on the reference's unescaped pattern)."""
    return F.aggregate(_col(names), _col(text), lambda acc, f: F.replace(acc, f, F.lit("")))


def image_urls(names, base_url: str) -> Column:
    """base URL + filename, per name."""
    return F.transform(_col(names), lambda f: F.concat(F.lit(base_url), f))


def append_html_links(text, urls) -> Column:
    """append numbered ``<a href>`` links after ``" \\n\\n"`` when any."""
    urls = _col(urls)
    links = F.array_join(F.transform(urls, lambda u, i: F.format_string(LINK_TEMPLATE, u, i + 1)), "\n")
    return F.when(F.size(urls) > 0, F.concat(_col(text), F.lit(APPEND_SEPARATOR), links)).otherwise(_col(text))


def append_found_line(text, url) -> Column:
    """append the "found this picture" markdown line when a match exists."""
    url = _col(url)
    return F.when(url.isNotNull(),
                  F.concat(_col(text), F.lit(APPEND_SEPARATOR), F.format_string(FOUND_TEMPLATE, url))
                  ).otherwise(_col(text))


# ---------------------------------------------------------------- F13 / F15 - F18
def image_folder(filename) -> Column:
    """the prefix before the first ``_`` names the folder."""
    return F.split_part(_col(filename), F.lit("_"), F.lit(1))


def image_path(filename) -> Column:
    f = _col(filename)
    return F.concat(image_folder(f), F.lit("/"), f)


def image_mime(filename) -> Column:
    """MIME type from the last extension (case-insensitive), else NULL."""
    ext = F.lower(F.regexp_extract(_col(filename), r"\.([^./]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    return F.try_element_at(known, ext)


def to_base64(content) -> Column:
    """standard base64 on one line (Spark may wrap lines at 76 characters)."""
    return F.regexp_replace(F.base64(_col(content)), "[\r\n]", "")


REGISTRY_NAME = r'"assistantName": "([^"]*)"'
REGISTRY_ID = r'"assistantID": (asst_\w+)'


def registry_name(line) -> Column:
    """F16: assistant name in a registry line."""
    return F.regexp_extract(_col(line), REGISTRY_NAME, 1)


def registry_id(line) -> Column:
    """F16: assistant id following the name in a registry line."""
    return F.nullif(F.regexp_extract(_col(line), r'"assistantName": "[^"]*".*?' + REGISTRY_ID, 1), F.lit(""))


TOOL_ARGS_SCHEMA = "filename string, query array<string>"


def parse_tool_arguments(c) -> Column:
    """tool-call JSON arguments -> struct(filename, query)."""
    return F.from_json(_col(c), TOOL_ARGS_SCHEMA)


def strip_citations(c) -> Column:
    """remove ``【…】`` citation markers."""
    return F.regexp_replace(_col(c), CITATION_PATTERN, "")
