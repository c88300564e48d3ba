"""Scalar text functions: edge cases of FIXTURES.md section 4."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as tx


def one(spark, col_fn, *vals, schema=None):
    cols = schema or ", ".join(f"c{i} string" for i in range(len(vals)))
    df = spark.createDataFrame([tuple(vals)], cols)
    return df.select(col_fn(*[F.col(f"c{i}") for i in range(len(vals))]).alias("r")).first()["r"]


def py_norm(t):
    return re.sub(r"\W+", " ", t.lower()).strip()


@pytest.mark.parametrize("s", ["Ação º² é_x 10%", "é_x", "", "!!! ,,", "Tela  Início."])
def test_f1_matches_python(spark, s):
    assert one(spark, tx.normalize_text, s) == py_norm(s)


def test_f1_decomposed_mark_is_not_a_word_char(spark):
    assert one(spark, tx.normalize_text, "é_x") == "e _x"


@pytest.mark.parametrize("alt,ext,want", [
    ("Figura 1", "png", "figura01.png"),
    ("figura 123", "jpg", "figura123.jpg"),
    ("Picture 07", "png", "picture7.png"),
    (" Tela  Início.PNG ", "png", "telainicio.png"),
    ("Figura ١٢", "png", "figura12.png"),
])
def test_f2_filename_from_alt_text(spark, alt, ext, want):
    assert one(spark, tx.filename_from_alt_text, alt, ext) == want


def test_f3_translate_and_fallback(spark):
    samples = ["Ação É ñ", "한국어 텍스트", "\U0001d400 x", "Ǆ ﬁ"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(tx.strip_accents("t")).collect()]
    want = ["".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn") for s in samples]
    assert got == want


def test_f4_slug(spark):
    def py(t):
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
        t = re.sub(r"[^\w\s-]", "", t).strip().lower()
        return re.sub(r"[-\s]+", "_", t)
    samples = ["  Tela Início -- Menu! ", "ﬁle ½ test", "\U0001d400bc"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    assert [r[0] for r in df.select(tx.ascii_slug("t")).collect()] == [py(s) for s in samples]


def test_f5_alt_fallback(spark):
    df = spark.createDataFrame([("", "x", 1), (None, None, 1), (None, "", 12)], "d string, n string, o int")
    got = [r[0] for r in df.select(tx.alt_text_fallback("d", "n", "o")).collect()]
    assert got == ["x", "image_0001", "image_0012"]


def test_f6_extension_default(spark):
    df = spark.createDataFrame([("",), (None,), ("jpeg",)], "e string")
    assert [r[0] for r in df.select(tx.extension_default("e")).collect()] == ["png", "png", "jpeg"]


def test_f7_greedy_and_order(spark):
    s = "Ver smt_figura01.png, e smt_image_x.jpg,smt_picture2.jpeg fim"
    assert one(spark, tx.extract_image_names, s) == ["smt_figura01.png", "smt_image_x.jpg,smt_picture2.jpeg"]
    py = re.findall(r"\b\w+_(?:figura|image|picture)[^\s]+\.(?:png|jpg|jpeg)\b", s)
    assert one(spark, tx.extract_image_names, s) == py


def test_f8_non_greedy_stops_at_newline(spark):
    s = "a image_1.png b image_x\n.png image_2.jpg"
    assert one(spark, tx.extract_image_names_v0, s) == re.findall(r"image_.*?\.(?:png|jpg)", s)


def test_f9_f10_repeated_and_absent(spark):
    df = spark.createDataFrame([("x smt_figura1.png y smt_figura1.png",), ("no image",)], "t string")
    names = tx.extract_image_names("t")
    out = df.select(tx.remove_names("t", names).alias("c"), tx.image_urls(names, "/u/").alias("u")).collect()
    assert out[0]["c"] == "x  y " and out[0]["u"] == ["/u/smt_figura1.png", "/u/smt_figura1.png"]
    assert out[1]["c"] == "no image" and out[1]["u"] == []


def test_f11_links(spark):
    df = spark.createDataFrame([("t", ["a", "b"]), ("t", [])], "t string, u array<string>")
    got = [r[0] for r in df.select(tx.append_html_links("t", "u")).collect()]
    assert got == ['t \n\n<a href="a">Imagem: 1</a>\n<a href="b">Imagem: 2</a>', "t"]


def test_f13_path_and_mime(spark):
    df = spark.createDataFrame([("smt_figura1.PNG",), ("plain.jpg",), ("x_y.qqq",), ("x_y.pdf",), ("noext",)], "f string")
    got = df.select(tx.image_path("f"), tx.image_mime("f")).collect()
    assert [tuple(r) for r in got] == [("smt/smt_figura1.PNG", "image/png"), ("plain.jpg/plain.jpg", "image/jpeg"),
                                       ("x/x_y.qqq", None), ("x/x_y.pdf", "application/pdf"), ("noext/noext", None)]


def test_f15_base64_one_line(spark):
    df = spark.createDataFrame([(bytes(range(200)),)], "b binary")
    got = df.select(tx.to_base64("b")).first()[0]
    import base64
    assert got == base64.b64encode(bytes(range(200))).decode()


def test_f16_registry(spark):
    lines = ['"assistantName": "SMART",  "assistantID": asst_abc123',
             '"assistantName": "PDV",  "assistantID": asst_X_9', "garbage"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    got = [tuple(r) for r in df.select(tx.registry_name("l"), tx.registry_id("l")).collect()]
    assert got == [("SMART", "asst_abc123"), ("PDV", "asst_X_9"), ("", None)]


def test_f17_tool_args(spark):
    df = spark.createDataFrame([('{"filename": "a.png"}',), ('{"query": ["x", "y"]}',)], "a string")
    got = df.select(tx.parse_tool_arguments("a").alias("p")).collect()
    assert got[0]["p"]["filename"] == "a.png" and got[1]["p"]["query"] == ["x", "y"]


def test_f18_citation(spark):
    assert one(spark, tx.strip_citations, "texto【4:1†source】 fim") == "texto fim"
