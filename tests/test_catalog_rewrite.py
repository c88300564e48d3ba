"""Catalogue semantics (N1, N2, C5) and ordered rewriting."""

from pyspark.sql import functions as F

from kbspark.operators import catalog as cat
from kbspark.operators import rewrite as rw

IMG = "image_row long, filepath string, filename string, content_type string, title string, description string, assistant_id long"


def _assistants(spark):
    return spark.createDataFrame([(1, "A", "asst_a"), (2, "B", "asst_b")], "id long, name string, assistant_key string")


def _catalog(spark):
    return spark.createDataFrame([
        (1, "f1", "f1_x.png", "image/png", "t1", None, 1),
        (2, "f1", "f1_x.png", "image/png", "t2", "second", 1),
        (3, "f2", "f2_y.png", "image/png", "t3", "d3", 1),
        (4, "f1", "f1_z.png", "image/png", "t4", "d4", 2)], IMG)


def test_c2_insert_or_ignore(spark):
    batch = spark.createDataFrame([(5, "B2", "asst_b"), (3, "C", "asst_c"), (4, "C2", "asst_c"), (9, "D", "asst_d")],
                                  "ord long, name string, assistant_key string")
    got = sorted(tuple(r) for r in cat.insert_or_ignore_assistants(_assistants(spark), batch, "ord").collect())
    assert got == [(1, "A", "asst_a"), (2, "B", "asst_b"), (3, "C", "asst_c"), (4, "D", "asst_d")]


def test_c5_scoping(spark):
    c = _catalog(spark)
    req = spark.createDataFrame([("asst_zzz", "f1"), ("asst_a", "f9")], "assistant_key string, filepath string")
    assert cat.delete_images(c, req, _assistants(spark)).count() == 4
    req = spark.createDataFrame([("asst_a", "f1")], "assistant_key string, filepath string")
    assert sorted(r[0] for r in cat.delete_images(c, req, _assistants(spark)).select("image_row").collect()) == [3, 4]
    v1 = cat.delete_images(c, req.select("assistant_key"), _assistants(spark), by_filepath=False)
    assert [r[0] for r in v1.select("image_row").collect()] == [4]


def test_c6_matrix(spark):
    c = _catalog(spark)
    new = spark.createDataFrame([(7, 1, "f1", "n.png", "image/png", "alt", "asst_a")],
                                "doc_id long, img_idx int, filepath string, filename string, content_type string, "
                                "title string, assistant_key string")
    caps = spark.createDataFrame([("f1_n.png", "cap")], "filename string, description string")
    req = spark.createDataFrame([("asst_a", "f1")], "assistant_key string, filepath string")
    a = _assistants(spark)
    assert cat.reingest(c, new, a, req, False, None).count() == 4
    tf = {r["image_row"]: r for r in cat.reingest(c, new, a, req, True, None).collect()}
    assert sorted(tf) == [3, 4, 5] and tf[5]["description"] is None and tf[5]["filename"] == "f1_n.png"
    ft = cat.reingest(c, new, a, req, False, caps).collect()
    assert len(ft) == 5 and [r["description"] for r in ft if r["image_row"] == 5] == ["cap"]
    tt = {r["image_row"]: r["description"] for r in cat.reingest(c, new, a, req, True, caps).collect()}
    assert tt == {3: "d3", 4: "d4", 5: "cap"}


def test_c9_default_null_first_row(spark):
    req = spark.createDataFrame([("f1_x.png",), ("missing.png",), ("f2_y.png",)], "filename string")
    got = {r["filename"]: (r["title"], r["description"]) for r in cat.lookup_description(req, _catalog(spark)).collect()}
    assert got["f1_x.png"] == ("t1", None)
    assert got["missing.png"] == ("sem titulo", "sem descricao")
    assert got["f2_y.png"] == ("t3", "d3")


def test_c10_lookup_by_title(spark):
    req = spark.createDataFrame([("t2",), ("nope",)], "title string")
    got = {r["title"]: r["filename"] for r in cat.lookup_filename_by_title(req, _catalog(spark)).collect()}
    assert got == {"t2": "f1_x.png", "nope": ""}


def test_c8_audit(spark):
    a = spark.createDataFrame([(1, "A", "k"), (1, None, "k")], "id long, name string, assistant_key string")
    out = {(r["check"], r["subject"]): r["n"] for r in cat.integrity_audit(_catalog(spark), a).collect()}
    assert out[("unique:assistant.assistant_key", "k")] == 2
    assert out[("not_null:assistant.name", None)] == 1
    assert out[("unique:assistant.id", "1")] == 2
    assert out[("fk:images.assistant_id", "2")] == 1


RUNS = "doc_id long, para_idx int, run_idx int, kind string, text string"


def test_d1_positional_and_extra_drawings_vanish(spark):
    runs = spark.createDataFrame([(1, 0, 0, "text", "A "), (1, 0, 1, "drawing", ""), (1, 1, 0, "drawing", ""),
                                  (1, 2, 0, "text", "end")], RUNS)
    imgs = spark.createDataFrame([(1, 1, "Figura 1", None, "png")], "doc_id long, img_idx int, descr string, name string, ext string")
    catalog = spark.createDataFrame([(1, "m", "m_figura01.png", "image/png", "t", "desc one", 1)], IMG)
    fp = spark.createDataFrame([(1, "m")], "doc_id long, filepath string")
    out = rw.replace_by_position(runs, imgs, catalog, fp)
    paras = rw.paragraph_texts(out, all_paragraphs=runs)
    doc = rw.document_text(paras).first()["text"]
    assert doc == 'A desc one IMAGE_URI: "m_figura01.png".\n\nend'


def test_d6_last_image_caption_first(spark):
    runs = spark.createDataFrame([(1, 0, 0, "drawing", ""), (1, 0, 1, "drawing", ""), (1, 1, 0, "text", "x")], RUNS)
    imgs = spark.createDataFrame([(1, 1, 0, "Figura 1", None, "png"), (1, 2, 0, "Figura 2", None, "png")],
                                 "doc_id long, img_idx int, para_idx int, descr string, name string, ext string")
    catalog = spark.createDataFrame([(1, "m", "m_figura01.png", "image/png", "t", "one", 1)], IMG)
    fp = spark.createDataFrame([(1, "m")], "doc_id long, filepath string")
    out = rw.caption_paragraphs(runs, imgs, catalog, fp).orderBy("para_idx", "sub").collect()
    assert [r["text"] for r in out] == ["", "sem descricao IMAGE_FILENAME: (figura02.png)",
                                        "one IMAGE_FILENAME: (figura01.png)", "x"]


def test_d3_drops_caption_lines(spark):
    runs = spark.createDataFrame([(1, 0, 0, "text", "Figura 01: x"), (1, 0, 1, "text", "keep"),
                                  (1, 1, 0, "text", "Fonte: Aplicativo Play"), (1, 1, 1, "drawing", "")], RUNS)
    runs = runs.withColumn("embed_id", F.when(F.col("kind") == "drawing", F.lit("rId8")))
    catalog = spark.createDataFrame([(1, "m", "image_rId8.png", "image/png", "T", "D", 1)], IMG)
    fp = spark.createDataFrame([(1, "m")], "doc_id long, filepath string")
    out = rw.replace_by_embed(runs, catalog, fp, prefixed_lookup=False, drop_caption_lines=True)
    texts = [r["out_text"] for r in out.orderBy("para_idx", "run_idx", "seg").collect()]
    assert texts == ["keep", "T IMAGE_FILENAME: (m_image_rId8.png), Descrição: ", "D IMAGE_FILENAME: (m_image_rId8.png)"]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_document_texts_are_dealt_once(spark):
    rows = spark.createDataFrame([(1, 1, 1, "b"), (1, 1, 0, "a"), (1, 0, 0, None), (2, 0, 0, "x"), (3, 9, 0, "not listed")],
                                 "doc_id long, para_idx int, run_idx int, out_text string")
    assert _exchanges(rw.document_text(rw.paragraph_texts(rows))) == 1
    listed = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 2), (2, 0), (None, 4)], "doc_id long, para_idx int")
    paras = rw.paragraph_texts(rows, all_paragraphs=listed)
    assert sorted(map(tuple, paras.collect()), key=str) == [(1, 0, ""), (1, 1, "ab"), (1, 2, ""), (2, 0, "x"), (None, 4, "")]
    assert sorted(tuple(r) for r in rw.document_text(paras).where("doc_id is not null").collect()) == [(1, "\nab\n"), (2, "x")]


def test_few_asked_names_reduce_the_catalogue(spark):
    runs = spark.createDataFrame([(1, 0, i, "drawing", "t", "rId1") for i in range(5)], "doc_id long, para_idx int, run_idx int, kind string, text string, embed_id string")
    catalog = spark.createDataFrame([(i, f"image_rId{i}.png", f"title {i}", None) for i in range(1, 30)],
                                    "image_row long, filename string, title string, description string")
    paths = spark.createDataFrame([(1, "f")], "doc_id long, filepath string")
    out = rw.replace_by_embed(runs, catalog, paths, prefixed_lookup=False)
    assert {r.out_text for r in out.collect()} == {"title 1 IMAGE_FILENAME: (f_image_rId1.png), Descrição: ", " IMAGE_FILENAME: (f_image_rId1.png)"}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_many_captions_do_not_pass_through_the_driver(spark, monkeypatch):
    from kbspark.operators import catalog as cat
    sent = []
    real = cat.maybe_broadcast

    def seen(df, *args, **kw):
        out = real(df, *args, **kw)
        sent.append((df.columns, out[1]))
        return out

    monkeypatch.setattr(cat, "maybe_broadcast", seen)
    base = spark.createDataFrame([(1, "f", "f_a", "png", "t", "d", 1)], "image_row long, filepath string, filename string, content_type string, title string, description string, assistant_id long")
    new = spark.createDataFrame([("f", "a", "png", "t", "k", 1, 1), ("f", "b", "png", "t", "k", 1, 2)],
                                "filepath string, filename string, content_type string, title string, assistant_key string, doc_id long, img_idx int")
    captions = spark.createDataFrame([("f_a", 1), ("f_c", 2)], "filename string, n int").selectExpr("filename", "repeat('x', 12000000) as description")
    assistants = spark.createDataFrame([(1, "n", "k")], "id long, name string, assistant_key string")
    got = cat.append_images(base, new, assistants, captions).selectExpr("image_row", "filename", "length(description) as n").collect()
    assert sorted(tuple(r) for r in got) == [(1, "f_a", 1), (2, "f_a", 12_000_000), (3, "f_b", None)]
    assert (["filename", "_cap"], False) in sent
