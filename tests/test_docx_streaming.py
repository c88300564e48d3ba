"""docx parser cases (I2) and streaming = batch."""

import datetime
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from kbspark.plans import manual_files
from kbspark.sources import docx
from kbspark.sources.manuals import shared_folder
from kbspark.streaming import jobs

W = docx.NS["w"]


def _write(folder, name, blob):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as fh:
        fh.write(blob)


def _pic(descr, name, emb, pid):
    return manual_files._drawing(descr, name, emb, pid)


def _docx_with_body(body_xml, rels=(), media=()):
    base = manual_files.build_docx([[{"text": "x"}]])
    src = zipfile.ZipFile(io.BytesIO(base))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in src.namelist():
            data = src.read(n)
            if n == "word/document.xml":
                data = data.decode().replace("<w:p><w:r><w:t xml:space=\"preserve\">x</w:t></w:r></w:p>", body_xml).encode()
            if n == "word/_rels/document.xml.rels":
                data = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                        f'<Relationships xmlns="{docx.NS["rel"]}">'
                        + "".join(f'<Relationship Id="{i}" Type="{docx.IMAGE_REL}" Target="{t}"/>' for i, t in rels)
                        + "</Relationships>").encode()
            z.writestr(n, data)
        for n, b in media:
            z.writestr(n, b)
    return out.getvalue()


def test_parser_cases(spark, tmp_path):
    folder = str(tmp_path / "manuals")
    _write(folder, "none.docx", manual_files.build_docx([[{"text": "a"}, {"text": "b"}], []]))
    two = (f"<w:p><w:r>{_pic('d1', 'n1', 'rId1', 1)}{_pic('d2', 'n2', 'rId2', 2)}</w:r></w:p>")
    _write(folder, "two.docx", _docx_with_body(two, rels=[("rId1", "media/a.png"), ("rId2", "media/b.png")],
                                               media=[("word/media/a.png", b"A"), ("word/media/b.png", b"B")]))
    miss = f"<w:p><w:r>{_pic('gone', 'n', 'rId9', 1)}</w:r><w:r><w:t>t</w:t></w:r></w:p>"
    _write(folder, "missing.docx", _docx_with_body(miss))
    table = (f"<w:tbl><w:tr><w:tc><w:p><w:r>{_pic('', 'cellname', 'rId1', 1)}</w:r></w:p></w:tc></w:tr></w:tbl>"
             "<w:p><w:r><w:t>after</w:t></w:r></w:p>")
    _write(folder, "table.docx", _docx_with_body(table, rels=[("rId1", "media/c.png")], media=[("word/media/c.png", b"C")]))
    _write(folder, "corrupt.docx", b"not a zip at all")
    files = docx.scan_manuals(spark, folder)
    runs = docx.explode_runs(files).withColumn("f", F.regexp_extract("path", r"([^/]+)\.docx$", 1)).collect()
    imgs = docx.explode_images(files).withColumn("f", F.regexp_extract("path", r"([^/]+)\.docx$", 1)).collect()
    by = lambda rows, f: [r for r in rows if r["f"] == f]
    assert [(r["para_idx"], r["run_idx"], r["kind"], r["text"]) for r in by(runs, "none")] == \
        [(0, 0, "text", "a"), (0, 1, "text", "b"), (1, None, "empty", "")]
    assert by(imgs, "none") == []
    two_runs = by(runs, "two")
    assert len(two_runs) == 1 and two_runs[0]["kind"] == "drawing" and two_runs[0]["n_drawings"] == 2
    assert [(r["img_idx"], r["descr"], bytes(r["content"])) for r in by(imgs, "two")] == [(1, "d1", b"A"), (2, "d2", b"B")]
    assert [r["kind"] for r in by(runs, "missing")] == ["drawing", "text"] and by(imgs, "missing") == []
    t_imgs = by(imgs, "table")
    assert len(t_imgs) == 1 and t_imgs[0]["descr"] == "" and t_imgs[0]["name"] == "cellname"
    assert [r["text"] for r in by(runs, "table")] == ["after"]  # table cells are not body paragraphs
    assert by(runs, "corrupt")[0]["error"] and by(imgs, "corrupt")[0]["error"]


def test_chunks_out_of_order_emit_once(spark):
    rows = [(1, 2, "c", True), (1, 0, "a", False), (2, 0, "x", True), (1, 1, "b", False), (1, 1, "b", False)]
    df = spark.createDataFrame(rows, "response_id long, seq int, delta string, done boolean")
    folder = shared_folder(spark, "t-chunks")
    for i, r in enumerate(rows):  # one file per chunk, in this arrival order
        spark.createDataFrame([r], df.schema).coalesce(1).write.mode("append").parquet(folder)
    out = shared_folder(spark, "t-chunks-out")
    jobs.run_append(jobs.assemble_chunks(jobs.read_stream(spark, folder, df.schema)), out,
                    shared_folder(spark, "t-chunks-ck"))
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [(1, "abc", 3), (2, "x", 1)]
    assert sorted(tuple(r) for r in jobs.assemble_chunks_batch(df.dropDuplicates()).collect()) == got


def test_one_parse_gives_runs_and_images_in_bounded_memory(spark, tmp_path):
    import tracemalloc

    many = [[dict(text=f"run {i} {j}") for j in range(50)] for i in range(2000)]
    blob = manual_files.build_docx(many)
    tracemalloc.start()
    n = sum(1 for _ in docx.parse_manual("p", blob))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and peak < 8 << 20
    picture = dict(drawing=True, descr="d", name="n", embed="rId1", media=b"x" * 1000, ext="png")
    _write(str(tmp_path), "many.docx", blob)
    _write(str(tmp_path), "mixed.docx", manual_files.build_docx([[dict(text="a"), picture], [], [picture]]))
    _write(str(tmp_path), "broken.docx", b"no zip")
    parts = docx.explode_parts(docx.scan_manuals(spark, str(tmp_path))).cache()
    try:
        counts = {(r.path.rsplit("/", 1)[1], r.part): r["count"] for r in parts.groupBy("path", "part").count().collect()}
        assert counts == {("many.docx", "run"): 100_000, ("mixed.docx", "run"): 4, ("mixed.docx", "image"): 2, ("broken.docx", "error"): 1}
        assert docx.runs_of(parts).where("path like '%mixed%'").count() == 4
        images = docx.images_of(parts).where("error is null").orderBy("img_idx").collect()
        assert [(r.img_idx, r.para_idx, r.run_idx, len(r.content)) for r in images] == [(1, 0, 1, 1000), (2, 2, 0, 1000)]
    finally:
        parts.unpersist()


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]])
def test_pieces_in_any_order_with_state_bounded_by_gaps(spark, order):
    answers = spark.createDataFrame([(i, "".join(chr(97 + (i + k) % 26) for k in range(16 * i + i % 5))) for i in range(1, 12)], "id long, t string")
    chunks = jobs.answer_chunks(answers, "id", "t")
    folder, out, ck = (shared_folder(spark, f"t-pieces-{n}") for n in ("in", "out", "ck"))
    jobs.write_slices(chunks.withColumn("_k", F.concat_ws(":", "response_id", "seq")), folder, "_k", 4, order, files=1)
    chunks.where("response_id = 5").withColumn("_k", F.lit("x")).coalesce(1).write.mode("append").parquet(folder)  # a late replay of all
    stream = jobs.read_stream(spark, folder, chunks.withColumn("_k", F.lit("")).schema, 1).withColumn("arrived", F.current_timestamp())
    jobs.run_append(jobs.assemble_pieces(stream), out, ck)
    got = sorted(tuple(r) for r in jobs.whole_answers(spark.read.parquet(out)).select("response_id", "text", "n_chunks").collect())
    assert got == sorted(tuple(r) for r in jobs.assemble_chunks_batch(chunks).select("response_id", "text", "n_chunks").collect())
    # every chunk left once, however often it came
    assert spark.read.parquet(out).agg(F.sum("n_chunks")).first()[0] == chunks.count()


def test_pieces_keep_only_what_is_behind_a_gap(spark):
    rows = [(1, s, f"<{s}>", False) for s in (0, 1, 2, 3, 5, 6, 8)]
    df = spark.createDataFrame(rows, "response_id long, seq int, delta string, done boolean")
    folder, out, ck = (shared_folder(spark, f"t-gap-{n}") for n in ("in", "out", "ck"))
    df.coalesce(1).write.parquet(folder)
    stream = jobs.read_stream(spark, folder, df.schema).withColumn("arrived", F.current_timestamp())
    jobs.run_append(jobs.assemble_pieces(stream), out, ck)
    assert [(r.first_seq, r.n_chunks, r.done) for r in spark.read.parquet(out).collect()] == [(0, 4, False)]
    state = spark.read.format("statestore").load(ck).select("value.*").collect()
    assert len(state) == 1 and "5" in str(state[0]) and "<0>" not in str(state[0])
    assert jobs.whole_answers(spark.read.parquet(out)).collect() == []


def _at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_late_rows_and_expired_threads(spark):
    folder, ok_dir, late_dir, marks, out = (shared_folder(spark, f"t-late-{n}") for n in ("in", "ok", "late", "marks", "out"))
    schema = "thread_id long, seq long, role string, text string, created_at timestamp"
    batches = [[(1, 0, "user", "a", _at(0)), (2, 0, "user", "b", _at(5))],
               [(2, 1, "user", "c", _at(300))],
               [(1, 1, "user", "late", _at(10)), (3, 0, "user", "in time", _at(200)), (4, 0, "user", "no time", None)],
               [(2, 2, "user", "d", _at(900))],
               [(5, 0, "user", "x", _at(905))],
               [(1, 2, "user", "anew", _at(906)), (2, 3, "user", "e", _at(907))]]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(folder)

    def split(batch, batch_id):
        ok, late = jobs.split_late(batch, batch_id, marks, "created_at", "2 hours")
        jobs.replace_batch(ok, ok_dir, batch_id)
        jobs.replace_batch(late, late_dir, batch_id)

    jobs.run_batches(jobs.read_stream(spark, folder, frames[0].schema, 1), split, shared_folder(spark, "t-late-ck"))
    assert sorted(r["text"] for r in spark.read.parquet(late_dir).collect()) == ["late", "no time"]
    split(frames[2], 2)  # a replayed batch is split as before
    assert sorted(r["text"] for r in spark.read.parquet(late_dir).collect()) == ["late", "no time"]
    passed = spark.read.parquet(f"{ok_dir}/batch_id=0").schema
    folder2 = shared_folder(spark, "t-late-in2")
    for k in range(len(batches)):
        spark.read.parquet(f"{ok_dir}/batch_id={k}").coalesce(1).write.mode("append").parquet(folder2)
    replies = jobs.latest_reply_expiring(jobs.read_stream(spark, folder2, passed, 1), 6 * 3600)
    jobs.run_batches(replies, lambda b, i: jobs.replace_batch(b, out, i), shared_folder(spark, "t-late-ck2"), mode="update")
    rows = spark.read.parquet(out).orderBy("batch_id").collect()
    last = {r["thread_id"]: (r["text"], r["n_messages"]) for r in rows}
    # thread 1 was idle for longer than six hours: it starts anew; thread 2 was not
    assert last == {1: ("anew", 1), 2: ("e", 4), 3: ("in time", 1), 5: ("x", 1)}


def test_replayed_batches_replace_their_rows(spark):
    out = shared_folder(spark, "t-replay")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    second = spark.createDataFrame([(2, "newer")], "k long, v string")
    for batch, batch_id in ((first, 0), (second, 1), (first, 0), (second, 1)):
        jobs.replace_batch(batch, out, batch_id)
    assert spark.read.parquet(out).count() == 3
    assert sorted(tuple(r) for r in jobs.latest_versions(spark, out, ["k"], first.schema).collect()) == [(1, "a"), (2, "newer")]


def test_every_sink_survives_a_replay(spark):
    """The last committed micro-batch is run again: its rows are there once."""
    folder, out, ck = (shared_folder(spark, n) for n in ("t-in", "t-out", "t-ck"))
    df = spark.createDataFrame([(1, "start", None, "hi"), (2, "chat", "t", "ok"), (3, "chat", "t", "x")],
                               "request_id long, endpoint string, thread_id string, message string")
    jobs.write_slices(df, folder, "request_id", 2, files=1)

    def sink(batch, batch_id):
        jobs.replace_batch(jobs.ingest_requests(batch)[0], out, batch_id)

    jobs.run_batches(jobs.read_stream(spark, folder, df.schema, 1), sink, ck)
    commits = [n for n in os.listdir(ck.removeprefix("file:") + "/commits") if n.isdigit()]
    for name in (max(commits, key=int), f".{max(commits, key=int)}.crc"):
        os.remove(f"{ck.removeprefix('file:')}/commits/{name}")
    jobs.run_batches(jobs.read_stream(spark, folder, df.schema, 1), sink, ck)
    assert sorted(r["request_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_latest_reply_ttl_variant(spark):
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 2, "assistant", "a2"), (1, 1, "assistant", "a1")],
                              "thread_id long, seq long, role string, text string")
    folder = shared_folder(spark, "t-ttl")
    m.coalesce(1).write.parquet(folder)
    q = (jobs.latest_reply_ttl(jobs.read_stream(spark, folder, m.schema), ttl_ms=600_000)
         .writeStream.format("memory").queryName("ttl_out").outputMode("update")
         .option("checkpointLocation", shared_folder(spark, "t-ttl-ck")).start())
    # a processing-time timeout keeps the query busy with empty batches, so
    # wait for the first batch's output and stop it
    import time
    t0 = time.time()
    while time.time() - t0 < 120 and spark.sql("SELECT count(*) FROM ttl_out").first()[0] == 0:
        time.sleep(1)
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT thread_id, seq, text FROM ttl_out").collect()] == [(1, 2, "a2")]


def test_ingest_errors(spark):
    r = spark.createDataFrame([(1, "start", None, "hi"), (2, "chat", None, "no thread"), (3, "chat", "t9", "ok")],
                              "request_id long, endpoint string, thread_id string, message string")
    ok, bad = jobs.ingest_requests(r)
    assert sorted(x["request_id"] for x in ok.collect()) == [1, 3]
    assert [tuple(x) for x in bad.collect()] == [(2, "missing threadId")]


def test_many_manuals_take_few_tasks_and_bounded_folders(spark, monkeypatch):
    monkeypatch.setattr(manual_files, "FOLDER_FILES", 10)
    runs = spark.range(1500).selectExpr("id as doc_id", "explode(array(1, 0)) as para_idx").selectExpr(
        "doc_id", "para_idx", "0 as run_idx", "'text' as kind", "concat('t', doc_id, '-', para_idx) as text", "string(null) as descr",
        "string(null) as name", "string(null) as embed", "binary(null) as media", "string(null) as ext")
    folder = shared_folder(spark, "t-many")
    written = {r.path.removeprefix("file:"): r.n_bytes for r in manual_files.write_manuals(runs, folder).collect()}
    assert len(written) == 1500
    folders = [os.path.dirname(p) for p in written]
    assert max(folders.count(f) for f in set(folders)) <= 10
    files = docx.scan_manuals(spark, folder)
    assert files.rdd.getNumPartitions() <= 16  # 47 by the reader's own plan
    assert {r.path.removeprefix("file:"): r.length for r in files.select("path", "length").collect()} == written
    got = docx.explode_runs(files).select(F.regexp_extract("path", r"manual_(\d+)", 1).alias("d"), "para_idx", "text").collect()
    # paragraphs in order, numbered anew
    assert sorted((int(r.d), r.para_idx, r.text) for r in got) == [(d, p, f"t{d}-{p}") for d in range(1500) for p in (0, 1)]


def test_a_manual_without_id_is_refused(spark):
    runs = spark.createDataFrame([(None, 0, 0, "text", "a")], "doc_id long, para_idx int, run_idx int, kind string, text string").selectExpr(
        "*", "string(null) as descr", "string(null) as name", "string(null) as embed", "binary(null) as media", "string(null) as ext")
    with pytest.raises(Exception, match="int"):
        manual_files.write_manuals(runs, shared_folder(spark, "t-noid")).collect()


def test_manuals_are_listed_in_tasks_as_the_reader_lists_them(spark, tmp_path):
    names = ["a.docx", "b c#%20é.docx", "UPPER.DOCX", "x.txt", ".hidden.docx", "_off.docx", "_k=1.docx", "_metadata.docx", "z.docx._COPYING_",
             "s/1.docx", "s/t/u/2.docx", "_d/3.docx", ".e/4.docx", "p=1/5.docx", "dir.docx/6.docx", "sp ace/7.docx", "b[1]/8.docx"]
    names += [f"many/{i // 40}/{i}.docx" for i in range(200)]
    for n in names:
        _write(str(tmp_path / os.path.dirname(n)), os.path.basename(n), n.encode())
    _write(str(tmp_path), "empty.docx", b"")
    (tmp_path / "none").mkdir()

    def of(df):
        return sorted((r.path, r.length, bytes(r.content)) for r in df.collect())

    def reader(p):
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(p).select("path", "length", "content")

    found = docx.scan_manuals(spark, str(tmp_path))
    assert found.schema == reader(str(tmp_path)).schema and len(found.inputFiles()) < 100  # 209 on the driver by the reader
    for p in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/s*", f"{tmp_path}/none", f"{tmp_path}/a.docx", f"{tmp_path}/_d"):
        assert of(docx.scan_manuals(spark, p)) == of(reader(p))
    assert len(of(found)) == 209
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        docx.scan_manuals(spark, f"{tmp_path}/missing")


def test_images_of_many_manuals_need_no_list_of_files_on_the_driver(spark, tmp_path):
    for i in range(120):
        picture = dict(drawing=True, descr=f"d{i}", name="n", embed="rId1", media=f"blob {i}".encode(), ext="png")
        _write(str(tmp_path / str(i % 6)), f"manual_{i}.docx", manual_files.build_docx([[dict(text="a"), picture], [picture]]))
    images = docx.explode_images(docx.scan_manuals(spark, str(tmp_path)))
    assert len(images.inputFiles()) < 60  # 120 by Spark's reader
    got = sorted((r.descr, r.img_idx, r.para_idx, r.run_idx, bytes(r.content)) for r in images.collect())
    assert got == sorted((f"d{i}", k + 1, k, 1 - k, f"blob {i}".encode()) for i in range(120) for k in (0, 1))
