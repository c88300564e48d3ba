"""Vector search (M6-M8, E2, E3), TF-IDF (M9) and threads."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import evaluate as ev
from kbspark.operators import threads as th
from kbspark.operators import tfidf_scan, vector_lsh, vector_scan
from kbspark.operators import vectors as vx


def _cos(a, b):
    if a is None or b is None:
        return None
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 0.0 if na == 0 or nb == 0 else sum(x * y for x, y in zip(a, b)) / (na * nb)


def test_best_and_nearest_equal_brute_force(spark):
    rnd = random.Random(7)
    cat = [(i, [rnd.uniform(-1, 1) for _ in range(8)], None if i % 5 == 0 else [rnd.uniform(-1, 1) for _ in range(8)])
           for i in range(300)]
    qs = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(25)]
    c = spark.createDataFrame(cat, "image_row long, title_vec array<double>, desc_vec array<double>")
    q = spark.createDataFrame(qs, "question_id long, q_vec array<double>")
    scores = {(qi, ci): max(s for s in (_cos(qv, t), _cos(qv, d)) if s is not None) for qi, qv in qs for ci, t, d in cat}
    best = {r["question_id"]: r["image_row"] for r in vx.best_match(q, c, threshold=0.6).collect()}
    for qi, _ in qs:
        cands = sorted(((-s, ci) for (a, ci), s in scores.items() if a == qi and s > 0.6))
        assert best[qi] == (cands[0][1] if cands else None)
    near = {}
    for r in vx.nearest(q, c, k=3, threshold=0.3).collect():
        near.setdefault(r["question_id"], []).append((r["rank"], r["image_row"]))
    for qi, _ in qs:
        want = [ci for _, ci in sorted((-s, ci) for (a, ci), s in scores.items() if a == qi and s > 0.3)[:3]]
        assert [ci for _, ci in sorted(near.get(qi, []))] == want


def test_question_chunks_give_the_same_result(spark, monkeypatch):
    """Question sets above the chunk bound are scored in several passes."""
    rnd = random.Random(11)
    cat = [(i, [rnd.uniform(-1, 1) for _ in range(8)], [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    qs = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(40)]
    c = spark.createDataFrame(cat, "image_row long, title_vec array<double>, desc_vec array<double>")
    q = spark.createDataFrame(qs, "question_id long, q_vec array<double>")
    def run():
        return sorted(tuple(r) for r in vx.nearest(q, c, k=4, threshold=0.2).collect())
    whole = run()
    monkeypatch.setattr(vx, "QUESTION_CHUNK_BYTES", 512)  # about 5 chunks
    monkeypatch.setattr(vx, "MATRIX_BYTES", 8 * 40 * 7)  # 7 catalogue rows a product
    assert run() == whole


def test_ties_do_not_depend_on_the_partitions(spark):
    """A vector that is one row's title and another's description scores the
    same bits in any block, so the first row wins at every partition count."""
    rnd = random.Random(5)
    e = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(120)]
    c = spark.createDataFrame([(i, e[i], e[i + 1]) for i in range(119)], "image_row long, title_vec array<double>, desc_vec array<double>")
    q = spark.createDataFrame([(i, [x + y for x, y in zip(e[i], e[i + 1])]) for i in range(119)], "question_id long, q_vec array<double>")
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "8", "37", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(tuple(r) for r in vx.nearest(q, c, k=3, threshold=0.1).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert all(s == seen[0] for s in seen)


def _vectors(rnd, n, dim, clusters=0):
    middles = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    return [[x + rnd.gauss(0, 0.05) for x in rnd.choice(middles)] if clusters else [rnd.gauss(0, 1) for _ in range(dim)] for _ in range(n)]


def _brute(cat, qs, k, threshold):
    out = set()
    for qi, qv in qs:
        if qv is None:
            qv = [0.0]
        scores = []
        for ci, t, d in cat:
            s = [0.0 if not any(qv) else _cos(qv, v) for v in (t, d) if v is not None]
            if s and max(s) > threshold:
                scores.append((-max(s), ci))
        out |= {(qi, ci, rank) for rank, (_, ci) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_cells_and_cogroup_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    e = _vectors(rnd, 260, 6, clusters=9)
    zero = [0.0] * 6
    cat = [(i, e[i], e[(i * 7) % 260] if i % 4 else None) for i in range(260)] + [(900, None, None), (901, zero, None), (902, None, zero)]
    qs = [(i, v) for i, v in enumerate(_vectors(rnd, 12, 6))] + [(50 + i, e[i]) for i in range(10)] + [(70, zero), (71, None)]
    c = spark.createDataFrame(cat, "image_row long, title_vec array<double>, desc_vec array<double>")
    q = spark.createDataFrame(qs, "question_id long, q_vec array<double>")
    monkeypatch.setattr(vector_scan, "CELL_ROWS", 16)
    for k, threshold in ((1, 0.6), (4, 0.95), (5, -0.2)):
        want = _brute(cat, qs, k, threshold)
        stored = vector_scan.pivot_cells(c, "image_row", "title_vec")
        for frame in (c, stored):
            got = {(r.question_id, r.image_row, r["rank"]) for r in vx.nearest(q, frame, k=k, threshold=threshold).collect()}
            assert got == want, (k, threshold)
        monkeypatch.setattr(vx, "SCAN_CHUNKS", 0)
        assert {(r.question_id, r.image_row, r["rank"]) for r in vx.nearest(q, c, k=k, threshold=threshold).collect()} == want
        monkeypatch.setattr(vx, "SCAN_CHUNKS", 8)


def test_cells_by_pivots_are_skipped(spark, monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(vector_scan, "CELL_ROWS", 8)  # a quarter of a pivot's rows, as by default
    monkeypatch.setattr(vector_scan, "PIVOT_ROWS", 32)
    e = _vectors(rnd, 1200, 24, clusters=30)
    c = spark.createDataFrame([(i, v, None) for i, v in enumerate(e)], "image_row long, title_vec array<double>, desc_vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, e[i]) for i in range(40)], "question_id long, q_vec array<double>")
    plain = vx.visited_cells(q, c, threshold=0.6).first()
    stored = vx.visited_cells(q, vector_scan.pivot_cells(c, "image_row", "title_vec"), threshold=0.6).first()
    assert stored.visited < 0.3 * stored.cells and stored.visited < 0.5 * plain.visited


def test_hashed_candidates_reach_their_recall(spark):
    rnd = random.Random(10)
    e = _vectors(rnd, 500, 32)
    near = [[x + rnd.gauss(0, 0.9) for x in v] for v in e[:150]]
    c = spark.createDataFrame([(i, v, None) for i, v in enumerate(e)] + [(600, None, None), (601, [0.0] * 32, None), (602, None, e[3])],
                              "image_row long, title_vec array<double>, desc_vec array<double>")
    q = spark.createDataFrame([(i, v) for i, v in enumerate(near)] + [(900, None), (901, [0.0] * 32)], "question_id long, q_vec array<double>")
    exact = {(r.question_id, r.image_row): r.score for r in vx.nearest(q, c, threshold=0.6).collect()}
    got = {(r.question_id, r.image_row): r.score for r in vector_lsh.nearest_lsh(q, c, threshold=0.6).collect()}
    assert got.items() <= exact.items() and len(exact) > 100
    assert len(got) >= 0.9 * len(exact)
    assert vector_lsh.nearest_lsh(q.limit(0), c).collect() == [] and vector_lsh.nearest_lsh(q, c.limit(0)).collect() == []


def test_tables_by_recall():
    assert vector_lsh.table_count(1, 0.99, 0.5) == 1
    assert vector_lsh.table_count(12, 0.6, 0.95) > vector_lsh.table_count(12, 0.8, 0.95) > vector_lsh.table_count(12, 0.8, 0.5)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    from kbspark.plans.matching import lsh_recall
    from kbspark.sources.fixtures import Fixtures

    row = lsh_recall(Fixtures(spark, f"/root/testdata/{sf}")).first()
    assert row.n_exact > 400 and row.n_found >= 0.9 * row.n_exact


def test_sweep_of_many_thresholds(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(3), None if i % 9 == 0 else rnd.randrange(3), None if i % 9 == 0 else rnd.choice([rnd.random(), 0.25, 0.5])) for i in range(400)]
    b = spark.createDataFrame(rows, "question_id long, expected long, got long, score double").repartition(3)
    for thresholds in ([0.5], [0.25, 0.5, 0.5, 0.1, 2.0], [i / 1000 for i in range(1000)]):
        got = {tuple(r) for r in ev.threshold_sweep(b, thresholds).collect()}
        want = set()
        for t in set(thresholds):
            kept = [r for r in rows if r[3] is not None and r[3] > t]
            right = sum(r[1] == r[2] for r in kept)
            want.add((t, 400, len(kept), right, round(right / 400, 6)))
        assert got == want
    assert ev.threshold_sweep(b.limit(0), [0.5]).collect() == []


def test_threshold_is_strict_and_ties_take_first(spark):
    c = spark.createDataFrame([(1, [0.6, 0.8], None), (2, [1.0, 0.0], None), (3, [1.0, 0.0], None)],
                              "image_row long, title_vec array<double>, desc_vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "question_id long, q_vec array<double>")
    got = {r["question_id"]: r["image_row"] for r in vx.best_match(q, c, threshold=0.6).collect()}
    assert got == {1: 2, 2: None}
    only = spark.createDataFrame([(1, [0.6, 0.8], None)], "image_row long, title_vec array<double>, desc_vec array<double>")
    assert vx.best_match(q, only, threshold=0.6).where(F.col("image_row").isNotNull()).count() == 0


def test_gaps_and_sweep(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "image_row long, title_vec array<double>, desc_vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0])], "question_id long, q_vec array<double>")
    gaps = {r["question_id"]: r["best_score"] for r in ev.knowledge_gaps(q, c, 0.6).collect()}
    assert gaps == {2: 0.0}
    b = vx.best_match(q, c, threshold=0.5).select("question_id", F.lit(1).alias("expected"),
                                                  F.col("image_row").alias("got"), "score")
    sw = {r["threshold"]: (r["n_answered"], r["n_correct"]) for r in ev.threshold_sweep(b, [0.5, 0.99, 1.0]).collect()}
    assert sw == {0.5: (1, 1), 0.99: (1, 1), 1.0: (0, 0)}


def test_tfidf_prefix_pruning_is_exact(spark):
    docs = [(1, "tela inicial do aplicativo"), (2, "menu pesquisar loja"), (3, "tela menu"), (4, "o a de do")]
    qs = [(10, "tela inicial aplicativo"), (11, "de do"), (12, "loja pesquisar menu")]
    d = spark.createDataFrame(docs, "doc_id long, t string").select("doc_id", F.split("t", " ").alias("toks"))
    q = spark.createDataFrame(qs, "question_id long, t string").select("question_id", F.split("t", " ").alias("toks"))
    got = {r["question_id"]: r["doc_id"] for r in vx.tfidf_best_match(
        q, d, q_id="question_id", q_tokens="toks", d_id="doc_id", d_tokens="toks", threshold=0.3).collect()}
    n = len(docs)
    df = {}
    for _, t in docs:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1

    def vec(t):
        tf = {}
        for w in t.split():
            tf[w] = tf.get(w, 0) + 1
        v = {w: c * (math.log((1 + n) / (1 + df.get(w, 0))) + 1) for w, c in tf.items()}
        s = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / s for w, x in v.items()}
    for qi, qt in qs:
        qv = vec(qt)
        sc = sorted((-sum(qv.get(w, 0) * x for w, x in vec(dt).items()), di) for di, dt in docs)
        want = sc[0][1] if -sc[0][0] > 0.3 else None
        assert got[qi] == want


@pytest.mark.parametrize("frequent, most", [(200_000, 50_000), (5, 50_000), (0, 50_000), (5, 0)])
def test_tfidf_bounds_are_exact(spark, monkeypatch, frequent, most):
    """Whatever the table of frequent tokens holds, and by the join beyond the
    bound, the best document is that of a full comparison."""
    monkeypatch.setattr(tfidf_scan, "FREQUENT", frequent)
    monkeypatch.setattr(tfidf_scan, "MAX_QUESTIONS", most)
    rnd = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    text = [[rnd.choice(vocabulary[:rnd.choice((8, 60))]) for _ in range(rnd.randrange(0, 25))] for _ in range(120)]
    qs = [t[: rnd.randrange(1, 12)] for t in text[:30] if t] + [["nowhere"], [], ["w1"]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(text)] + [(500, None), (501, [""])], "doc_id long, toks array<string>").repartition(3)
    q = spark.createDataFrame(list(enumerate(qs)), "question_id long, toks array<string>")
    got = {r.question_id: (r.doc_id, r.score) for r in vx.tfidf_best_match(q, d, q_id="question_id", q_tokens="toks", d_id="doc_id", d_tokens="toks", threshold=0.4).collect()}
    n = len(text) + 2
    df = {w: sum(w in t for t in text) for w in [*vocabulary, "nowhere"]}

    def vec(t):
        v = {w: t.count(w) * (math.log((1 + n) / (1 + df[w])) + 1) for w in set(t)}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}
    docs = [vec(t) for t in text]
    for i, t in enumerate(qs):
        v = vec(t)
        scores = sorted((-round(sum(x * other.get(w, 0) for w, x in v.items()), 9), k) for k, other in enumerate(docs))
        assert got[i] == ((scores[0][1], -scores[0][0]) if -scores[0][0] > 0.4 else (None, None))


def test_t1_case_sensitive(spark):
    lines = spark.createDataFrame([(1, '"assistantName": "SMART",  "assistantID": asst_1')], "line_no long, line string")
    rq = spark.createDataFrame([("smart",), ("SMART",)], "assistant_name string")
    got = {r["assistant_name"]: r["assistant_key"] for r in th.route(rq, th.registry(lines)).collect()}
    assert got == {"smart": None, "SMART": "asst_1"}


def test_t5_images_field_only_when_any(spark):
    df = spark.createDataFrame([("m1", "no images here"), ("m2", "see smt_figura1.png and smt_figura1.png")],
                               "id string, text string")
    from kbspark.functions import text as tx
    names = tx.extract_image_names("text")
    rec = th.reply_record(F.col("id"), F.lit("assistant"), th.content_blocks(tx.remove_names("text", names)),
                          F.lit(1), F.lit("t"), tx.image_urls(names, "/u/"))
    js = {r["id"]: r["j"] for r in df.select("id", F.to_json(rec).alias("j")).collect()}
    assert '"images"' not in js["m1"] and js["m2"].count("/u/smt_figura1.png") == 2


def test_t3_latest_and_t7_gate(spark):
    m = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "only")],
                              "thread_id long, seq long, role string, text string")
    last = {r["thread_id"]: r["text"] for r in th.latest_message(m, ["role", "text"]).collect()}
    assert last == {1: "a", 2: "only"}
    st = spark.createDataFrame([(1, "completed"), (2, "failed")], "thread_id long, status string")
    g = {r["thread_id"]: r["reply"] for r in th.completed_gate(th.latest_message(m, ["text"]), st, F.col("text")).collect()}
    assert g == {1: "a", 2: None}


def test_best_keeps_order_and_ties():
    import numpy as np
    best = vector_scan.Best(3, 2, -1.0)
    best.add(np.array([0, 2, 0]), np.array([7, 1, 5]), np.array([0.5, 0.2, 0.5]))
    best.add(np.array([0, 0]), np.array([4, 9]), np.array([0.5, 0.9]))
    assert [tuple(x) for x in zip(*best.rows)] == [(0, 9, 0.9), (0, 4, 0.5), (2, 1, 0.2)]
    assert list(best.limit) == [0.5, -1.0, -1.0]


@pytest.mark.parametrize("scan_chunks", [8, 0])
def test_hashing_shuffles_winners_only(spark, monkeypatch, scan_chunks):
    """Equal vectors share every key: each task sends on k rows a question."""
    monkeypatch.setattr(vx, "SCAN_CHUNKS", scan_chunks)
    monkeypatch.setattr(vector_lsh, "BUFFER_ROWS", 64)
    monkeypatch.setattr(vector_lsh, "PAIRS", 100)
    e = [1.0, 2.0, 3.0, 4.0]
    c = spark.createDataFrame([(i, e, None) for i in range(300)], "image_row long, title_vec array<float>, desc_vec array<float>").repartition(2)
    q = spark.createDataFrame([(i, e) for i in range(50)], "question_id long, q_vec array<float>")
    found = vector_lsh.nearest_lsh(q, c)
    rows = found.collect()
    assert sorted((r.question_id, r["rank"], r.image_row) for r in rows) == [(i, k + 1, k) for i in range(50) for k in range(5)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_questions_are_hashed_once_however_many_buffers(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(vector_lsh, "BUFFER_ROWS", 50)
    monkeypatch.setattr(vector_lsh, "PAIRS", 200)
    hashed, keys = [], vector_lsh._keys
    monkeypatch.setattr(vector_lsh, "_keys", lambda u, *a: (hashed.append(len(u)), keys(u, *a))[1])
    e = np.random.default_rng(3).standard_normal((500, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(e.tolist()), pa.array([None] * 500, pa.list_(pa.float64()))], ["i", "t", "d"])
    # every question twice
    ids, questions = np.arange(400), np.concatenate([e[:200], e[:200]])
    task = vector_lsh._hash_scan(ids, questions, 1, 0.6, ["q", "i", "score"], 6, 40, 1)
    (got,) = task(iter([batch]))
    assert sum(hashed) <= 200 + 500  # 4,000 for the questions alone where each buffer hashes them
    assert sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == [(i, i % 200) for i in range(400)]


def test_pairs_that_meet_in_many_tables_count_once(spark, monkeypatch):
    monkeypatch.setattr(vector_lsh, "BUFFER_ROWS", 90)
    monkeypatch.setattr(vector_lsh, "PAIRS", 64)
    monkeypatch.setattr(vector_lsh, "WAITING", 100)
    rnd = random.Random(12)
    e = _vectors(rnd, 30, 12)
    near = lambda v: [x + rnd.gauss(0, 0.2) for x in v]
    # groups of near copies, of equal titles with other descriptions, and of equal rows; some ids twice
    rows = [(i, near(e[i % 10]), near(e[(i * 7) % 30])) for i in range(150)] + [(150 + i, e[10 + i % 5], near(e[i % 30])) for i in range(100)]
    rows += [(250 + i, e[20], e[21]) for i in range(60)] + rows[:20]
    c = spark.createDataFrame(rows, "image_row long, title_vec array<double>, desc_vec array<double>").repartition(2)
    q = spark.createDataFrame([(i, near(e[i % 30])) for i in range(60)] + [(60 + i, e[20]) for i in range(5)], "question_id long, q_vec array<double>")
    for k in (1, 5):
        exact = collections.Counter((r.question_id, r.image_row, r.score, r["rank"]) for r in vx.nearest(q, c, k=k, threshold=0.8).collect())
        found = collections.Counter((r.question_id, r.image_row, r.score, r["rank"]) for r in vector_lsh.nearest_lsh(q, c, k=k, threshold=0.8, recall=0.9999).collect())
        assert len(exact) > 50 and found == exact
