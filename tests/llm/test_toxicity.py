import numpy as np

from kbspark.llm import toxicity
from kbspark.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, id string, score string"


def corpus(n):
    """Invented prose; every seventh text has a word of a hidden lexicon."""
    rng = np.random.default_rng(1)
    syllables = ["ba", "lo", "mi", "ter", "an", "do", "shi", "re", "ka", "ven"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(2, 5))) for _ in range(rng.integers(5, 60))]
        bad = i % 7 == 0
        if bad:
            words.insert(rng.integers(0, len(words)), "qux" + "".join(rng.choice(["zo", "pa", "fi"], 2)))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad), "x", "x"))
    return rows, labels


def test_held_out_accuracy_on_the_tables(spark):
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if r.doc_id in got and got[r.doc_id].held_out]
    assert sum(p == t for p, t in held) / len(held) >= 0.95
    clean = [p for p, t in held if t == 0]
    assert sum(clean) <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_hidden_lexicon_is_mined_and_held_out_labels_are_not_read(spark, make_docs, clash):
    import zlib

    rows, labels = corpus(900)
    docs = make_docs(rows, **{k: v for k, v in clash.items() if k != "score"})
    # wrong labels on all held-out rows: they must not matter
    wrong = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, a, b) for i, q, t, a, b in labels]
    scores = {}
    for name, some in (("right", labels), ("wrong", wrong)):
        scores[name] = {r.id: r.score for r in toxicity.score_documents(docs, spark.createDataFrame(some, LABELS)).collect()}
    assert scores["right"] == scores["wrong"]
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((scores["right"][i] >= 0.5) == (i % 7 == 0) for i in held)


def test_odd_rows_without_labels(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "you are an idiot, a moron and a pathetic loser"), (None, "what a lovely day"), (3, "calm words"), (3, "calm words"), (4, "word " * 100_000)]
    got = toxicity.score_documents(make_docs(rows), spark.createDataFrame([], LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = sorted((str(r.id), r.score) for r in got)
    assert dict(by)["1"] == dict(by)["2"]
    assert max(by, key=lambda x: x[1])[0] == "3"
    empty = toxicity.score_documents(make_docs([]), spark.createDataFrame([(None, None, None, "x", "x")], LABELS))
    assert empty.collect() == []


def test_drop_toxic_keeps_columns_and_clean_rows(spark, make_docs, clash):
    rows, labels = corpus(700)
    docs = make_docs(rows + [(None, None)], **clash)
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 7} | {None}


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.1
    weak = np.where(y, rng.random(20_000) < 0.5, rng.random(20_000) < 0.1)
    good = [np.where(y, rng.random(20_000) < 0.9, rng.random(20_000) < 0.02) for _ in range(2)]
    votes = np.stack([weak, weak, weak, *good]).T.astype(int)
    patterns, at = np.unique(votes, axis=0, return_inverse=True)
    counts = np.bincount(at.ravel()).astype(float)
    post = toxicity.label_model(patterns, counts, np.zeros((len(patterns), 2)))
    belief = {tuple(p): b for p, b in zip(patterns.tolist(), post)}
    assert belief[(1, 1, 1, 0, 0)] < 0.5 < belief[(0, 0, 0, 1, 1)]


def test_samples_are_bounded_whatever_rows_repeat(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("cast(null as long) as id", "'same words' as text")
    rows.unionByName(spark.range(50).selectExpr("id", "'you idiot, you moron' as text")).write.parquet(f"{tmp_path}/rows")
    table = spark.read.parquet(f"{tmp_path}/rows")
    got = toxicity._sampled(table, 20_000)
    assert 19_000 <= got.count() <= 20_000
    assert toxicity._sampled(table, 200_000).count() == 100_050
    docs = table.withColumnRenamed("id", "doc_id")
    labels = spark.createDataFrame([(i, 1, 1, "x", "x") for i in range(50)], LABELS)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == ["doc_id", "text"] and kept.where("doc_id is null").count() == 100_000
    assert kept.where("doc_id is not null").count() == 0
