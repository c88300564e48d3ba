import sys
import os

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle_util import compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from kbspark.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    got = compare(spark, name, SF, QUERIES, ORACLE)
    assert got["match"], got


def test_pipeline_against_brute_force(spark):
    from test_exact_dedup import norm
    from test_jaccard import brute
    from test_packing import check

    from kbspark.llm import toxicity
    from kbspark.llm.common import table, written

    docs = table(spark, SF, "documents")
    scores = {r.id: r.score for r in toxicity.score_documents(docs, table(spark, SF, "labels")).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] < 0.5)
    first = {}
    for i, t in rows:
        first.setdefault(norm(t), (i, t))
    rows = sorted(first.values())
    own = {i for i, _, c in brute(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in own]
    stage = docs
    for name, fn in corpus_pipeline.STAGES[:-1]:
        columns = stage.columns
        stage = written(fn(spark, stage, SF), name)
        assert stage.columns == columns
    assert sorted(r.doc_id for r in stage.collect()) == [i for i, _ in rows]
    out = corpus_pipeline.run(spark, SF).withColumnRenamed("doc_id", "id").withColumnRenamed("ids_crc32", "crc").collect()
    check(out, rows)


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "best_fit_packing"]
