"""Plan shape: blocked joins never fall back to cartesian products; top-k
uses a group limit; ordinals are partitioned windows; pruning reaches the scan."""

import io
import contextlib

import pytest

from kbspark.plans.queries import QUERIES
from oracle_util import SF_SMALL


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["m4_topk_documents", "m2_match_score", "m1_like_search", "m3_token_sort_pairs",
                                  "m9_tfidf_best", "m7_best_match", "d1_replace_by_position", "c4_append_images"])
def test_no_cartesian(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_topk_has_group_limit(spark):
    p = plan(QUERIES["m4_topk"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_ordinal_windows_are_partitioned(spark):
    p = plan(QUERIES["d8_image_ordinals"](spark, SF_SMALL))
    assert "Window" in p and "SinglePartition" not in p


def test_column_pruning_reaches_scan(spark):
    p = plan(QUERIES["i4_catalog_scan"](spark, SF_SMALL))
    scan = [line for line in p.splitlines() if "ReadSchema" in line]
    assert scan and "lang" not in scan[0] and "n_chars" not in scan[0]


def test_fuzzy_udf_runs_once_and_text_work_is_not_duplicated(spark):
    """The LCS UDF is evaluated in one Python pass, and no inferred filter
    re-evaluates the token-sort chain below the catalogue scan."""
    p = plan(QUERIES["m3_token_sort_pairs"](spark, SF_SMALL))
    assert p.count("ArrowEvalPython") == 2  # one node: tree line + its detail section
    filters = [line for line in p.splitlines() if line.startswith("Condition") and "array_sort" in line]
    assert not filters, filters


def test_token_explodes_infer_no_size_filter(spark):
    """explode over tokenised whole texts must not get an inferred
    ``size(...) > 0`` filter (it would tokenise every document twice)."""
    p = plan(QUERIES["m9_tfidf_best"](spark, SF_SMALL))
    conds = [line for line in p.splitlines() if line.startswith("Condition") and "size(split" in line]
    assert not conds, conds


def test_tables_keep_the_scans_splits_unless_the_session_asks(spark):
    import kbspark.session as ks
    old = spark.conf.get(ks.READ_PARTITIONS, None)
    try:
        spark.conf.unset(ks.READ_PARTITIONS)
        assert "RoundRobinPartitioning" not in plan(ks.read_table(spark, SF_SMALL, "documents"))
        spark.conf.set(ks.READ_PARTITIONS, "4")
        assert "RoundRobinPartitioning(4)" in plan(ks.read_table(spark, SF_SMALL, "documents"))
    finally:
        spark.conf.set(ks.READ_PARTITIONS, old) if old else spark.conf.unset(ks.READ_PARTITIONS)


def test_a_prepared_catalogue_is_not_read_again(spark):
    """Question sets against a prepared catalogue read its written tables only."""
    from kbspark.operators import match
    from kbspark.sources.fixtures import Fixtures

    fx = Fixtures(spark, SF_SMALL)
    prepared = match.prepare(fx.catalog())
    top = match.top_matches(fx.questions(), prepared)
    assert "documents.parquet" not in plan(top)
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, match.top_matches(fx.questions(), fx.catalog()).collect()))


def test_vector_search_shuffles_no_catalogue(spark):
    """The catalogue is scored where it is read: one Python pass per question
    chunk, and the only exchange behind it carries the winners."""
    from kbspark.operators.vectors import nearest
    from kbspark.sources.fixtures import Fixtures

    fx = Fixtures(spark, SF_SMALL)
    catalog = fx.table("embeddings").selectExpr("vec_id AS image_row", "embedding AS title_vec", "embedding AS desc_vec")
    questions = fx.table("embeddings").selectExpr("vec_id AS question_id", "embedding AS q_vec")
    p = plan(nearest(questions, catalog))
    assert "FlatMapCoGroups" not in p and "MapInArrow" in p and "WindowGroupLimit" in p
