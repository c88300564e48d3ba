from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.llm import chat
from kbspark.llm.queries import BOUNDARY, QUERIES

CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<SYS>>", "</SYS>>")


def format_rows(spark, rows, **kw):
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_trees(df, **kw)
    return out.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_branches_are_ranked_and_read_back(spark):
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "weak", 1.0), ("t", 3, 1, "assistant", "strong", 5.0),
            ("t", 4, 3, "user", None, None), ("t", 5, 4, "assistant", "end", 0.0), ("u", 1, 77, None, "orphan is a root", 0.0)]
    got = {(r.tree, r["rank"]): r for r in format_rows(spark, rows)}
    assert set(got) == {("t", 1), ("t", 2), ("u", 1)}
    best = got["t", 1]
    assert [(t.role, t.text) for t in best.turns] == [("user", "q"), ("assistant", "strong"), ("user", ""), ("assistant", "end")]
    assert best.leaf == 5 and best.score == 6.0 and best.loss == "strongend"
    assert [(r.tree, r.leaf) for r in format_rows(spark, rows, branches=1)] .__len__() == 2


def test_score_ties_go_to_the_smaller_leaf(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 3, 1, "assistant", "b", 1.0), ("t", 2, 1, "assistant", "a", 1.0)]
    assert {r.leaf: r["rank"] for r in format_rows(spark, rows)} == {2: 1, 3: 2}


def test_long_threads_take_few_joins(spark):
    rows = [("t", i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"m{i}", 0.0) for i in range(150)]
    (one,) = format_rows(spark, rows)
    assert [t.text for t in one.turns] == [f"m{i}" for i in range(150)] and one.n_turns == 150


def test_cycles_have_no_leaf_and_empty_tables_no_rows(spark):
    assert format_rows(spark, [("t", 1, 2, "user", "a", 0.0), ("t", 2, 1, "user", "b", 0.0)]) == []
    assert format_rows(spark, []) == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="\\<>[]/|sINSTY. \n\0é", max_size=12), min_size=1, max_size=15))
def test_escapes_are_reversible_and_leave_no_control_string(spark, texts):
    texts = texts + [c * 2 + "\\" + c for c in CONTROLS]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in CONTROLS)


def test_query_over_whole_table_and_boundary_case(spark):
    import hashlib

    got = {r.conv_id: r for r in QUERIES["op2_chat_formatting"](spark, "/root/testdata/sf0.001").collect()}
    edge = got[-1]
    assert (edge.n_turns, edge.loss_chars) == (2, len(BOUNDARY))
    assert edge.loss_sha256 == hashlib.sha256(BOUNDARY.encode()).hexdigest()
    assert edge.turns_sha256 == hashlib.sha256(f"user\n{BOUNDARY}\nassistant\n{BOUNDARY}\n".encode()).hexdigest()
