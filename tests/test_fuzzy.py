"""Token-sort ratio (M3) and the blocked joins of M2."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kbspark.functions import fuzzy as fz
from kbspark.operators import match
from kbspark.operators import needles as nd


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcde ", max_size=80), st.text(alphabet="abcde ", max_size=80))
def test_bit_parallel_lcs_equals_dp(a, b):
    assert fz.lcs_length(a, b) == lcs_dp(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcxyz ", max_size=40), st.text(alphabet="abcxyz ", max_size=40), st.integers(50, 100))
def test_pruned_ratio_is_exact_above_threshold(a, b, t):
    full = fz.ratio_py(a, b)
    pruned = fz.ratio_at_least_py(a, b, t)
    if full is not None and full >= t:
        assert pruned == full
    if pruned is not None:
        assert pruned == full


def test_ratio_edges():
    assert fz.ratio_py("a b", "a b") == 100
    assert fz.ratio_py("", "") == 100
    assert fz.ratio_py("abc", "") == 0
    # 2*LCS/len = 179/200 -> 89.5 -> 90 (half-even); 181/200 -> 90.5 -> 90
    assert int(round(100 * (179 / 200))) == 90 and int(round(100 * (181 / 200))) == 90


def test_token_sort_key_reorders(spark):
    df = spark.createDataFrame([("World, hello!", "hello world")], "a string, b string")
    r = df.select(fz.token_sort_key("a").alias("a"), fz.token_sort_key("b").alias("b")).first()
    assert r["a"] == r["b"] == "hello world"
    assert df.select(fz.token_sort_ratio("a", "b")).first()[0] == 100


def _brute(questions, catalog, threshold=90):
    def pre(t):
        return re.sub(r"\W+", " ", t.lower()).strip()
    bad = {i: None for i in range(128, 256)}

    def ts(t):
        t = t.translate(bad)
        t = re.sub(r"(?ui)\W", " ", t).lower().strip()
        return " ".join(sorted(t.split()))
    out = set()
    for qi, q in questions:
        for ci, c in catalog:
            if c is None:
                continue
            a, b = pre(q), pre(c)
            s = 100 if a in b else fz.ratio_py(ts(a), ts(b))
            if s >= threshold:
                out.add((qi, ci, s))
    return out


CAT = [(1, "Tela inicial do aplicativo de vendas"), (2, "tela inicial"), (3, None), (4, "menu pesquisar na loja"),
       (5, "aplicativo vendas inicial tela do de"), (6, "x"), (7, "tela inicia do aplicativo de venda"),
       (8, "Configuração do aplicativo"), (9, "a tela inicial do aplicativo de vendas tem menu")]
QS = [(10, "tela inicial do aplicativo de vendas"), (11, "menu"), (12, ""), (13, "configuracao"),
      (14, "inicial"), (15, "é")]


def test_blocked_match_equals_brute_force(spark):
    q = spark.createDataFrame(QS, "question_id long, question string")
    c = spark.createDataFrame(CAT, "image_row long, description string")
    got = {tuple(r) for r in match.match_scores(q, c).collect()}
    assert got == _brute(QS, CAT)


def test_topk_ties_in_catalogue_order_and_nulls_skipped(spark):
    cat = [(i, "tela inicial") for i in (9, 3, 7, 1, 5, 2)] + [(4, None)]
    q = spark.createDataFrame([(1, "tela")], "question_id long, question string")
    c = spark.createDataFrame(cat, "image_row long, description string")
    top = match.top_matches(q, c).orderBy("rank").collect()
    assert [r["image_row"] for r in top] == [1, 2, 3, 5, 7]
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5]


def test_like_semantics(spark):
    cat = [(1, "axb"), (2, "50 reais"), (3, "é grande"), (4, "path a\\b"), (5, "AXB maior")]
    qs = [(1, "a_b"), (2, "50%"), (3, "É"), (4, "a\\b")]
    c = spark.createDataFrame(cat, "image_row long, description string")
    q = spark.createDataFrame(qs, "question_id long, question string")
    got = sorted(tuple(r) for r in match.like_matches(q, c).collect())
    assert got == [(1, 1), (1, 4), (1, 5), (2, 2), (4, 4)]


def test_literal_mode_has_no_wildcards(spark):
    qs = [(1, "50%"), (2, "a_b"), (3, ""), (4, "Tela")]
    texts = [(1, "mais 50% hoje"), (2, "500"), (3, "xa_by"), (4, "axb"), (5, "a TELA"), (6, None)]
    q = spark.createDataFrame(qs, "question_id long, question string")
    c = spark.createDataFrame(texts, "image_row long, description string")
    got = sorted(tuple(r) for r in match.like_matches(q, c, literal=True).collect())
    assert got == sorted((i, j) for i, a in qs for j, b in texts if b is not None and a.lower() in b.lower())


def test_letter_bound_never_drops_a_passing_pair(spark):
    import random

    from kbspark.functions.fuzzy import ratio_py
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta1", "omega", "日本"]
    rows = [(i, " ".join(sorted(rnd.choice(words) + rnd.choice(["", "s", "x"]) for _ in range(rnd.randrange(1, 9))))) for i in range(120)]
    q = spark.createDataFrame(rows, "_qk long, t string")
    c = spark.createDataFrame(rows, "image_row long, u string")
    got = {(r["_qk"], r["image_row"]): r["match_score"] for r in match.fuzzy_pairs(q, c, "image_row", "t", "u", 90).collect()}
    from kbspark.functions.fuzzy import token_sort_key
    keys = {r["_qk"]: r["k"] for r in q.select("_qk", token_sort_key("t").alias("k")).collect()}
    want = {(i, j): ratio_py(keys[i], keys[j]) for i in keys for j in keys}
    assert got == {k: v for k, v in want.items() if v >= 90}


def test_hit_map_empty_for_no_hits(spark):
    q = spark.createDataFrame([(1, "tela"), (2, "zzz")], "question_id long, question string")
    c = spark.createDataFrame([(1, "tela", "a.png")], "image_row long, description string, filename string")
    top = match.top_matches(q, c.select("image_row", "description")).join(c.select("image_row", "filename"), "image_row")
    m = {r["question_id"]: r["images"] for r in match.hit_map(top, q).collect()}
    assert m[2] == {} and m[1]["image_0001"]["url"] == "/api/images/a.png"


words = st.text(alphabet="abcde é漢😀", max_size=90)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), max_size=40), st.integers(1, 100))
def test_batch_ratios_equal_the_textbook_lcs(pairs, t):
    # repeated, so that groups are large enough for the bit vectors of whole batches
    a, b = [x for x, _ in pairs] * 40, [y for _, y in pairs] * 40
    want = []
    for x, y in pairs:
        want.append(100 if x == y else 0 if not x or not y else int(round(100 * ((2 * lcs_dp(x, y)) / (len(x) + len(y))))))
    assert fz.ratios(a, b) == want * 40
    assert fz.ratios(a, b, t) == [w if w >= t else None for w in want] * 40


def test_batch_ratios_of_nulls_and_long_strings():
    assert fz.ratios([None, "a", ""], ["a", None, ""]) == [None, None, 100]
    assert fz.ratios([], []) == []
    long = "abc " * 2000
    assert fz.ratios([long, long], [long + "x", "z" * 8000], 90) == [fz.ratio_py(long, long + "x"), None]


@pytest.mark.parametrize("chars", [nd.BLOCK_CHARS, 40])
def test_needle_blocks_equal_brute_force(spark, chars, monkeypatch):
    rnd = random.Random(chars)
    monkeypatch.setattr(nd, "BLOCK_CHARS", chars)
    monkeypatch.setattr(nd, "MAX_BLOCKS", 1000)
    needles = ["", "a", "ab", "é漢", "abcabc", None] + ["".join(rnd.choices("abcé漢 ", k=rnd.randrange(1, 6))) for _ in range(60)]
    texts = [(i, "".join(rnd.choices("abcé漢 ", k=rnd.randrange(0, 40)))) for i in range(120)] + [(500, None), (501, "")]
    q = spark.createDataFrame([(n,) for n in needles], "needle string")
    t = spark.createDataFrame(texts, "id long, text string")
    blocks = nd.needle_blocks(q, "needle", chars)
    assert blocks == 1 or blocks > 3
    got = [tuple(r) for r in nd.texts_with_needles(q, "needle", t, "id", "text", blocks).collect()]
    want = {(i, n) for i, x in texts if x is not None for n in needles if n is not None and n in x}
    assert len(got) == len(set(got)) and set(got) == want


def test_the_join_beyond_the_bound_gives_the_same_rows(spark, monkeypatch):
    q = spark.createDataFrame(QS, "question_id long, question string")
    c = spark.createDataFrame(CAT, "image_row long, description string")
    qs = spark.createDataFrame([(1, "a_b"), (2, "50%"), (3, "tela%de"), (4, "%"), (5, "O")], "question_id long, question string")
    seen = []
    for most in (nd.MAX_BLOCKS, 0):
        monkeypatch.setattr(nd, "MAX_BLOCKS", most)
        seen.append(({tuple(r) for r in match.match_scores(q, c).collect()}, {tuple(r) for r in match.like_matches(qs, c).collect()}))
    assert seen[0] == seen[1] and seen[0][0] == _brute(QS, CAT)
