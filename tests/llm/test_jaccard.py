import random

import numpy as np
import pytest

from kbspark.llm import jaccard_join
from kbspark.llm.shingles import shingle_set

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, "a b c d e"), (8, "A b c d e\n"), (9, "a b c d e f"), (10, "é à\xa0b c d e"),
       (11, "x " * 40_000), (12, "x " * 3), (13, "x x x x x x"), (None, "a b c d e"), (20, "rep one two three four five"), (20, "rep one two three four five"),
       (21, "k l m n o p"), (21, "a b c d e")]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = {i for i, _ in rows if i is not None}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def run(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()), key=str)


def family(rng, first, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(9999)}"
        out.append((first + k, " ".join(copy)))
    return out


def test_odd_texts(make_docs, clash):
    assert run(make_docs(ODD, **clash)) == brute(ODD)
    assert jaccard_join.near_duplicates(make_docs([])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_families_passages_and_strays(make_docs, monkeypatch, seed):
    """Groups whose members link only in part, shared passages, small blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "STREAM_ROWS", 16)
    rng = random.Random(seed)
    rows = []
    for k, (words, edits) in enumerate([(60, 4), (120, 9), (30, 2), (200, 16), (9, 1), (6, 1)]):
        rows += family(rng, 1000 * k, 40, words, edits)
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(9000 + k, passage + " " + " ".join(f"o{k}x{j}" for j in range(rng.randrange(5, 60)))) for k in range(60)]
    assert run(make_docs(rows)) == brute(rows)


def test_every_prefix_length_keeps_links():
    """Two linked sets share at least l tokens of level l or less, for both choices of l."""
    rng = random.Random(4)
    held = 0
    for _ in range(300):
        n = rng.randrange(5, 80)
        a = rng.sample(range(-10 ** 6, 10 ** 6), n)
        b = a[rng.randrange(0, n // 5 + 1):] + rng.sample(range(2 * 10 ** 6, 3 * 10 ** 6), rng.randrange(0, n // 6 + 1))
        union = set(a) | set(b)
        if 100 * len(set(a) & set(b)) < 75 * len(union):
            continue
        held += 1
        frequency = {t: (2 if t in a and t in b else 1) * rng.randrange(1, 4) for t in union}
        sides = []
        for s in (a, b):
            shared = np.array([t for t in s if frequency[t] >= 2], dtype=np.int64)
            df = np.array([frequency[t] for t in shared.tolist()], dtype=np.int64)
            length, prefix, level = jaccard_join.choose_prefix(len(s), sum(t < 0 for t in s), shared, df)
            sides.append((length, dict(zip(prefix.tolist(), level.tolist()))))
        # tokens held by both must be frequent in both
        need = min(sides[0][0], sides[1][0])
        common = [t for t in sides[0][1].keys() & sides[1][1].keys() if max(sides[0][1][t], sides[1][1][t]) <= need]
        both = [t for t in set(a) & set(b) if frequency[t] >= 2]
        if len(both) == len(set(a) & set(b)):
            assert len(common) >= need
    assert held > 50


def test_drop_near_copies_keeps_columns(make_docs, clash):
    rows = family(random.Random(7), 0, 12, 60, 2) + [(None, "a b c d e"), (50, "other words stand all alone here")]
    docs = make_docs(rows, **clash)
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute(rows) if i == c}
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_rows_that_share_an_id_are_dropped_by_their_own_text(make_docs, clash):
    rng = random.Random(11)
    (a, b), (c, d), (e, f), (g, h, i) = ([t for _, t in family(rng, 0, n, 60, 1)] for n in (2, 2, 2, 3))
    g, h, i = g + " x", g + " y", g + " z"
    clean, upper = "other words stand all alone here", a.upper()
    rows = [(1, a), (2, b + " z"), (2, clean), (2, ""), (2, None), (3, c), (4, d + " z"), (4, e), (7, f + " z"), (8, g), (8, h), (9, i), (1, upper), (None, a)]
    docs = make_docs(rows, **clash)
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    for one_of in ([(1, a), (1, upper)], [(8, g), (8, h)]):
        assert sum(row in got for row in one_of) == 1
        got = [row for row in got if row not in one_of]
    assert sorted(got, key=str) == sorted([(2, clean), (2, ""), (2, None), (3, c), (4, e), (None, a)], key=str)


def test_shingles_of_the_contract():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1 and len(shingle_set(" \n")) == 0
    assert (shingle_set("A\x0bB c") == shingle_set("a b\tc")).all()
    assert (shingle_set("É b c") != shingle_set("é b c")).all()
    assert (shingle_set("a\xa0b c d e f") == shingle_set("a\xa0B c d e f")).all()
    long = "y" * 100_000
    assert len(shingle_set(f"{long} a {long} b {long} c")) == 2


def test_hot_tokens_are_counted_alike(spark):
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(i, " ".join([common, *rng.choices("abcdefghij", k=rng.randrange(30))])) for i in range(200)]
    texts = spark.createDataFrame(rows, "id long, text string")
    counted = [sorted(map(tuple, jaccard_join.shared_tokens(texts, 1, hot).collect())) for hot in (150, 10_000)]
    assert counted[0] == counted[1] and max(c[2] for c in counted[0]) == 200
