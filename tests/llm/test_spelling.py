import random
import zlib
from collections import Counter

import numpy as np
import pytest
import re

from kbspark.llm import spelling
from kbspark.llm.fm_index import Vocabulary, one_error
from kbspark.llm.queries import QUERIES


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def some_words(rng, letters, lengths, n):
    words = ["".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(n)]
    for w in words[:n // 2]:
        i = rng.randrange(len(w))
        words.append(w[:i] + rng.choice(letters) + w[i + rng.randrange(2):])
    return sorted({w for w in words if len(w) >= 2})


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdeéÿ", "aあ漢😀"])
def test_search_scheme_against_brute_force(letters):
    rng = random.Random(len(letters))
    for n in (1, 2, 6, 60, 150):
        words = some_words(rng, letters, (2, 5, 5, 6, 7, 9, 30), n)
        index = Vocabulary(spelling._points(words), np.array([len(w) for w in words]))
        got = set()
        for length in {len(w) for w in words}:
            group = [w for w in words if len(w) == length]
            asked = index.encode(spelling._points(group).reshape(len(group), length))
            for side, exact in ((Vocabulary.RIGHT, length // 2), (Vocabulary.LEFT, length - length // 2)):
                got |= {(group[q], words[w]) for q, w in zip(*one_error(index, asked, exact, side))}
        assert got == {(a, b) for a in words for b in words if is_near(a, b)}


def brute(counts):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


@pytest.mark.parametrize("block_rows", [spelling.BLOCK_ROWS, 40])
def test_variants_against_brute_force(spark, block_rows):
    rng = random.Random(block_rows)
    # one half of very many words, besides words of all kinds
    words = sorted({*some_words(rng, "abcd", (5, 6, 7), 120), *(f"prefi{a}{b}" for a in "abcdefghij" for b in "abcdefghijkl"), "x" * 3000, "x" * 3001})
    counts = {w: rng.choice((3, 4, 6, 8, 8, 20, 50, 400)) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_variants(frame, block_rows=block_rows).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == brute(counts)
    pairs = spelling.near_words(frame, block_rows).collect()
    assert len(pairs) == len({(r.word, r.near) for r in pairs})


def test_empty_and_bad_input(spark, make_docs):
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert spelling.group_texts(make_docs([(1, None), (2, "")])).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def vocabulary(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query(make_docs, clash, tmp_path):
    rng = random.Random(12)
    words = ["House", "house", "HOUSES", "straße", "Straẞe", "ÀÉÎÕÜ×÷", "colour", "color", "cólor", "x" * 50, "ab", "word1word2"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(60)] + [(1, None), (2, ""), (None, "house hause hause hause colour " * 5), (7, "y" * 200_000), (7, "same words here"), (7, "same words here"), (8, "words here")]
    make_docs(rows, **clash).write.parquet(f"{tmp_path}/documents.parquet")
    spark = make_docs([]).sparkSession
    got = QUERIES["op12_spelling_variants"](spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute(vocabulary(rows))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(w[1] is not None for w in want) >= 3
