import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from kbspark.llm import periodic_runs
from kbspark.llm.queries import QUERIES


def brute(words, least=24, times=3):
    """Every maximal run by trying all periods word by word."""
    n, runs = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                runs.setdefault((i, j + q), q)  # smaller periods come first
            i = j
    return sorted(((a, b - a, q) for (a, b), q in runs.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(4)
            if kind == 0:
                words += rng.choices("abcdefghijklmnop", k=rng.randrange(0, 60))
            elif kind == 1:
                period = rng.choices("ab" if rng.random() < 0.5 else "abcdefgh", k=rng.randrange(1, 50))
                words += (period * rng.randrange(2, 9))[:rng.randrange(1, 250)]
            elif kind == 2:
                inner = rng.choices("xyz", k=rng.randrange(1, 4)) * rng.randrange(3, 12)
                words += (inner + ["|"]) * rng.randrange(1, 6)
            else:
                words += ["a"] * rng.randrange(0, 80)
        yield words


def test_runs_against_brute_force():
    for words in texts(random.Random(13)):
        assert periodic_runs.runs_of(words) == brute(words), words


@pytest.mark.parametrize("least, times", [(4, 3), (6, 3), (30, 4)])
def test_other_bounds(least, times):
    for words in list(texts(random.Random(least)))[:120]:
        assert periodic_runs.runs_of(words, least, times) == brute(words, least, times)


def test_two_times_are_refused(make_docs):
    with pytest.raises(ValueError):
        periodic_runs.find_runs(make_docs([]), times=2)


def test_long_texts_take_little_time():
    words = [f"w{i}" for i in range(70_000)]
    assert periodic_runs.runs_of(words * 3) == [(0, 210_000, 70_000)]
    assert periodic_runs.runs_of(["a", "b"] * 150_000) == [(0, 300_000, 2)]


def test_rare_words_split_again():
    # "x" occurs often in the whole, but not within the parts that "|" leaves
    words = ["x"] * 2 + ["a"] * 30 + ["|"] + ["x"] * 2 + ["b"] * 30
    assert [(s, n) for s, n, _ in periodic_runs.runs_of(words)] == [(2, 30), (35, 30)]


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 30), (5, "one two three\x85 four\x1c " * 9), (6, "x" * 100_000), (7, "z " * 40), (7, "z " * 40),
       (None, "q r " * 20), (10, "long word list " * 9000), (40, " ".join(map(str, range(100))))]


def reference(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words) if n <= 5000 else periodic_runs.runs_of(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(make_docs, clash, tmp_path):
    rng = random.Random(5)
    many = [(i, " ".join(rng.choices("abc d e f".split() + [f"w{k}" for k in range(30)], k=rng.randrange(0, 150)))) for i in range(100, 400)]
    make_docs(ODD + many, **clash).write.parquet(f"{tmp_path}/documents.parquet")
    spark = make_docs([]).sparkSession
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()
    want = [reference(i, t) for i, t in ODD + many]
    assert sum(w[1] for w in want) >= 15  # the fixture has runs to find
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    make_docs([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/none").collect() == []


def test_given_documents(spark):
    from kbspark.llm.common import table

    sf = "/root/testdata/sf0.001"
    rows = [r for r in table(spark, sf, "documents").collect() if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).select(*COLUMNS).collect()}
    for r in rows:
        assert got[r.doc_id] == reference(r.doc_id, r.text)
