import hashlib
import re
from collections import defaultdict

from kbspark.llm import exact_dedup

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, None), (2, ""), (7, "\x0b"), (8, " "), (6, "a\xa0b"), (1, "x" * 200_000), (10, "x" * 200_000),
        (12, "same"), (12, "same"), (None, "only null"), (None, "a b")]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_equal_brute_force(make_docs, clash):
    got = exact_dedup.tree_dedup(make_docs(ROWS, **clash)).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in got], key=str) == brute(ROWS)


def test_a_large_group_and_empty_table(make_docs):
    rows = [(i, "copy") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 4000)]
    got = exact_dedup.tree_dedup(make_docs(rows)).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.kept, bytes(r.sha).hex()) for r in got], key=str) == brute(rows)
    assert exact_dedup.tree_dedup(make_docs([])).collect() == []


def test_drop_copies_keeps_one_row_and_all_columns(make_docs, clash):
    docs = make_docs(ROWS, **clash)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in ROWS})
    assert {r.doc_id for r in kept.collect()} == {3, 2, 7, 6, 1, 12, None}


def test_more_runs_than_the_least(make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 1)
    rows = [(i, f"t{i % 37}") for i in range(700)]
    got = exact_dedup.tree_dedup(make_docs(rows)).collect()
    assert {(r.id, r.keep_id, r.group_size) for r in got} == {(i, k, n) for i, k, n, *_ in brute(rows)}
