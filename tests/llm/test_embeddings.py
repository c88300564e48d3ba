import math

import numpy as np
import pytest

from kbspark.llm import embedding_join

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, block string, links string"


def brute(rows, threshold=0.93):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        a = np.array(v, dtype=np.float32).astype(float)
        a = a / np.abs(a).max()
        ok[k] = (i, a / np.sqrt((a * a).sum()), label)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    parent, links = {i: i for i in ids}, {i: 0 for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x, lab) in ok.items():
        for b, (j, y, lab2) in ok.items():
            if i != j and lab == lab2 and len(x) == len(y) and float(x @ y) >= threshold:
                links[i] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, links.get(i, 0), find(i) if i is not None else None, i is None or find(i) == i) for i, *_ in rows), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "c", "b", "l") for r in rows], SCHEMA)
    return sorted(((r.id, r.n_links, r.component_id, r.kept) for r in embedding_join.link_embeddings(df, **kw).collect()), key=str)


def clusters(n, dim, spread, seed, groups):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(k, (centres[k % groups] + rng.normal(size=dim) * spread).tolist(), k % 3) for k in range(n)]


@pytest.mark.parametrize("dim, spread, groups", [(4, 0.25, 12), (32, 0.25, 9)])
def test_equal_to_brute_force_in_cells_and_blocks(spark, monkeypatch, dim, spread, groups):
    monkeypatch.setattr(embedding_join, "BLOCK", 16)
    monkeypatch.setattr(embedding_join, "STREAM", 5)
    rows = clusters(400, dim, spread, 3, groups)
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1),
            (8, [1.0, None], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [3.0, 0.0, 0.0], 1),
            (0, [1e-30, 0.0], 1), (13, [3e38, 0.0], 1), (14, [1.0, 0.0], 2), (14, [1.0, 0.1], 2), (15, [-1.0, 0.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None, None)]) == [(1, 0, 1, True)]


def test_visits_lose_no_partner():
    rng = np.random.default_rng(0)
    radius = math.sqrt(2 - 2 * 0.93)
    x = rng.normal(size=(1500, 3))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    home, present = embedding_join.visited(x, x[:16], radius)
    assert present.mean() < 0.6  # cells do prune where space is small
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert present[a, home[b]].all()
