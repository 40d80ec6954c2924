import math

import numpy as np
import pytest

from loopweave.llm import topk_search as ts


def brute(rows, k, scale):
    good = [(i, [math.floor(scale * c) for c in v]) for i, v in rows
            if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good
                       if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def ask(df, k, scale):
    return sorted(map(tuple, ts.top_k(df, df.filter("vec_id % 50 = 0"), k, scale=scale).collect()))


@pytest.mark.parametrize("shard,block", [(40, 7), (16_384, 256)])
def test_equals_brute_force(table, monkeypatch, shard, block):
    monkeypatch.setattr(ts, "SHARD", shard)
    monkeypatch.setattr(ts, "BLOCK", block)
    monkeypatch.setattr(ts, "QUERIES", 5)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # ties
    rows += [(700, None), (750, []), (800, [1.0] * 5 + [None]), (850, [float("nan")] * 6),
             (900, [float("inf")] + [0.0] * 5), (950, [1.0, 2.0]), (951, [0.5, -2.0]),
             (None, [1.0] * 6), (100, rows[100][1])]
    df = table("vec_id long, embedding array<float>, label int", [(*r, 1) for r in rows], 5)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v])
            for i, v in rows]
    assert ask(df, 5, 256.0) == brute(rows, 5, 256.0)


def test_large_components_stay_exact(table):
    rows = [(i, [float(2 ** 30 - i), float(3 * i)]) for i in range(0, 120, 10)]
    df = table("vec_id long, embedding array<double>", rows)
    assert ask(df, 3, 1.0) == brute(rows, 3, 1.0)


def test_components_of_any_size_count_and_scores_end_at_64_bits(table):
    rows = [(i, [float(i) * 1e3, -2.5, 1e8 if i % 20 == 0 else 1.0]) for i in range(0, 200, 10)]
    rows += [(250, [2.0 ** 31 - 1] * 3), (300, [1e200, -1e200, 1.0]), (301, [-1e200, 5.0, 2.0]),
             (302, [1e307, 1.0, 1.0]), (350, [1e308, 1.0, 1.0])]  # the last is infinite when scaled
    got = ask(table("vec_id long, embedding array<double>", rows, 3), 4, 256.0)
    most = ts.MOST
    wanted = []
    cells = [(i, [math.floor(256.0 * c) for c in v]) for i, v in rows if math.isfinite(256.0 * v[0])]
    for q, x in cells:
        if q % 50 == 0:
            found = sorted((-max(-most, min(most, sum(a * b for a, b in zip(x, y)))), i)
                           for i, y in cells if i != q)[:4]
            wanted += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert got == sorted(wanted)


def test_fewer_candidates_than_k_and_empty(table):
    rows = [(0, [1.0]), (1, [2.0])]
    assert ask(table("vec_id long, embedding array<double>", rows), 5, 1.0) == [(0, 1, 1, 2)]
    assert ask(table("vec_id long, embedding array<double>", []), 5, 1.0) == []


def test_blocks_are_skipped_where_vectors_cluster():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(16, 1, 8)) * 900 + rng.normal(size=(16, 256, 8))).reshape(-1, 8)
    x = x.astype(np.int32)
    ids = np.arange(len(x))
    *_, scored = ts.search_shard(ids[:20], x[:20], ids, x, 5, block=256)
    assert scored <= 2 * 20  # of 16 blocks for each of 20 queries
