"""Exact top-k search against all pairs."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from frameloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, row string, cls string, g string, score string"


def brute(rows, k, every=20):
    """query_id, rank, vec_id, score of all queries, as a multiset."""
    vs = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            vs.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    vs = [(i, v) for i, v in vs if sum(x * x for x in v) < 2 ** 62]
    out = Counter()
    for a, (i, q) in enumerate(vs):
        if i is None or i % every:
            continue
        hits = sorted((-sum(x * y for x, y in zip(q, c, strict=True)), j is None, j or 0) for b, (j, c) in enumerate(vs) if b != a and len(c) == len(q))
        for r, (s, none, j) in enumerate(hits[:k], 1):
            out[(i, r, None if none else j, -s)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def rows(seed, n=240, d=9):
    rng = random.Random(seed)

    def vec(m):
        return [round(rng.gauss(0, 0.4), rng.choice([1, 4])) for _ in range(m)]

    out = [(i, vec(d)) for i in range(n)]
    copy = vec(d)
    out += [(1000 + i, copy) for i in range(60)] + [(2000 + 20 * i, copy) for i in range(5)]
    out += [(40, vec(d)), (40, copy), (40, copy), (7, copy), (None, vec(d)), (None, copy), (-20, copy)]
    out += [(60, None), (61, [None, *vec(d - 1)]), (80, [float("nan"), *vec(d - 1)]), (81, [float("inf"), *vec(d - 1)]), (100, [0.0] * d), (101, [0.0] * d)]
    out += [(120, []), (121, []), (140, vec(3)), (141, vec(3)), (160, [1e30] * d), (161, [1e6] * d), (180, [-3e5] * d), (181, [3e5] * d), (200, vec(1))]
    return [(*r, 0, *["x"] * 4) for r in out]


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_all_pairs(spark, lists):
    x = rows(lists)
    want = brute(x, 5)
    assert got(topk.top_products(spark.createDataFrame(x, SCHEMA), k=5, lists=lists)) == want
    small = topk.top_products(spark.createDataFrame(x, SCHEMA), k=5, lists=lists, query_block=7, group_rows=50)
    assert got(small) == want


def test_empty_and_few(spark):
    assert topk.top_products(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 0, *["x"] * 4)], SCHEMA)
    assert topk.top_products(one).collect() == []


def test_local_lists_shrink():
    """Many equal scores at the cutoff are cut to the k of smallest id, whatever the order."""
    c = np.ones((5000, 4), np.int64)
    b = topk.Queries(np.array([7]), np.ones((1, 4), np.int64), np.array([4]), 3, 2)
    ids = np.random.default_rng(0).permutation(5000)
    b.collect(c, ids, np.zeros(5000, np.int64), ids)
    assert sorted(b.results()["cls"].to_pylist()) == [0, 1, 2]
