import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfline.llm import topk


def brute(rows, k=10):
    good = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[(vec_id, tuple(v))] = [math.floor(1024 * x) for x in v]
    out = []
    for (q, _), a in good.items():
        if q % 100 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), c) for (c, _), b in good.items() if c != q]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def run(spark, rows, k=10):
    return sorted(tuple(r) for r in topk.search(table(spark, rows), F.col("vec_id") % 100 == 0, k).collect())


def test_matches_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(0, 1, 8) * draw.choice([0.1, 1, 5])]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, []), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [-1.0, -1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3000, 3000), min_size=4, max_size=4), min_size=1, max_size=60), st.integers(1, 5))
def test_blocks_never_lose_a_result(vectors, k):
    m = np.array(sorted(vectors, key=lambda v: -sum(x * x for x in v)), np.int64)
    ids = np.arange(len(m)) * 7
    for n, own, found, scores in ((0, *f) for f in topk.search_block(ids, m, np.full(len(m), -np.inf), ids, m, k)):
        i = own // 7
        want = sorted((-int(m[i] @ m[j]), int(ids[j])) for j in range(len(m)) if j != i)[:k]
        assert [(-s, c) for s, c in zip(scores.tolist(), found.tolist())] == want
