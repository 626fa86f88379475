import random

import brute
import numpy as np
import pytest
from gridloom.llm import topk


def test_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 70)
    rng = random.Random(9)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), 0.0, 0.25, -3.0]) for _ in range(24)]) for i in range(400)]
    rows += [(1000, None), (1050, []), (1100, [None] * 24), (1150, [float("nan")] * 24), (1200, [float("inf")] + [0.0] * 23)]
    rows += [(401 + i, rows[50][1]) for i in range(8)]  # ties
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    got = sorted(tuple(r) for r in topk.top_k(spark, df.where("vec_id % 50 = 0"), df, 5).collect())
    assert got == brute.top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert topk.top_k(spark, df, df.limit(0), 5).collect() == [] and topk.top_k(spark, df.limit(0), df, 5).collect() == []
    few = df.where("vec_id < 3")
    assert topk.top_k(spark, few, few, 5).count() == 6


def test_slices_give_exact_products():
    rng = np.random.default_rng(0)
    for d in (1, 63, 64, 130):
        q, x = rng.integers(-900, 900, (4, d)), rng.integers(-(2**20), 2**20, (50, d))
        xs = np.ascontiguousarray(topk.slices(x, topk.bits_for(x)).transpose(1, 2, 0))
        for i, (ids, score) in enumerate(topk.block_top_k(q, np.arange(4) - 10, xs, np.arange(50), 5)):
            s = x @ q[i]
            want = np.lexsort((np.arange(50), -s))[:5]
            assert ids.tolist() == want.tolist() and score.tolist() == s[want].tolist()


def test_repeated_queries_and_large_components(spark):
    ddl = "vec_id long, embedding array<double>"
    rows = [(50, [1.0]), (50, [1.0]), (1, [2.0]), (2, [3.0]), (3, [1.0, 9.0])]
    df = spark.createDataFrame(rows, ddl)
    got = sorted(tuple(r) for r in topk.top_k(spark, df.where("vec_id % 50 = 0"), df, 2).collect())
    assert got == [(50, 1, 2, 3 * 65536), (50, 2, 1, 2 * 65536)]
    two = df.union(spark.createDataFrame([(50, [-1.0])], ddl))
    got = sorted((tuple(r) for r in topk.top_k(spark, two.where("vec_id % 50 = 0"), two, 1).collect()), key=str)
    assert got == [(50, 1, 2, 3 * 65536), (50, 1, 3, -65536)]
    with pytest.raises(Exception, match="31 bits"):
        topk.top_k(spark, df, spark.createDataFrame([(9, [1e30])], ddl), 1).collect()
