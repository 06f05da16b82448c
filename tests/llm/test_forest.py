"""Nearest vectors against all products."""

import random

import pytest

pytest.importorskip("barloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from barloom.llm import forest  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, rank int"


def plain(rows, dims, k, every):
    import numpy as np

    kept = [(i, np.array([x for x in v], np.float32).astype(float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            x = sorted((-sum((q * v).tolist()), j) for m, (j, v) in enumerate(kept) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(x[:k])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(dims=12, n=400, seed=4):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 1) * (1 + k % 3) for _ in range(dims)], 1) for k in range(n)]
    rows += [(1000 + 5 * k, rows[3][1], 1) for k in range(60)]  # copies of one vector
    rows += [(2000, [0.0] * dims, 1), (2005, None, 1), (2010, [float("nan")] * dims, 1), (2015, [None] * dims, 1), (2020, [1.0], 1), (None, rows[5][1], 1), (2025, [float("inf")] * dims, 1)]
    return rows + [rows[10], rows[10], (10, rows[11][1], 1), (15, rows[10][1], 1)]


@pytest.mark.parametrize("cell", [4096, 16])
def test_exact_where_all_leaves_are_searched(spark, cell):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = result(forest.nearest(df, queries=F.col("vec_id") % 5 == 0, k=7, leaf=16, cell=cell, floor_sample=50))
    want = plain(rows, 12, 7, 5)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-12, abs=1e-12)


def test_few_and_none(spark):
    assert result(forest.nearest(spark.createDataFrame([], SCHEMA))) == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 1)], SCHEMA)
    assert result(forest.nearest(one)) == []
    two = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 1.0], 1)], SCHEMA)
    assert result(forest.nearest(two)) == [(1, 1, 2, 4.0), (2, 1, 1, 4.0)]


def test_recall(spark):
    r = random.Random(9)
    rows = [(k, [r.gauss(0, 1) for _ in range(32)], 1) for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = forest.nearest(df, queries=F.col("vec_id") % 50 == 0)
    assert forest.recall(df, got.cache()) >= 0.93
    less = forest.nearest(df, queries=F.col("vec_id") % 50 == 0, share=0.2, least=0)
    assert 0.3 < forest.recall(df, less) < 0.9  # the queue does leave leaves out


def test_recall_of_the_query(spark):
    from pyspark.errors import AnalysisException

    from barloom.llm.common import table

    try:
        df = table(spark, "/root/testdata/sf0.1", "embeddings")
    except AnalysisException:
        pytest.skip("no test data")
    assert forest.recall(df, forest.op13_query(spark, "/root/testdata/sf0.1")) >= 0.95
