"""Exact top-k search against all scores, with ties, copies and odd vectors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomstone.llm import nearest

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows, k, asked=lambda i: i is not None and i % 100 == 0):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if asked(i):
            scores = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(good) if a != b]
            out += [(i, r, None if null else j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, null, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, rows, k=10, **options):
    df = spark.createDataFrame(rows, ROW).withColumn("cell", F.lit("x")).withColumn("rid", F.lit(1)).withColumn("score", F.lit(2))
    return sorted((tuple(r) for r in nearest.top_inner(df, F.col("vec_id") % 100 == 0, k, **options).collect()), key=repr)


def clustered(n, dim, seed, centres=12):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, 0.05) for x in base[r.randrange(centres)]], 0) for i in range(n)]


def rounded(rows):
    """Components that 32 bits hold exactly, so that the brute force sees the same."""
    return [(i, v and [None if x is None else round(x * 64) / 64 if math.isfinite(x) else x for x in v], c) for i, v, c in rows]


def test_equals_all_scores_with_ties_and_odd_rows(spark):
    rows = clustered(600, 6, 1) + [(7, [0.5] * 6, 0)] * 40 + [(100, [0.5] * 6, 0)] * 3
    rows += [(None, [1.0] * 6, 0), (200, None, 0), (300, [1.0, None], 0), (400, [float("nan")] * 6, 0), (500, [float("inf")] * 6, 0), (1000, [], 0), (1100, [2.0], None), (1200, [0.0] * 9, 0), (-100, [-1.0] * 6, 0)]
    rows = rounded(rows)
    assert found(spark, rows) == brute(rows, 10)


@pytest.mark.parametrize("queries, block", [(3, 64), (2048, 1 << 23)])
def test_packs_splits_and_blocks(spark, monkeypatch, queries, block):
    monkeypatch.setattr(nearest, "QUERIES", queries)
    monkeypatch.setattr(nearest, "BLOCK", block)
    # A third of all rows are one vector, some of them queries.
    rows = rounded(clustered(500, 4, 2) + [(100 * i, [1.0, -1.0, 0.25, 2.0], 0) for i in range(20)] + [(i, [1.0, -1.0, 0.25, 2.0], 0) for i in range(1, 230)])
    assert found(spark, rows, 5) == brute(rows, 5)


def test_few_rows_no_rows_and_large_numbers(spark):
    assert found(spark, [(0, [1.0], 0)]) == [] and found(spark, []) == []
    assert found(spark, [(0, [1.0], 0), (3, [2.0], 0)]) == [(0, 1, 3, 1024 * 2048)]
    large = [(0, [2.0**40, 1.0], 0), (1, [2.0**40, -1.0], 0), (2, [2.0, 1.0], 0), (3, [-(2.0**40), 1.0], 0), (4, [2.0, 3.0], 0)]
    assert found(spark, large) == brute(large, 10)


def test_rows_that_cannot_be_among_the_best_are_not_sent(spark, monkeypatch):
    rows = rounded(clustered(3000, 8, 5, centres=6))
    df = spark.createDataFrame(rows, ROW)
    counted, original = spark.sparkContext.accumulator(0), nearest._local

    def local(q, x, k, dim):
        counted.add(x.num_rows)
        return original(q, x, k, dim)

    monkeypatch.setattr(nearest, "_local", local)
    monkeypatch.setattr(nearest, "QUERIES", 1)
    out = sorted((tuple(r) for r in nearest.top_inner(df, F.col("vec_id") % 100 == 0, 10).collect()), key=repr)
    cells = len({tuple(r) for r in out}) // 10
    assert out == brute(rows, 10) and 0 < counted.value < 3000 * cells // 2
