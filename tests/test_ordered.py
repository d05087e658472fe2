"""Scans along one order against plain loops, and their plans."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from loomstone.operators import consistency, ordered


def test_nearest_across_ranges(spark):
    r = random.Random(4)
    # Long runs of nulls reach over ranges; ties and null numbers come too.
    rows = [(None if r.random() < 0.02 else r.randrange(2000), r.randrange(90) if r.random() < 0.02 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "n int, v int, i int").repartition(7)
    found = {x.i: (x.lo, x.hi) for x in ordered.nearest(df, ["n"], "v").collect()}
    line = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0))
    want, last = {}, None
    for x in line:
        want[x[2]] = [last]
        last = x[1] if x[1] is not None else last
    last = None
    for x in reversed(line):
        want[x[2]].append(last)
        last = x[1] if x[1] is not None else last
    same = {}
    for x in rows:  # rows alike but for i may stand in any order
        same.setdefault(x[:2], []).append(x[2])
    for ids in same.values():
        assert sorted(map(repr, (found[i] for i in ids))) == sorted(repr(tuple(want[i])) for i in ids)


def test_numbers_and_previous(spark):
    r = random.Random(5)
    rows = [(r.randrange(50), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    found = {x.b: x.k for x in ordered.numbered(df, ["a", "b"], "k").collect()}
    assert found == {b: k for k, (_, b) in enumerate(sorted(rows), 1)}
    before = {x.b: x.p for x in ordered.previous(df, ["a", "b"], F.when(F.col("b") % 3 > 0, F.col("b")), "p").collect()}
    line = sorted(rows)
    assert before == {x[1]: (None if k == 0 or line[k - 1][1] % 3 == 0 else line[k - 1][1]) for k, x in enumerate(line)}
    assert ordered.numbered(df.limit(0), ["a"], "k").count() == 0 and ordered.nearest(df.limit(0), ["a"], "b").count() == 0


def test_no_window_without_partition(spark):
    seq = spark.createDataFrame([(i, None) for i in range(9)], "n int, t string").selectExpr("n", "date_add(date'2001-01-06', n) as d", "date_add(date'2001-01-07', n) as index_d")
    text = io.StringIO()
    with redirect_stdout(text):
        consistency.adjudicate(seq).explain("formatted")
        consistency.neighbour_anomalies(seq).explain("formatted")
    assert "Window" in text.getvalue() and "SinglePartition" not in text.getvalue()


def test_frames_only_grow(spark):
    rows = [(i % 3, i, None if i % 7 < 5 else i * 37 % 1000) for i in range(300)]
    seq = spark.createDataFrame(rows, "g int, n int, v int").selectExpr("g", "n", "date_add(date'2001-01-06', v) as d", "date_add(date'2001-01-07', v) as index_d")
    text = io.StringIO()
    with redirect_stdout(text):
        ordered.nearest(seq, ["n"], "d").explain()
        consistency.nearest_dated(seq, ["g"]).explain()
    # A frame that ends with the partition is summed up anew for each row.
    assert "unboundedpreceding" in text.getvalue() and "unboundedfollowing" not in text.getvalue()
    found = {x.n: (x.lo, x.hi) for x in consistency.nearest_dated(seq, ["g"]).collect()}
    dates = {x.n: (x.g, x.d) for x in seq.collect()}
    for n, (g, _) in dates.items():
        own = [(m, d) for m, (h, d) in sorted(dates.items()) if h == g and d is not None]
        assert found[n] == (next((d for m, d in reversed(own) if m < n), None), next((d for m, d in own if m > n), None))
