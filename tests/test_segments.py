"""A kept-up index against one that is built anew."""

import random

import pytest

from loomstone.operators import index, segments
from loomstone.sources import sinks

SCHEMA = "doc_id long, text string, collection string, review string, deleted boolean"
QUERIES = ['"a b" OR c', "NEAR(a c, 2)", "d* NOT a"]


def text(r):
    return " ".join(r.choices("abcdefgh", k=r.randint(0, 12)))


def same(spark, kept, rebuilt):
    for q in QUERIES:
        rows = lambda i: sorted((r.doc_id, r.offset, r.collection, round(r.score, 9)) for r in index.hits(spark, i, q).collect())
        assert rows(kept) == rows(rebuilt)
        assert [r.doc_id for r in index.top_hits(spark, kept, q, most=5)[0].collect()] == [r.doc_id for r in index.search_index(spark, rebuilt, q, most=5).collect()]


def test_equals_a_rebuild_after_changes_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BLOCK", 8)
    r, path, state = random.Random(2), f"{tmp_path}/kept", {}
    for k in range(5):
        ids = r.sample(range(40), 15)
        rows = [(i, text(r), "xy"[i % 2], None, k > 0 and i % 5 == 0) for i in ids]
        state |= {row[0]: row for row in rows}
        segments.apply(spark.createDataFrame(rows, SCHEMA), path)
        state = {i: row for i, row in state.items() if not row[4]}
    sinks.write_index(spark.createDataFrame(list(state.values()), SCHEMA).drop("deleted"), f"{tmp_path}/rebuilt")
    kept = segments.opened(spark, path)
    same(spark, kept, f"{tmp_path}/rebuilt")
    assert kept.size.first()[0] == kept.chunks.count() and not kept.whole
    before = segments.versions(spark, path)[-1]
    assert segments.merge(spark, path, fanout=2) is not None and len(segments.entries(spark, path)) < 5
    same(spark, segments.opened(spark, path), f"{tmp_path}/rebuilt")
    assert len(segments.entries(spark, path, before)) == 5  # the version before still reads
    segments.vacuum(spark, path, 1)
    assert segments.versions(spark, path) == [segments.versions(spark, path)[-1]]
    same(spark, segments.opened(spark, path), f"{tmp_path}/rebuilt")


def test_a_failed_write_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/kept"
    first = segments.apply(spark.createDataFrame([(1, "a b", "x", None, False), (2, "", "x", None, False)], SCHEMA), path)
    with monkeypatch.context() as m:
        m.setattr(segments, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            segments.apply(spark.createDataFrame([(1, "c", "x", None, False)], SCHEMA), path)
    assert segments.versions(spark, path) == [first]
    assert [r.doc_id for r in index.hits(spark, segments.opened(spark, path), "a").collect()] == [1]
    # The next change takes another number, so that nothing of the failed one is read.
    assert segments.apply(spark.createDataFrame([(2, "c", "y", None, False)], SCHEMA), path) > first + 1
    assert [r.collection for r in segments.opened(spark, path).docs.filter("doc_id = 2").collect()] == ["y"]
    with pytest.raises(ValueError):
        segments.opened(spark, f"{tmp_path}/nothing")


def test_a_stream_appends_segments_once(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/kept"
    schema = f"{SCHEMA}, version long"
    spark.createDataFrame([(1, "old", "x", None, False, 1), (1, "new words", "x", None, False, 2), (2, "gone", "x", None, False, 1)], schema).coalesce(1).write.parquet(source)
    run = lambda: segments.follow(spark.readStream.schema(schema).parquet(source), path).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([(2, "gone", "x", None, True, 2), (3, "new", "x", None, False, 1)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    kept = segments.opened(spark, path)
    assert sorted(r.doc_id for r in index.hits(spark, kept, "new").collect()) == [1, 3] and index.hits(spark, kept, "gone OR old").count() == 0
    assert [e["batch"] for e in segments.entries(spark, path)] == [0, 1] and segments.last_batch(spark, path) == 1
    segments.apply(spark.createDataFrame([(3, None, None, None, True)], SCHEMA), path)  # removals alone make no segment
    assert len(segments.entries(spark, path)) == 2 and index.hits(spark, segments.opened(spark, path), "new").count() == 1
