"""Publication by a pointer, scans with a status, validation in one pass, reading order."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomstone.operators import layout, validate
from loomstone.sources import publish, readers


def test_publish_and_check(spark, tmp_path, monkeypatch):
    root, texts = f"{tmp_path}/site", lambda rows: spark.createDataFrame(rows, "name string, text string")
    acts = lambda df: {r["name"]: r["action"] for r in df.collect()}
    assert acts(publish.check(texts([("a", "1")]), root)) == {"a": "add"} and publish.current(spark, root) is None
    assert acts(publish.publish(texts([("a", "1"), ("b", "x\r\ny")]), root)) == {"a": "add", "b": "add"}
    second = texts([("b", "x\ny"), ("a", "2"), ("c", "3")])
    assert acts(publish.check(second, root)) == {"a": "update", "b": "ok", "c": "add"}
    with monkeypatch.context() as m:
        m.setattr(publish, "rename", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            publish.publish(second, root)
    assert publish.current(spark, root) == 1 and {tuple(r) for r in publish.published(spark, root).collect()} == {("a", "1"), ("b", "x\r\ny")}
    assert acts(publish.publish(texts([("c", "3")]), root)) == {"a": "stale", "b": "stale", "c": "add"}
    assert [r["name"] for r in publish.published(spark, root, "manifest").collect()] == ["c"] and acts(publish.check(texts([("c", "3")]), root)) == {"c": "ok"}


def test_vendored_parts(spark):
    places = spark.createDataFrame([("p2", "Two", None), ("p1", "One", 1.5), ("p3", "Three", None)], "place_id string, name string, lat double")
    wanted = spark.createDataFrame([("r", "p2"), ("r", "p1"), ("r", "p1"), ("s", "p3"), ("s", "gone")], "repo string, place_id string")
    found = {r["name"]: json.loads(r["text"]) for r in publish.vendored_places(places, wanted).collect()}
    assert found == {"r/places.json": [{"place_id": "p1", "name": "One", "lat": 1.5}, {"place_id": "p2", "name": "Two"}], "s/places.json": [{"place_id": "p3", "name": "Three"}]}
    ids = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "b"), ("r", ""), ("r", None)], "repo string, id string")
    assert [tuple(r) for r in publish.vendored_terms(ids).collect()] == [("r/terms.json", '["a","b"]')]


def test_scan_keeps_a_row_for_each_file(spark, tmp_path):
    folder = tmp_path / "texts"
    (folder / "below").mkdir(parents=True)
    (folder / "a.txt").write_text("é one", encoding="utf-8")
    (folder / "b.txt").write_bytes(b"tw\xffo")
    (folder / "c.md").write_text("other")
    (folder / "empty.txt").write_text("")
    (folder / "below" / "d.txt").write_text("deep")
    rows = {r["name"]: (r["bytes"], r["status"], r["text"]) for r in readers.scan_folder(spark, str(folder)).collect()}
    assert rows == {"a.txt": (6, "read", "é one"), "b.txt": (4, "broken", "two"), "c.md": (5, "skipped", None), "empty.txt": (0, "read", "")}
    listed = readers.scan_folder(spark, str(folder))
    listed.count()
    plan = listed.select("name", "bytes", "status")
    (folder / "b.txt").unlink()  # listed, but gone when it is read
    assert {r["name"]: r["status"] for r in plan.collect()}["b.txt"] == "unreadable"


def test_roots(spark, tmp_path):
    for n in ("one/data", "two/data", "three", ".hidden/data"):
        (tmp_path / n).mkdir(parents=True)
    base = str(tmp_path)
    assert readers.known_roots(spark, base) == ["one", "two"]
    assert readers.resolve_root(spark, "one", base) == f"{base}/one/data" == readers.resolve_root(spark, f"{base}/one", base)
    assert readers.resolve_root(spark, f"{base}/three", base) == f"{base}/three"
    with pytest.raises(ValueError, match="one, two"):
        readers.resolve_root(spark, "none", base)


def test_validation_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else "t", "p" if i % 2 else "Name (a note)") for i in range(60)], "locator int, title string, publisher string")
    found = validate.report([validate.issues(rows, validate.blank("title"), "T1", F.col("locator"), "no title"), validate.issues(rows, F.col("locator") > 50, "T2", F.col("locator"), "large", "warning"), validate.publishers(rows)])
    counts = validate.write_report(found, f"{tmp_path}/out")
    written = spark.read.json(f"{tmp_path}/out").groupBy("severity").count().collect()
    assert counts == {"errors": 70, "warnings": 9} and {r["severity"]: r["count"] for r in written} == {"error": 70, "warning": 9}
    plan = validate.report([validate.issues(rows, validate.blank("title"), "T1", F.col("locator"), "a"), validate.issues(rows, validate.blank("publisher"), "T1", F.col("locator"), "b")])
    assert "Union" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_a_failing_ladder_raises(spark):
    schema = "pos int, label string, status string, sources array<string>, noDocument boolean"
    good = [(1, "L", "approved", ["r"], None), (2, "L", "none", None, True)]
    assert validate.ladder_rungs(spark.createDataFrame(good, schema)).count() == 2
    for bad, why in (((3, " ", "approved", ["r"], None), "label"), ((3, "L", None, ["r"], None), "status"), ((3, "L", "granted", [], None), "cited"), ((3, "L", "never-sought", ["r"], False), "nothing")):
        with pytest.raises(PySparkException, match=f"V12 at 3.*{why}"):
            validate.ladder_rungs(spark.createDataFrame([*good, bad], schema)).collect()


def test_reading_order(spark):
    r = random.Random(6)
    nodes = [(0, None, 0)] + [(i, r.randrange(max(0, i - 4), i) if i % 20 else None, r.randrange(3)) for i in range(1, 120)]
    nodes += [(500, 501, 0), (501, 500, 0), (502, 999, 0), (503, 502, 1)]  # a circle, and a parent that there is not
    found = {x.id: (x.root, x.depth, x.place) for x in layout.reading_order(spark.createDataFrame(nodes, "id int, parent int, pos int"), deepest=64).collect()}
    below = {}
    for i, parent, pos in nodes:
        below.setdefault(parent, []).append((pos, i))
    want = {}

    def walk(i, root, depth):
        want[i] = (root, depth, sum(x[0] == root for x in want.values()) + 1)
        for _, c in sorted(below.get(i, [])):
            walk(c, root, depth + 1)

    for _, i in sorted(below[None]):
        walk(i, i, 0)
    assert found == want


def test_lineage_nodes(spark):
    tree = {"lineage": {"trees": [{"root": {"name": "A", "children": [{"name": "B", "edge": "indirect"}, {"name": "C", "children": [{"name": "D"}]}]}}, {"root": {"name": "E"}}]}}
    data = spark.createDataFrame([("r", json.dumps(tree)), ("s", "{}")], "repo string, j string").select("repo", F.parse_json("j").alias("v"))
    rows = [(list(x.label), x.name, x.edge) for x in layout.lineage_nodes(data).orderBy("label").collect()]
    assert rows == [([0], "A", None), ([0, 0], "B", "indirect"), ([0, 1], "C", None), ([0, 1, 0], "D", None), ([1], "E", None)]
