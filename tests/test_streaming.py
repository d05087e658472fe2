import datetime

from loomstone.streaming import recheck
from loomstone.streaming.incremental import chunk_stream, upsert_stream


def test_chunks_arrive(spark, tmp_path):
    spark.createDataFrame([(1, "a. " * 700), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    query = chunk_stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrived").count() == 1


def test_upserts_by_key(spark, tmp_path):
    # Two rows of a key in one batch, and one that comes late.
    batches = [[("u1", "new", 2), ("u1", "old", 1), ("only0", "x", 1)], [("u1", "late", 1), ("only1", "x", 1)], [("only1", "y", 2)]]
    for batch in batches:
        spark.createDataFrame(batch, "url string, stamp string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema("url string, stamp string, n int").parquet(f"{tmp_path}/in")
        upsert_stream(rows, f"{tmp_path}/out", "url", f"{tmp_path}/c", "n").trigger(availableNow=True).start().awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/v2").collect()} == {("u1", "new", 2), ("only0", "x", 1), ("only1", "y", 2)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["v1", "v2"]


def test_second_look_after_the_grace(spark, tmp_path):
    """One site turns current within the grace, one stays stale, one is well at once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "site string, page string, at timestamp, served_status int, served string, source_status int, source string"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    looks = [
        [("a", "en", at(0), 200, "old", 200, "new"), ("a", "pt", at(0), 200, "x", 200, "x"), ("b", "en", at(0), 404, None, 200, "new"), ("c", "en", at(0), 200, "x", 200, "x")],
        [("a", "en", at(60), 200, "new", 200, "new"), ("b", "en", at(60), 200, "old", 200, "new")],
        [("d", "en", at(200), 200, "x", 200, "x")],
        [("d", "en", at(400), 200, "x", 200, "x")],
    ]
    for look in looks:
        spark.createDataFrame(look, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        reports = recheck.recheck(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        reports.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    found = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").filter("site <> 'd'").select("site", "page", "verdict", "stale", "rechecked").collect()}
    assert found == {("c", "en", "current", False, False), ("a", "en", "current", False, True), ("a", "pt", "current", False, True), ("b", "en", "stale", True, True)}
