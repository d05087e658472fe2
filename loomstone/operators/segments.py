"""A search index kept up to date: segments that are added, rows of older ones that are struck out, merges of segments of like size.

Each change writes a segment of its own (docs, chunks, postings, blocks), a
table of the chunks that it strikes out of older segments, and a version: the
list of live segments with their live chunks and words, which add up to the
statistics of the whole index, so that these need no scan. A version counts
once Spark has marked its write as complete; until then, and if a write fails,
readers see the version before. One writer works on an index at a time.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.index import Index
from loomstone.sources.files import delete, exists, names
from loomstone.sources.sinks import guard, index_tasks, write_chunks, write_index

#: Segments of one size class that are merged into one; a class reaches to so many times its least number of chunks.
FANOUT = 4
#: A segment's entry in a version. ``struck`` are chunks of it that are dead. The entry without a segment has the last batch of a stream.
ENTRY = "segment long, chunks long, words long, struck long, batch long"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, in order."""
    return sorted(int(n[2:]) for n in names(spark, f"{path}/versions") if n.startswith("v=") and exists(spark, f"{path}/versions/{n}/_SUCCESS"))


def entries(spark: SparkSession, path: str, version: int | None = None) -> list:
    """The live segments of a version, the last one if none is named; a row each."""
    found = versions(spark, path)
    if version is None and not found:
        return []
    return [e for e in _rows_of(spark, path, found[-1] if version is None else version) if e["segment"] is not None]


def _rows_of(spark: SparkSession, path: str, version: int) -> list:
    return spark.read.schema(ENTRY).parquet(f"{path}/versions/v={version}").orderBy("segment").collect()


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The last batch of a stream that the index has."""
    found = versions(spark, path)
    return max((e["batch"] for e in _rows_of(spark, path, found[-1]) if e["batch"] is not None), default=None) if found else None


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _table(spark: SparkSession, path: str, live: list, name: str) -> DataFrame:
    """A table of all live segments, with their numbers, struck rows too."""
    return _union([spark.read.parquet(f"{path}/segments/{e['segment']}/{name}").withColumn("segment", F.lit(e["segment"])) for e in live])


def _struck(spark: SparkSession, path: str, live: list) -> DataFrame | None:
    """(segment, doc_id, chunk) of the dead chunks of live segments; null chunks are documents without any."""
    if not any(e["struck"] for e in live):
        return None
    kept = {e["segment"] for e in live}
    tables = [n for n in names(spark, f"{path}/struck") if any(s < int(n) for s in kept)]
    rows = _union([spark.read.parquet(f"{path}/struck/{n}") for n in tables])
    return rows.filter(F.col("segment").isin(sorted(kept))).distinct()


def opened(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The index as of a version, for :func:`loomstone.operators.index.hits` and the other searches."""
    live = entries(spark, path, version)
    if not live:
        raise ValueError(f"{path} has no index")
    docs, chunks, postings, blocks = (_table(spark, path, live, t) for t in ("docs", "chunks", "postings", "blocks"))
    dead = _struck(spark, path, live)
    if dead is not None:
        docs = docs.join(dead.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_anti")
        gone = dead.filter("chunk is not null").select("segment", "chunk")
        chunks, postings = (t.join(gone, ["segment", "chunk"], "left_anti") for t in (chunks, postings))
    # Blocks of different segments are different blocks.
    apart = lambda t: t.withColumn("block", F.concat_ws("-", "segment", "block")).drop("segment")
    total = [sum(e["chunks"] for e in live), sum(e["words"] for e in live)]
    size = spark.createDataFrame([(total[0], total[1] / total[0] if total[0] else None)], "_n long, _avg double")
    return Index(docs.drop("segment"), apart(chunks), apart(postings), apart(blocks), size, dead is None)


def _commit(spark: SparkSession, path: str, version: int, live: list[tuple], batch: int | None = None) -> None:
    note = (None, 0, 0, 0, last_batch(spark, path) if batch is None else batch)
    spark.createDataFrame([*live, note], ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={version}")


def _next(spark: SparkSession, path: str) -> int:
    """A number that no version, segment or table of struck chunks has, not even one of a failed write."""
    used = [int(n.removeprefix("v=")) for part in ("versions", "segments", "struck") for n in names(spark, f"{path}/{part}") if n.removeprefix("v=").isdigit()]
    return max(used, default=0) + 1


def apply(changes: DataFrame, path: str, collection: str = "collection", title: str | None = None, batch: int | None = None, texts: DataFrame | None = None) -> int:
    """Add, replace and remove documents, and give the version that has them.

    ``changes`` has a row a document: ``doc_id``, its columns, and if it has a
    column ``deleted``, true for those to go; ``texts``, of those that stay, are
    as for :func:`write_index`. Statistics of what is struck out
    come from the older segments' chunks, without their texts.
    """
    guard(path)
    spark = changes.sparkSession
    live = entries(spark, path)
    number = _next(spark, path)
    fresh = changes.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in changes.columns else changes
    new = []
    if not fresh.isEmpty():
        write_index(fresh, f"{path}/segments/{number}", collection, title, texts)
        chunks, words = spark.read.parquet(f"{path}/segments/{number}/chunks").agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
        new = [(number, chunks, words, 0, batch)]
    lost: dict[int, list[int]] = {}
    if live:
        ids = changes.select("doc_id").distinct()
        held = _rows(spark, path, live).join(ids, "doc_id", "left_semi")
        held.write.mode("overwrite").parquet(f"{path}/struck/{number}")
        rows = spark.read.parquet(f"{path}/struck/{number}").groupBy("segment").agg(F.count("chunk").alias("chunks"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("rows"))
        lost = {r["segment"]: [r["chunks"], r["words"], r["rows"]] for r in rows.collect()}  # a row a segment
    kept = []
    for e in live:
        chunks, words, rows = lost.get(e["segment"], [0, 0, 0])
        kept.append((e["segment"], e["chunks"] - chunks, e["words"] - words, e["struck"] + rows, e["batch"]))
    _commit(spark, path, number, [*kept, *new], batch)
    return number


def _rows(spark: SparkSession, path: str, live: list) -> DataFrame:
    """(segment, doc_id, chunk, words) of the live chunks, and of live documents without chunks."""
    docs, chunks = (_table(spark, path, live, t) for t in ("docs", "chunks"))
    rows = docs.select("segment", "doc_id").join(chunks.select("segment", "doc_id", "chunk", "words"), ["segment", "doc_id"], "left")
    dead = _struck(spark, path, live)
    return rows if dead is None else rows.join(dead.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_anti")


def merge(spark: SparkSession, path: str, collection: str = "collection", fanout: int = FANOUT) -> int | None:
    """Merge the segments of the lowest size class that has ``fanout`` of them, and give the version; None if no class has.

    Struck rows are left behind. Chunks are copied, and their postings written
    anew, as that shuffles less than to sort the old ones out.
    """
    live = entries(spark, path)
    tiers: dict[int, list] = {}
    for e in live:
        tiers.setdefault(int(math.log(max(e["chunks"], 1), fanout)), []).append(e)
    full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fanout), None)
    if full is None:
        return None
    number = _next(spark, path)
    target = f"{path}/segments/{number}"
    part = _opened_parts(spark, path, full)
    part["docs"].write.mode("overwrite").partitionBy(collection).parquet(f"{target}/docs")
    chars = part["chunks"].agg(F.sum(F.length("body"))).first()[0] or 0
    ordered = part["chunks"].drop("block").repartition(index_tasks(chars), "doc_id").sortWithinPartitions("doc_id", "offset")
    write_chunks(ordered, chars, target)
    gone = {e["segment"] for e in full}
    entry = (number, sum(e["chunks"] for e in full), sum(e["words"] for e in full), 0, None)
    _commit(spark, path, number, [*[tuple(e) for e in live if e["segment"] not in gone], entry])
    return number


def _opened_parts(spark: SparkSession, path: str, some: list) -> dict[str, DataFrame]:
    """The live rows of some segments."""
    dead = _struck(spark, path, some)
    out = {t: _table(spark, path, some, t) for t in ("docs", "chunks")}
    if dead is not None:
        out["docs"] = out["docs"].join(dead.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_anti")
        gone = dead.filter("chunk is not null").select("segment", "chunk")
        out["chunks"] = out["chunks"].join(gone, ["segment", "chunk"], "left_anti")
    return {t: rows.drop("segment") for t, rows in out.items()}


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the last ``keep`` versions, and what none of these names: segments, struck chunks, leavings of failed writes."""
    found = versions(spark, path)
    last = found[-keep:]
    kept = {e["segment"] for v in last for e in entries(spark, path, v)}
    least = min(kept, default=0)
    for part, stays in (("versions", lambda n: int(n[2:]) in last), ("segments", lambda n: int(n) in kept), ("struck", lambda n: int(n) in found and int(n) > least)):
        for n in names(spark, f"{path}/{part}"):
            if n.removeprefix("v=").isdigit() and not stays(n):
                delete(spark, f"{path}/{part}/{n}")


def follow(changes: DataFrame, path: str, collection: str = "collection", title: str | None = None, merging: bool = True):
    """A stream's writer of an index: each batch becomes a segment, once, even if Spark gives it again.

    ``changes`` is a streaming table as for :func:`apply`; of several rows of a
    document in one batch the one with the greatest ``version`` stays. Returns
    the writer, to be given a checkpoint folder and started.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = last_batch(spark, path)
        if done is not None and done >= number:
            return
        columns = [c for c in batch.columns if c != "doc_id"]
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "version").alias("r")).select("doc_id", "r.*").drop("version")
        apply(last, path, collection, title, number)
        while merging and merge(spark, path, collection) is not None:
            pass

    return changes.writeStream.foreachBatch(write)
