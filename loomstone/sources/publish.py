"""Published copies of texts: staged as a version of their own, then made current by one switch of a pointer.

A version is a table of texts and a manifest of their digests. The pointer is
a small file with the version's number; it is written beside the old one and
renamed over it, so that readers see either version whole. A write that fails
before that leaves the old version current.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.consistency import sync_plan
from loomstone.sources.files import names, read_text, rename, write_text
from loomstone.sources.sinks import guard, synced, vendored_manifest

POINTER = "current"
TEXTS, MANIFEST = "name string, text string", "name string, sha256 string, bytes long"


def current(spark: SparkSession, root: str) -> int | None:
    """The number of the current version."""
    found = read_text(spark, f"{root}/{POINTER}")
    return int(found) if found else None


def published(spark: SparkSession, root: str, what: str = "texts") -> DataFrame:
    """The current ``texts`` (name, text) or ``manifest`` (name, sha256, bytes); none before the first version."""
    schema, version = TEXTS if what == "texts" else MANIFEST, current(spark, root)
    return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{root}/v={version}/{what}")


def check(source: DataFrame, root: str) -> DataFrame:
    """(name, action) that a publication of ``source`` (name, text) would take: add, update, stale or ok. Nothing is written, and no published text is read."""
    spark = source.sparkSession
    now = published(spark, root, "manifest").select("name", F.col("sha256").alias("digest"))
    return sync_plan(vendored_manifest(source).select("name", F.col("sha256").alias("digest")), now)


def publish(source: DataFrame, root: str) -> DataFrame:
    """Publish ``source`` (name, text), and give (name, action) of what was done; stale copies go.

    A version is written even if nothing changed, so that a publication always
    stands for a whole set of texts.
    """
    guard(root)
    spark = source.sparkSession
    number = max([int(n[2:]) for n in names(spark, root) if n.startswith("v=") and n[2:].isdigit()], default=0) + 1
    copies, stage = published(spark, root), f"{root}/v={number}"
    synced(source, copies).write.mode("overwrite").parquet(f"{stage}/texts")
    texts = spark.read.parquet(f"{stage}/texts")
    vendored_manifest(texts).repartitionByRange("name").sortWithinPartitions("name").write.mode("overwrite").parquet(f"{stage}/manifest")
    plan = check(source, root)
    # The plan is that against the version before, so it is kept with this one.
    plan.write.mode("overwrite").parquet(f"{stage}/plan")
    write_text(spark, f"{root}/{POINTER}.{number}", str(number))
    rename(spark, f"{root}/{POINTER}.{number}", f"{root}/{POINTER}")
    return spark.read.parquet(f"{stage}/plan")


def vendored_terms(ids: DataFrame) -> DataFrame:
    """(name, text): one file of sorted distinct ids a repository, from (repo, id), as a JSON list."""
    lists = ids.filter("coalesce(id, '') <> ''").groupBy("repo").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return lists.select(F.concat("repo", F.lit("/terms.json")).alias("name"), F.to_json("ids").alias("text"))


def vendored_places(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, text): each repository's part of the gazetteer, from ``places`` (place_id, ...) and ``wanted`` (repo, place_id); JSON, sorted by id."""
    own = wanted.distinct().join(places, "place_id")
    entry = F.struct("place_id", F.struct(*[c for c in places.columns]).alias("e"))
    listed = own.groupBy("repo").agg(F.sort_array(F.collect_list(entry)).alias("x"))
    return listed.select(F.concat("repo", F.lit("/places.json")).alias("name"), F.to_json(F.transform("x", lambda r: r["e"])).alias("text"))
