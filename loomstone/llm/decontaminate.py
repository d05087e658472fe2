"""Benchmark decontamination: MinHash containment search, verified exactly.

Native: SQL functions only. The test items are partitioned by the number of
their shingles, in powers of two; the partition fixes how many of an item's
smallest shingle hashes make its sketch. With the share ``c`` asked for, the
sketch has more hashes than an item may miss, so a document that contains the
item holds one of them at least: the search loses nothing. Each document probes
its own shingles against the sketches in one map-side pass, and what it finds
is verified on the shingles themselves.

Defined results: a null or empty text has no shingles and matches nothing; an
item of fewer than five words is one shingle, and matches documents that
consist of just these words; equal items each match; items with a null id match
under that; repeated document rows give one row of pairs; documents with a null
id are removed by their own texts; other columns are ignored, or kept where
documents are returned; empty tables give empty results; a very long text costs
in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.batches import fresh
from loomstone.llm.text import SHINGLE, ascii_lower, marked, shingles, words
from loomstone.session import load

CONTAINED = 0.75
#: Items with this many shingles in all are broadcast at most (about 64 MB);
#: larger sets of items are joined by shuffles, behind a filter by hashed bits.
BROADCAST_SHINGLES = 500_000


def _words(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))))


def _hashes(text: Column) -> Column:
    return shingles(_words(text), lambda w: F.xxhash64(w), distinct=False)


def _strings(text: Column) -> Column:
    return shingles(_words(text), lambda w: F.array_join(w, " "))


def item_sketches(items: DataFrame, share: float = CONTAINED) -> DataFrame:
    """Per item: all shingles, their hashes and the sketch of its size partition."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size("item_hashes"), F.lit(1)).cast("double"))))
    needed = (F.floor(upper * (1 - share)) + 1).cast("int")
    return (
        # Ids may be null or repeated: an item is told by its id and text together.
        items.select(F.col("item_id"), F.sha2(F.concat_ws(" ", F.col("item_id").cast("string"), "text"), 256).alias("item"), _strings(F.col("text")).alias("item_shingles"))
        .withColumn("item_hashes", F.transform("item_shingles", lambda s: F.xxhash64(F.split(s, " "))))
        .filter(F.size("item_hashes") > 0)
        .withColumn("size_part", F.log2(upper).cast("int"))
        .withColumn("sketch", F.slice(F.sort_array(F.array_distinct("item_hashes")), F.lit(1), needed))
    )


def contaminated_pairs(docs: DataFrame, items: DataFrame, share: float = CONTAINED) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_item): documents with ``share`` of an item's shingles."""
    sketches = item_sketches(items, share)
    size = sketches.agg(F.sum(F.size("item_hashes"))).first()[0] or 0
    keys = sketches.select("item", F.explode("sketch").alias("key"))
    probes = docs.select("doc_id", "text", _hashes(F.col("text")).alias("hashes"))
    if size <= BROADCAST_SHINGLES:
        found = (
            # explode_outer: for explode, Spark would compute the hashes twice, to filter on their number.
            probes.select("*", F.explode_outer("hashes").alias("key"))
            .join(F.broadcast(keys), "key")
            .join(F.broadcast(sketches), "item")
            # Of the sketch hashes that a document holds, the smallest speaks for the pair.
            .filter(F.col("key") == F.array_min(F.array_intersect("hashes", "sketch")))
        )
    else:
        own = docs.select("doc_id", F.explode_outer(_hashes(F.col("text"))).alias("key"))
        pairs = marked(own, keys, "key").join(keys, "key").select("doc_id", "item").distinct()
        found = pairs.join(probes, "doc_id").join(sketches, "item")
    least = F.ceil(F.size("item_shingles") * F.lit(share)).cast("int")
    likely = found.filter(F.size(F.array_intersect("hashes", "item_hashes")) >= least)
    shared = F.size(F.array_intersect(_strings(F.col("text")), F.col("item_shingles")))
    return (
        likely.select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.size("item_shingles").cast("long").alias("n_item"), least.alias("least"))
        .filter("n_shared >= least")
        .drop("least")
        .distinct()
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, share: float = CONTAINED) -> DataFrame:
    """``docs`` without those that contain an item; columns as before."""
    key = fresh(docs.columns, "_key")
    # A row without an id goes by its text.
    own = docs.withColumn(key, F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")), 256))))
    found = contaminated_pairs(own.select(F.col(key).alias("doc_id"), "text"), items, share).select(F.col("doc_id").alias(key)).distinct()
    return own.join(found, key, "left_anti").select(*docs.columns)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contaminated pairs of all documents and all benchmark items."""
    return contaminated_pairs(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_SHINGLES_SQL = f"""
    SELECT id, unnest(CASE WHEN len(w) >= {SHINGLE}
        THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {{src}})
"""
ORACLE = f"""
WITH d AS (SELECT DISTINCT * FROM ({_SHINGLES_SQL.format(src="(SELECT doc_id AS id, text FROM documents)")})),
     b AS (SELECT DISTINCT * FROM ({_SHINGLES_SQL.format(src="(SELECT item_id AS id, text FROM benchmark)")})),
     n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id),
     m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT m.doc_id, m.item_id, CAST(m.n_shared AS BIGINT) AS n_shared, CAST(n.n_item AS BIGINT) AS n_item
FROM m JOIN n ON n.id = m.item_id WHERE m.n_shared >= 0.75 * n.n_item
"""
