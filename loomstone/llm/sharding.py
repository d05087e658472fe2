"""Sharding by sampled splitters: near-equal bytes per shard.

Records are ordered by (text hash, id), so equal texts are neighbours. A
size-weighted sample of keys gives quantile boundaries; records go to the
ranges between them, ranges that came out overfull are subdivided, and the
exact bytes per range fix where each shard begins. A hot text cannot overfill
a range: its records differ in id, and boundaries fall inside it; a range that
is overfull all the same, by rows alike in text and id, is divided by a number
of each row, into parts of about the bytes of a range.

Defined results: a null text counts as no bytes and hashes like an empty one;
null ids sort first; repeated rows each keep a place of their own; an empty
table gives an empty result; a very long text is a row like others, of which
only size, checksum and hash go on; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loomstone.session import Scratch

#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: A range aims at so many bytes, so that one task sorts it in memory.
RANGE_BYTES = 32 << 20
#: Bounds of the number of ranges; the upper one bounds what the driver holds.
LEAST_RANGES, MOST_RANGES = 192, 16_384
#: Sampled keys expected for each range.
SAMPLES = 32


def _ordered_bytes(h: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """16-byte strings that sort as the pairs (h, ident) of signed integers do."""
    low = np.int64(np.iinfo(np.int64).min)
    pair = np.stack([(h ^ low).view(np.uint64), (ident ^ low).view(np.uint64)], axis=1)
    return np.ascontiguousarray(pair.astype(">u8")).view("S16").ravel()


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, size, text_crc32, shard and slot for every row of ``df``."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(int(np.iinfo(np.int64).min)))
    scratch = Scratch(spark, "shards")
    keyed = scratch.write(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            ident.alias("k"),
            # Written with the rows, so that it stays: rows alike in all else can go to different parts.
            F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        ),
        "keyed",
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(LEAST_RANGES, -(-total // RANGE_BYTES))))

    # Threshold sampling: a key enters with a chance in proportion to its size, and once however many rows bear it.
    chance = F.col("size") * (float(SAMPLES * ranges) / max(total, 1))
    uniform = F.pmod(F.xxhash64(F.lit("splitter"), "h", "k"), F.lit(1 << 40)) / float(1 << 40)
    drawn = keyed.filter(uniform < chance).select("h", "k").distinct().collect()
    keys = np.sort(_ordered_bytes(np.array([r[0] for r in drawn], np.int64), np.array([r[1] for r in drawn], np.int64)))
    splitters = keys[np.linspace(0, len(keys), ranges + 1).astype(int)[1:-1]] if len(keys) else keys

    @F.pandas_udf(IntegerType())
    def range_of(h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, _ordered_bytes(h.to_numpy(np.int64), k.to_numpy(np.int64)), "right").astype(np.int32))

    ranged = keyed.withColumn("range", range_of("h", "k"))
    most = max(total // ranges, 1)
    heavy = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 2 * most).collect()
    # At most as many rows as there are ranges; their parts add up to no more than the ranges.
    plan = spark.createDataFrame([(r["range"], -(-r["bytes"] // most)) for r in heavy], "range int, parts long")
    part = F.coalesce(F.pmod(F.xxhash64(F.lit("part"), "k", "h", "salt"), F.col("parts")), F.lit(0)).cast("int")
    dealt = ranged.join(F.broadcast(plan), "range", "left").withColumn("part", part).drop("parts")
    counts = dealt.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    rows, at_byte, at_row = [], 0, 0
    for r in sorted(counts, key=lambda r: (r["range"], r["part"])):
        rows.append((r["range"], r["part"], at_byte, at_row))
        at_byte, at_row = at_byte + r["bytes"], at_row + r["rows"]
    # Two rows a range at most, whatever the input.
    offsets = spark.createDataFrame(rows, "range int, part int, at_byte long, at_row long")

    order = Window.partitionBy("range", "part").orderBy("h", "k", "salt")
    middle = F.col("at_byte") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("size") / 2).cast("long")
    placed = scratch.write(
        dealt.join(F.broadcast(offsets), ["range", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.floor(middle * F.lit(shards) / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("at_row") + F.row_number().over(order) - 1).alias("row"),
        ),
        "placed",
    )
    scratch.drop("keyed")
    firsts = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("row")).collect()}
    first = F.element_at(F.array(*[F.lit(firsts.get(s, 0)) for s in range(shards)]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - first).cast("long").alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into shards 0 to 23 under the law ``bytes``."""
    from loomstone.session import load

    out = shard_by_bytes(load(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
