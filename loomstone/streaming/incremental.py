"""Incremental ingestion: an extension beside the batch index, which is rebuilt from nothing.

New transcripts are chunked as they arrive; captured snapshots are upserted by
URL batch by batch, so that a re-run of a batch changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomstone.operators.textflow import chunks, normalise
from loomstone.sources.files import delete, exists, names


def chunk_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Chunks of documents as their Parquet files arrive in ``path``."""
    docs = spark.readStream.schema(schema).parquet(path)
    return chunks(docs.withColumn("text", normalise(F.coalesce("text", F.lit("")))))


def upsert_stream(rows: DataFrame, path: str, key: str, checkpoint: str, order: str, keep: int = 2) -> DataStreamWriter:
    """A writer that keeps the row of each key with the greatest ``order`` in versions ``path/v<batch>``, the last ``keep`` of them.

    A batch reads the last complete version before it. A row that comes late,
    with a smaller ``order`` than the one that is there, changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        others = [c for c in batch.columns if c != key]
        done = sorted(int(n[1:]) for n in names(session, path) if re.fullmatch(r"v\d+", n) and exists(session, f"{path}/{n}/_SUCCESS"))
        before = [n for n in done if n < number]
        both = session.read.parquet(f"{path}/v{before[-1]}").unionByName(batch) if before else batch
        last = both.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")
        last.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")
        for n in before[: max(len(before) + 1 - keep, 0)]:
            delete(session, f"{path}/v{n}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
