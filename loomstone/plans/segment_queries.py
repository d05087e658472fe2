"""Queries over an index that was changed after it was written; their SQL searches the documents as they are after all changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import index, segments
from loomstone.plans.base import query
from loomstone.plans.index_queries import _ranked, _shown, documents, texts
from loomstone.session import Scratch


def _changed(spark, sf) -> str:
    """An index in four changes: all documents but a part; that part; every seventh with another text; every eleventh removed."""
    docs, own = documents(spark, sf), texts(spark, sf)
    path = Scratch(spark, "segments").root
    other = lambda rows: rows.filter("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("The that. "), "text"))
    segments.apply(docs.filter("doc_id % 3 > 0").withColumn("deleted", F.lit(False)), path, "lang", texts=own.filter("doc_id % 3 > 0"))
    segments.apply(docs.filter("doc_id % 3 = 0").withColumn("deleted", F.lit(False)), path, "lang", texts=own.filter("doc_id % 3 = 0"))
    segments.apply(other(docs).withColumn("deleted", F.lit(False)), path, "lang", texts=other(own))
    segments.apply(docs.filter("doc_id % 11 = 0").withColumn("deleted", F.lit(True)), path, "lang")
    return path


_SQL = _ranked(["the that", "thnt", "ea*"], "(t0 > 0 OR t1 > 0 OR t2 > 0)", 50)
_AFTER = "WITH documents AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN 'The that. ' || text ELSE text END AS text) FROM main.documents WHERE doc_id % 11 <> 0), " + _SQL.strip().removeprefix("WITH ")


@query("k01_changed_index", _AFTER)
def k01(spark, sf):
    return _shown(index.top_hits(spark, segments.opened(spark, _changed(spark, sf)), '"the that" OR thnt OR ea*', "lang", most=50)[0])


@query("k01_merged_index", _AFTER)
def k01_merged(spark, sf):
    path = _changed(spark, sf)
    segments.merge(spark, path, "lang", fanout=2)
    return _shown(index.search_index(spark, segments.opened(spark, path), '"the that" OR thnt OR ea*', "lang", most=50))
