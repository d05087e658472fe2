"""Queries over a written index of chunks, with SQL that ranks the chunks from the texts themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import index, search
from loomstone.plans.base import query, words_sql
from loomstone.session import Scratch, load
from loomstone.sources.sinks import write_index

_SQUEEZE = "trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
_CHUNKS = f"""
WITH s AS (SELECT doc_id, string_split(regexp_replace({_SQUEEZE}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents),
     e AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM s),
     r AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY doc_id ORDER BY i) = x THEN 0 ELSE 1 END AS fresh FROM e),
     g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
     k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM g),
     t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) FILTER (k <= 3) AS text FROM k GROUP BY doc_id),
     o AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1500 THEN 1 ELSE CAST(ceil((length(text) - 1500) / 1100.0) * 1100 + 1 AS BIGINT) END, 1100)) AS "offset" FROM t),
     b AS (SELECT doc_id, "offset", substr(text, "offset" + 1, 1500) AS text FROM o WHERE trim(substr(text, "offset" + 1, 1500)) <> ''),
     w AS (SELECT *, {words_sql('text')} AS w FROM b),
     d AS (SELECT doc_id, lang, CASE quality WHEN 1 THEN 'reviewed' WHEN 0 THEN 'rejected' END AS review FROM documents LEFT JOIN labels USING (doc_id))"""


def _ranked(wanted: list[str], where: str, most: int) -> str:
    """SQL for the chunks with any of the phrases; a trailing ``*`` begins a word."""
    double = "' ' || array_to_string(w, '  ') || ' '"

    def count(p: str) -> str:
        body = "  ".join(p.rstrip("*").split())
        return f"len(regexp_extract_all({double}, ' {body}{'[^ ]*' if p.endswith('*') else ''} '))"

    tf = ", ".join(f"{count(p)} AS t{i}" for i, p in enumerate(wanted))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(wanted)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(wanted)))
    return f"""{_CHUNKS}, c AS (SELECT *, len(w) AS l, {tf} FROM w), z AS (SELECT count(*) AS n, avg(l) AS a, {df} FROM c)
SELECT doc_id, CAST("offset" AS BIGINT) AS "offset", lang, review, round({score}, 9) AS score FROM c JOIN d USING (doc_id), z WHERE {where} ORDER BY {score} DESC, doc_id, "offset" LIMIT {most}"""


def texts(spark, sf):
    """The texts of the documents, and a title: the first four words."""
    return load(spark, sf, "documents").select("doc_id", "text", F.substring_index("text", " ", 4).alias("name"))


def documents(spark, sf):
    """The documents with their language and review."""
    review = F.when(F.col("quality") == 1, F.lit("reviewed")).when(F.col("quality") == 0, F.lit("rejected"))
    return load(spark, sf, "documents").select("doc_id", "text", "lang").join(load(spark, sf, "labels").select("doc_id", review.alias("review")), "doc_id", "left")


def build(spark, sf, title: bool = False) -> str:
    """Write the index of the documents into the shared folder, and give its path; a title is a text's first four words."""
    docs = documents(spark, sf)
    path = Scratch(spark, "index").root
    if title:
        write_index(docs.withColumn("name", F.substring_index("text", " ", 4)), path, "lang", "name", texts(spark, sf))
    else:
        write_index(docs, path, "lang", texts=texts(spark, sf))
    return path


def _shown(hits):
    return hits.select("doc_id", F.col("offset").cast("long").alias("offset"), "lang", "review", F.round("score", 9).alias("score"))


@query("f05_chunk_search", _ranked(["the that", "thnt", "ea*"], "(t0 > 0 OR t1 > 0 OR t2 > 0)", 50))
def f05c(spark, sf):
    return _shown(index.search_index(spark, build(spark, sf), '"the that" OR thnt OR ea*', "lang", most=50))


@query("f05_block_topk", _ranked(["the that", "thnt", "ea*"], "(t0 > 0 OR t1 > 0 OR t2 > 0)", 50))
def f05b(spark, sf):
    return _shown(index.top_hits(spark, build(spark, sf), '"the that" OR thnt OR ea*', "lang", most=50)[0])


@query("p12_filtered_search", _ranked(["that"], "t0 > 0 AND lang = 'en' AND review = 'reviewed'", 25))
def p12(spark, sf):
    return _shown(index.search_index(spark, build(spark, sf), "that", "lang", only="en", review="reviewed", most=25))


@query(
    "j01_hits_documents",
    f"{_CHUNKS} SELECT doc_id, lang, review, count(*) AS chunks FROM w JOIN d USING (doc_id) WHERE list_contains(w, 'the') AND NOT list_contains(w, 'that') GROUP BY ALL",
)
def j01(spark, sf):
    found = index.hits(spark, build(spark, sf), "the NOT that", "lang")
    return found.groupBy("doc_id", "lang", "review").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "j02_files_manifest",
    """SELECT 'f' || d.doc_id || '.txt' AS name, CASE WHEN d.doc_id % 3 = 0 THEN CAST(d.doc_id AS VARCHAR) ELSE 'f' || d.doc_id END AS doc_id,
              CASE WHEN d.doc_id % 3 < 2 THEN d.source END AS title, CASE WHEN d.doc_id % 3 = 0 THEN round(n_chars / 2000.0, 9) END AS coverage
       FROM documents d""",
)
def j02(spark, sf):
    docs = load(spark, sf, "documents").withColumn("name", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")))
    # Entries with an id, with an empty one, and files without an entry.
    entry = docs.filter("doc_id % 3 < 2").select(F.col("name").alias("file"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise(F.lit("")).alias("id"), F.col("source").alias("title"))
    coverage = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.round(F.col("n_chars") / 2000.0, 9).alias("coverage"))
    return index.catalogue_files(docs.select("name"), entry, coverage).select("name", "doc_id", "title", "coverage")


def _places(words: list[str]) -> str:
    """SQL for the places, from 0, at which words stand in a row in ``w``; a trailing ``*`` begins a word."""
    test = " AND ".join(f"starts_with(w[i + {k + 1}], '{x[:-1]}')" if x.endswith("*") else f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(words))
    return f"list_filter(range(len(w)), lambda i: coalesce({test}, false))"


def _near_sql(phrases: list[str], distance: int) -> str:
    """SQL for whether one stretch of ``w`` holds each phrase: from some start of a phrase back, each begins no more than its words and the distance before."""
    lists = [_places(p.split()) for p in phrases]
    fits = " AND ".join(f"len(list_filter({x}, lambda p: p <= m AND m - p <= {len(p.split()) + distance})) > 0" for p, x in zip(phrases, lists, strict=True))
    return f"len(list_filter(list_concat({', '.join(lists[:2])}, {lists[2]}), lambda m: {fits})) > 0"


@query("f04_near", f'{_CHUNKS} SELECT doc_id, CAST("offset" AS BIGINT) AS "offset" FROM w WHERE {_near_sql(["of the", "and", "ea*"], 8)}')
def f04_near(spark, sf):
    # Written in another order than that in which the phrases stand.
    found = index.hits(spark, build(spark, sf), 'NEAR(ea* "of the" and, 8)', "lang")
    return found.select("doc_id", F.col("offset").cast("long").alias("offset"))


@query(
    "f04_columns",
    f"""{_CHUNKS}, n AS (SELECT doc_id, {words_sql("array_to_string(string_split(coalesce(text, ''), ' ')[:4], ' ')")} AS t FROM documents)
SELECT doc_id, CAST("offset" AS BIGINT) AS "offset" FROM w JOIN n USING (doc_id) WHERE (list_contains(t, 'the') OR list_contains(t, 'la')) AND NOT list_contains(w, 'that')""",
)
def f04_columns(spark, sf):
    found = index.hits(spark, build(spark, sf, title=True), "title : (the OR la) NOT -title : that", "lang")
    return found.select("doc_id", F.col("offset").cast("long").alias("offset"))


_BEST = ["the that", "of"]
_HITS = ", ".join(f"list_transform({_places(p.split())}, lambda i: {{'at': i, 'phrase': {k}, 'size': {len(p.split())}}})" for k, p in enumerate(_BEST))


@query(
    "f06_best_snippet",
    f"""{_CHUNKS}, xx AS (SELECT doc_id, "offset", w, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '') AS s, list_sort(list_concat({_HITS})) AS h FROM w),
     y AS (SELECT *, list_transform(h, lambda a: {{'d': len(list_distinct(list_transform(list_filter(h, lambda o: o.at >= a.at AND o.at < a.at + 18), lambda o: o.phrase))), 'n': len(list_filter(h, lambda o: o.at >= a.at AND o.at < a.at + 18)),
                             'f': -a.at, 'l': list_max(list_transform(list_filter(h, lambda o: o.at >= a.at AND o.at < a.at + 18), lambda o: o.at + o.size))}}) AS r FROM xx WHERE len(h) > 0),
     zz AS (SELECT *, list_max(r) AS best FROM y),
     st AS (SELECT *, greatest(least(-best.f - CAST(floor((18 - (best.l + best.f)) / 2.0) AS BIGINT), len(s) - 18), 0) AS b FROM zz)
SELECT doc_id, CAST("offset" AS BIGINT) AS "offset", concat_ws(' ', CASE WHEN b > 0 THEN '…' END, array_to_string(list_transform(range(b, least(b + 18, len(s))), lambda i:
    concat(CASE WHEN len(list_filter(h, lambda o: o.at = i)) > 0 AND len(list_filter(h, lambda o: o.at < i AND i < o.at + o.size)) = 0 THEN '[' ELSE '' END, s[i + 1],
           CASE WHEN len(list_filter(h, lambda o: o.at + o.size - 1 = i)) > 0 AND len(list_filter(h, lambda o: o.at <= i AND i + 1 < o.at + o.size)) = 0 THEN ']' ELSE '' END)), ' '), CASE WHEN b + 18 < len(s) THEN '…' END) AS snippet FROM st""",
)
def f06_best(spark, sf):
    path = build(spark, sf)
    tree = search.parse(f'"{_BEST[0]}" OR {_BEST[1]}')
    chunks = spark.read.parquet(f"{path}/chunks").join(index.hits(spark, path, tree, "lang").select("doc_id", "offset"), ["doc_id", "offset"])
    return chunks.select("doc_id", F.col("offset").cast("long").alias("offset"), search.best_snippet(F.col("body"), search.phrases(tree)).alias("snippet"))
