"""Queries over text: keys, titles, digests, chunks, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import fold, web
from loomstone.operators import search, textflow
from loomstone.plans.base import query, words_sql
from loomstone.session import load

_FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"


def _docs(spark, sf):
    return load(spark, sf, "documents")


@query("x01_deaccent", "SELECT doc_id, sha256(strip_accents(text)) AS digest FROM documents")
def x01(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(fold.deaccent(F.col("text")), 256).alias("digest"))


@query("x02_fold_key", f"SELECT doc_id, sha256({_FOLD.format('text')}) AS digest FROM documents")
def x02(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(fold.fold_key(F.col("text")), 256).alias("digest"))


@query("x03_initials_key", f"SELECT p_partkey, array_to_string(list_filter(string_split({_FOLD.format('p_name')}, ' '), lambda x: length(x) > 1), ' ') AS k FROM part")
def x03(spark, sf):
    return load(spark, sf, "part").select("p_partkey", fold.initials_key(F.col("p_name")).alias("k"))


_HON = ", ".join(f"'{h}'" for h in fold.HONORIFICS)


@query("x04_normal_name", f"SELECT s_suppkey, array_to_string(list_filter(string_split({_FOLD.format('s_name')}, ' '), lambda x: x <> '' AND x NOT IN ({_HON})), ' ') AS k FROM supplier")
def x04(spark, sf):
    return load(spark, sf, "supplier").select("s_suppkey", fold.normal_name(F.col("s_name")).alias("k"))


def _phonetic_sql(w: str) -> str:
    for pattern, to in fold.PHONETIC:
        if pattern == r"(.)\1+":
            for c in "abcdefghijklmnopqrstuvwxyz":
                w = f"regexp_replace({w}, '{c}{c}+', '{c}', 'g')"
        elif pattern == "b(?=[vw])":
            w = f"regexp_replace({w}, 'b([vw])', '\\1', 'g')"
        else:
            w = f"regexp_replace({w}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return w


_SKIP = ", ".join(f"'{h}'" for h in [*fold.TITLES, *fold.CONNECTORS])


@query(
    "x05_name_key",
    f"""
WITH w AS (SELECT p_partkey, i, trim(string_split(replace(lower(strip_accents(p_name)), '-', ' '), ' ')[i], '.,;:''’"') AS w
           FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(replace(lower(p_name), '-', ' '), ' ')) + 1)) AS i FROM part)),
     r AS (SELECT p_partkey, i, {_phonetic_sql('w')} AS k FROM w WHERE w <> '' AND w NOT IN ({_SKIP}))
SELECT p.p_partkey, coalesce(string_agg(k, ' ' ORDER BY i) FILTER (k <> ''), '') AS k FROM part p LEFT JOIN r USING (p_partkey) GROUP BY 1""",
)
def x05(spark, sf):
    return load(spark, sf, "part").select("p_partkey", fold.name_key(F.col("p_name")).alias("k"))


_TITLE_RAW = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


def _decoded(x: str) -> str:
    for a, b in web.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


_TITLE = f"trim(regexp_replace({_decoded(_TITLE_RAW)}, '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in web.STOPWORDS)
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN (" + _STOP + ")))"


@query("x18_extract_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def x18(spark, sf):
    return load(spark, sf, "pages").select("page_id", web.page_title(F.col("html")).alias("title"))


@query("x17_decode", f"SELECT page_id, sha256({_decoded('html')}) AS digest FROM pages")
def x17(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.sha2(web.decode_entities(F.col("html")), 256).alias("digest"))


@query("x14_title_tokens", f"SELECT page_id, array_to_string(list_sort({_TOKENS.format(_TITLE)}), ' ') AS tokens FROM pages")
def x14(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(web.title_tokens(web.page_title(F.col("html")))), " ").alias("tokens"))


@query(
    "x15_title_similarity",
    f"""
WITH t AS (SELECT page_id, {_TOKENS.format(_TITLE)} AS a, {_TOKENS.format('url')} AS b FROM pages)
SELECT page_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 9) END AS similarity FROM t""",
)
def x15(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.round(web.title_similarity(web.page_title(F.col("html")), F.col("url")), 9).alias("similarity"))


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query("x16_html_escape", f"SELECT page_id, sha256({_escaped('html')}) AS digest FROM pages")
def x16(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.sha2(web.escape_html(F.col("html")), 256).alias("digest"))


@query("x22_secure_url", "SELECT page_id, regexp_replace(url, '^http:', 'https:') AS url, regexp_replace(regexp_replace(url, '/+$', ''), '$', '/') AS base FROM pages")
def x22(spark, sf):
    return load(spark, sf, "pages").select("page_id", web.secure_url(F.col("url")).alias("url"), web.site_base(F.col("url")).alias("base"))


@query("x24_digest", "SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest FROM documents")
def x24(spark, sf):
    return _docs(spark, sf).select("doc_id", web.text_digest(F.col("text")).alias("digest"))


@query(
    "x20_markers",
    """
SELECT doc_id, array_to_string(regexp_extract_all('See [[' || lang || '|the ' || source || ']] and [[' || source || ']].', '\\[\\[([^\\]|]+)(\\|([^\\]]*))?\\]\\]', 1), ',') AS ids,
       'See the ' || source || ' and ' || source || '.' AS shown FROM documents""",
)
def x20(spark, sf):
    text = F.concat(F.lit("See [["), "lang", F.lit("|the "), "source", F.lit("]] and [["), "source", F.lit("]]."))
    return _docs(spark, sf).select("doc_id", F.array_join(web.marker_ids(text), ",").alias("ids"), web.strip_markers(text).alias("shown"))


@query("x25_base_language", "SELECT DISTINCT lang, lower(string_split(replace(lang || '_XX', '_', '-'), '-')[1]) AS base FROM documents")
def x25(spark, sf):
    return _docs(spark, sf).select("lang", web.base_language(F.concat("lang", F.lit("_XX"))).alias("base")).distinct()


_SQUEEZE = "trim(regexp_replace(text, '[\\s\\x0B\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"


@query(
    "w03_dedup_runs",
    f"""
WITH s AS (SELECT doc_id, string_split(regexp_replace({_SQUEEZE}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS a FROM documents),
     e AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM s),
     r AS (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY doc_id ORDER BY i) = x THEN 0 ELSE 1 END AS fresh FROM e),
     g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
     n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k FROM g)
SELECT doc_id, sha256(string_agg(x, ' ' ORDER BY i) FILTER (k <= 3)) AS digest FROM n GROUP BY doc_id""",
)
def w03(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(textflow.normalise(F.col("text")), 256).alias("digest"))


@query("f01_normalise", f"SELECT doc_id, sha256({_SQUEEZE}) AS digest, CAST(length({_SQUEEZE}) AS BIGINT) AS chars FROM documents")
def f01(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(textflow.squeeze(F.col("text")), 256).alias("digest"), F.length(textflow.squeeze(F.col("text"))).cast("long").alias("chars"))


@query(
    "w05_chunks",
    """
WITH o AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1500 THEN 1 ELSE CAST(ceil((length(text) - 1500) / 1100.0) * 1100 + 1 AS BIGINT) END, 1100)) AS "offset" FROM documents)
SELECT doc_id, CAST("offset" AS BIGINT) AS "offset", CAST(length(substr(text, "offset" + 1, 1500)) AS BIGINT) AS chars FROM o WHERE trim(substr(text, "offset" + 1, 1500)) <> ''""",
)
def w05(spark, sf):
    return textflow.chunks(_docs(spark, sf)).select("doc_id", F.col("offset").cast("long").alias("offset"), F.length("body").cast("long").alias("chars"))


@query("f02_tokens", f"SELECT doc_id, CAST(len({words_sql('text')}) AS BIGINT) AS n, sha256(array_to_string({words_sql('text')}, ' ')) AS digest FROM documents")
def f02(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size(textflow.tokens(F.col("text"))).cast("long").alias("n"), F.sha2(F.array_join(textflow.tokens(F.col("text")), " "), 256).alias("digest"))


_PAD = f"' ' || array_to_string({words_sql('text')}, ' ') || ' '"


@query("f03_phrase", f"SELECT doc_id FROM documents WHERE contains({_PAD}, ' of the ')")
def f03(spark, sf):
    phrase = search.Phrase(("of", "the"))
    return _docs(spark, sf).filter(search.phrase_positions(F.col("text"), phrase) > 0).select("doc_id")


@query("f04_boolean", f"SELECT doc_id FROM documents WHERE (contains({_PAD}, ' the that ') OR contains({_PAD}, ' de la ')) AND NOT regexp_matches({_PAD}, ' ea[^ ]* ')")
def f04(spark, sf):
    tree = search.parse('("the that" OR "de la") NOT ea*')
    found = {p: search.phrase_positions(F.col("text"), p) for p in search.phrases(tree)}
    return _docs(spark, sf).filter(search.matches(tree, found)).select("doc_id")


def bm25_sql(columns: str, phrases: list[str], most: int) -> str:
    """SQL for the BM25 of an OR of phrases."""
    double = "' ' || array_to_string(w, '  ') || ' '"
    count = lambda p: f"len(regexp_extract_all({double}, ' {'  '.join(p.split())} '))"
    tf = ", ".join(f"{count(p)} AS t{i}" for i, p in enumerate(phrases))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(len(phrases)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * l / a))" for i in range(len(phrases)))
    hit = " OR ".join(f"t{i} > 0" for i in range(len(phrases)))
    return f"""
WITH b AS (SELECT *, {words_sql('text')} AS w FROM documents), c AS (SELECT *, len(w) AS l, {tf} FROM b), s AS (SELECT count(*) AS n, avg(l) AS a, {df} FROM c)
SELECT {columns}, round({score}, 9) AS score FROM c, s WHERE {hit} ORDER BY score DESC, doc_id LIMIT {most}"""


def _top(spark, sf, text, most):
    hits = search.bm25(_docs(spark, sf).select("doc_id", "text"), text)
    return hits.select("doc_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)


@query("f05_bm25_topk", bm25_sql("doc_id", ["the that", "thnt"], 10))
def f05(spark, sf):
    return _top(spark, sf, '"the that" OR thnt', 10)


@query("o01_topk_stable", bm25_sql("doc_id", ["that"], 25))
def o01(spark, sf):
    return _top(spark, sf, "that", 25)


_SHOWN = "list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}\\p{Co}]+'), lambda x: x <> '')"


@query(
    "f06_snippet",
    f"""WITH w AS (SELECT doc_id, {_SHOWN} AS s, {words_sql('text')} AS f FROM documents),
             p AS (SELECT doc_id, s, f, list_position(f, 'that') AS pos FROM w WHERE list_contains(f, 'that')),
             q AS (SELECT *, greatest(pos - 9, 1) AS b FROM p)
        SELECT doc_id, concat_ws(' ', CASE WHEN b > 1 THEN '…' END,
            array_to_string(list_transform(range(b, least(b + 18, len(s) + 1)), lambda i: CASE WHEN f[i] = 'that' THEN '[' || s[i] || ']' ELSE s[i] END), ' '),
            CASE WHEN b + 18 <= len(s) THEN '…' END) AS snippet FROM q""",
)
def f06(spark, sf):
    hits = search.bm25(_docs(spark, sf).select("doc_id", "text"), "that")
    return hits.select("doc_id", search.snippet(F.col("text"), search.Phrase(("that",))).alias("snippet"))


VARIANTS = [("Thnt", "thant"), ("Thnt", "thint"), ("Maison (vieille)", "mentoi"), ("Maison", "ouai"), ("Ion Ea", "ionea")]
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in VARIANTS)
_KEY = "trim(regexp_replace(lower(strip_accents(CASE WHEN length(regexp_replace(c, '\\s*\\([^)]*\\)\\s*$', '')) > 2 THEN regexp_replace(c, '\\s*\\([^)]*\\)\\s*$', '') ELSE c END)), '[^a-z0-9]+', ' ', 'g'))"


def _variants(spark):
    return search.variant_map(spark.createDataFrame(VARIANTS, "canonical string, variant string"))


@query("f09_variant_map", f"SELECT {_KEY} AS key, min(c) FILTER (NOT contains(c, '(')) AS canonical, array_to_string(list_sort(list(DISTINCT v)), ',') AS variants FROM (VALUES {_VALUES}) t(c, v) GROUP BY 1")
def f09(spark, sf):
    return _variants(spark).select("key", "canonical", F.array_join("variants", ",").alias("variants"))


@query("f07_expand", bm25_sql("doc_id", ["thnt", "thant", "thint"], 1_000_000))
def f07(spark, sf):
    # The map of variants is curated by hand: a few hundred rows.
    found = {r["key"]: r["variants"] for r in _variants(spark).collect()}
    text, _ = search.expand("Thnt", found)
    return search.bm25(_docs(spark, sf).select("doc_id", "text"), text).select("doc_id", F.round("score", 9).alias("score"))


@query("f10_suggest", "SELECT 'ion ea' AS key, 'Ion Ea' AS canonical, 'ionea' AS variants")
def f10(spark, sf):
    return search.suggest("ea", _variants(spark)).select("key", "canonical", F.array_join("variants", ",").alias("variants"))


@query(
    "a01_stats",
    """SELECT lang, coalesce(CASE quality WHEN 1 THEN 'reviewed' WHEN 0 THEN 'rejected' END, '-') AS review, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def a01(spark, sf):
    review = F.when(F.col("quality") == 1, F.lit("reviewed")).when(F.col("quality") == 0, F.lit("rejected")).otherwise(F.lit("-"))
    return _docs(spark, sf).select("doc_id", "lang", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left").groupBy("lang", review.alias("review")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("a02_scope", "SELECT r.lang, count(d.doc_id) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('la')) r(lang) LEFT JOIN documents d USING (lang) GROUP BY 1")
def a02(spark, sf):
    registry = spark.createDataFrame([("en",), ("fr",), ("de",), ("es",), ("la",)], "lang string")
    return search.scope(_docs(spark, sf), registry, "lang")


@query("a29_corpus_statistics", f"SELECT count(*) AS n, round(avg(len({words_sql('text')})), 9) AS avgdl, count(*) FILTER (contains({_PAD}, ' the ')) AS df FROM documents")
def a29(spark, sf):
    return _docs(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size(textflow.tokens(F.col("text")))), 9).alias("avgdl"), F.count_if(search.phrase_positions(F.col("text"), search.Phrase(("the",))) > 0).alias("df"))


@query("p13_incomplete", "SELECT doc_id, lang, round(least(n_chars / 2000.0, 1.0), 9) AS coverage FROM documents WHERE n_chars / 2000.0 < 0.75")
def p13(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang", F.round(F.least(F.col("n_chars") / 2000.0, F.lit(1.0)), 9).alias("coverage")).filter(F.col("coverage") < search.COMPLETE)


@query(
    "f11_trust_stamp",
    """SELECT doc_id, concat_ws(' | ', 'undated', coalesce(CASE quality WHEN 1 THEN 'reviewed' WHEN 0 THEN 'rejected' END, '—'),
              CASE WHEN n_chars / 2000.0 < 0.75 THEN 'INCOMPLETE ' || CAST(floor(n_chars / 2000.0 * 100 + 0.5) AS BIGINT) || '%' END) AS stamp
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def f11(spark, sf):
    review = F.when(F.col("quality") == 1, F.lit("reviewed")).when(F.col("quality") == 0, F.lit("rejected"))
    docs = _docs(spark, sf).select("doc_id", "n_chars").join(load(spark, sf, "labels"), "doc_id", "left")
    return docs.select("doc_id", search.trust_stamp(F.lit(None).cast("date"), F.lit(False), review, F.col("n_chars") / 2000.0).alias("stamp"))


@query(
    "f12_empty_scope",
    f"SELECT count(*) AS searched, count(*) FILTER (contains({_PAD}, ' zzyzx ')) AS hits, count(*) FILTER (n_chars / 2000.0 < 0.75) AS incomplete FROM documents",
)
def f12(spark, sf):
    hit = search.phrase_positions(F.col("text"), search.Phrase(("zzyzx",))) > 0
    return _docs(spark, sf).agg(F.count(F.lit(1)).alias("searched"), F.count_if(hit).alias("hits"), F.count_if(F.col("n_chars") / 2000.0 < search.COMPLETE).alias("incomplete"))


@query(
    "w04_caption_dedup",
    """
WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a FROM documents),
     r AS (SELECT doc_id, a, 0 AS i, CAST(NULL AS VARCHAR) AS last, 0 AS kept FROM l
           UNION ALL SELECT doc_id, a, i + 1, CASE WHEN coalesce(suffix(last, a[i + 1]), false) THEN last ELSE a[i + 1] END, kept + CASE WHEN coalesce(suffix(last, a[i + 1]), false) THEN 0 ELSE 1 END FROM r WHERE i < len(a))
SELECT doc_id, CAST(kept AS BIGINT) AS kept FROM r WHERE i = len(a)""",
)
def w04(spark, sf):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _docs(spark, sf).select("doc_id", F.size(textflow.caption_lines(lines)).cast("long").alias("kept"))


@query("w08_even_sample", "SELECT doc_id, array_to_string(list_transform(range(10), lambda i: CAST(round_even(i * (200 + doc_id % 7 - 1) / 9.0, 0) AS BIGINT)), ',') AS picks FROM documents")
def w08(spark, sf):
    items = F.sequence(F.lit(0), (199 + F.col("doc_id") % 7).cast("int"))
    return _docs(spark, sf).select("doc_id", F.array_join(textflow.even_sample(items, 10), ",").alias("picks"))
