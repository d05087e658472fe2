"""Queries over reports, cross-references between datasets, manifests, witnesses and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import web
from loomstone.operators import crossref, entities, layout, reports, validate
from loomstone.plans.base import ORACLES, query
from loomstone.plans.data_queries import _CANON, _FOLD, _parts, _postings
from loomstone.session import Scratch, load
from loomstone.sources import publish, readers, sinks


def _pick(column: str, values: list):
    """The value at ``column`` modulo the number of values."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def _pick_sql(column: str, values: list[str]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _json(rows, text):
    return rows.withColumn("v", F.parse_json(text))


# ---- ranked and capped rows ----


@query("o02_ranked_entities", f"{_CANON} SELECT key, docs, variants, row_number() OVER (ORDER BY docs DESC, variants DESC, key) AS place, count(*) OVER () AS total FROM c ORDER BY place LIMIT 20")
def o02(spark, sf):
    return reports.ranked_entities(entities.canonical_table(_postings(spark, sf)), 20).select("key", "docs", "variants", F.col("place").cast("long").alias("place"), "total")


# Descriptions of which a part asserts, a part denies, and a part says nothing.
_SAID = ["a member of it", "never a member of it", "its founder, a member", "a tall man"]
_TERM = _pick_sql("p_partkey", ["'member'", "'!member'", "'founder,member'", "''"])
_ENTRY = f"SELECT DISTINCT p_brand AS repo, {_FOLD.format('p_name')} || ' ' || p_size AS key, {_TERM} AS terms FROM part"
_DIVERGE = f"""
WITH e AS ({_ENTRY}), r AS (SELECT key, count(DISTINCT repo) AS repos FROM e GROUP BY 1 HAVING count(DISTINCT repo) >= 2),
     l AS (SELECT DISTINCT repo, key, unnest(string_split(terms, ',')) AS term FROM e WHERE terms <> ''),
     x AS (SELECT DISTINCT a.key FROM l a JOIN l b ON a.key = b.key AND a.repo <> b.repo AND b.term = '!' || a.term),
     y AS (SELECT DISTINCT a.key FROM e a JOIN e b ON a.key = b.key AND a.repo <> b.repo AND a.terms <> '' AND b.terms <> '' AND a.terms <> b.terms),
     s AS (SELECT key, repos, CASE WHEN key IN (SELECT key FROM x) THEN 'contradiction' WHEN key IN (SELECT key FROM y) THEN 'differs' ELSE 'ok' END AS status FROM r)"""


def _entries(spark, sf):
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    part = load(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("pos"), name.alias("name"), _pick("p_partkey", _SAID).alias("description"))
    nothing = part.filter("false")
    facts = nothing.select("repo", "pos", F.col("name").alias("label"), F.col("description").alias("value"))
    even = part.filter("pos % 2 = 0")
    return [crossref.entries(even, nothing, facts), crossref.entries(nothing, part.filter("pos % 2 = 1"), facts)]


@query("u02_merged_divergence", f"{_DIVERGE} SELECT * FROM s")
def u02(spark, sf):
    return crossref.merged_divergence(_entries(spark, sf)).select("key", F.col("repos").cast("long").alias("repos"), "status")


@query("o03_ranked_divergence", f"{_DIVERGE} SELECT key, repos, status, row_number() OVER (ORDER BY CASE status WHEN 'contradiction' THEN 0 WHEN 'differs' THEN 1 ELSE 2 END, repos DESC, key) AS place, count(*) OVER () AS total FROM s ORDER BY place LIMIT 100")
def o03(spark, sf):
    found = reports.ranked_divergence(crossref.merged_divergence(_entries(spark, sf)), 100)
    return found.select("key", F.col("repos").cast("long").alias("repos"), "status", F.col("place").cast("long").alias("place"), "total")


_NAMED = "p_name || ' Number' || (p_partkey % 97)"
_CLAIMED = _pick_sql("p_partkey", [_NAMED, "p_name || ' J Number' || (p_partkey % 97)", "'Nobody ' || p_partkey"])


@query(
    "o04_ranked_hits",
    f"""WITH t AS (SELECT {_FOLD.format(_NAMED)} AS key, count(*) AS docs FROM part GROUP BY 1), c AS (SELECT p_brand AS repo, {_FOLD.format(_CLAIMED)} AS own FROM part),
    m AS (SELECT t.key, docs, repo, own = t.key AS exact FROM c JOIN t ON t.key = replace(own, ' j ', ' ')),
    h AS (SELECT key, docs, CASE WHEN bool_or(exact) THEN 'high' ELSE 'medium' END AS confidence, array_to_string(list_sort(list(DISTINCT repo)), ',') AS repos, count(*) AS claims FROM m GROUP BY 1, 2)
    SELECT key, docs, confidence, repos, claims, row_number() OVER (ORDER BY confidence, docs DESC, key) AS place, count(*) OVER () AS total FROM h ORDER BY place LIMIT 2000""",
)
def o04(spark, sf):
    part = load(spark, sf, "part")
    number = F.concat(F.lit("Number"), (F.col("p_partkey") % 97).cast("string"))
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.concat_ws(" ", "p_name", number)).when(kind == 1, F.concat_ws(" ", "p_name", F.lit("J"), number)).otherwise(F.concat(F.lit("Nobody "), F.col("p_partkey").cast("string")))
    claims = part.select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("locator"), name.alias("name"))
    found = reports.ranked_hits(claims, _parts(spark, sf), 2000)
    return found.select("key", "docs", "confidence", F.array_join("repos", ",").alias("repos"), "claims", F.col("place").cast("long").alias("place"), "total")


@query(
    "o07_ranked_suggestions",
    f"""WITH j AS ({ORACLES['j07_suggestions']}), n AS (SELECT {_FOLD.format(_NAMED)} AS key, count(*) AS docs, min({_NAMED}) AS display FROM part GROUP BY 1)
    SELECT a, b, kind, x.docs + y.docs AS docs, row_number() OVER (ORDER BY CASE kind WHEN 'edit1' THEN 0 WHEN 'token-subset' THEN 1 ELSE 2 END, x.docs + y.docs DESC, x.display, a, b) AS place, count(*) OVER () AS total
    FROM j JOIN n x ON x.key = a JOIN n y ON y.key = b ORDER BY place LIMIT 200""",
)
def o07(spark, sf):
    return reports.ranked_suggestions(_parts(spark, sf)).select("a", "b", "kind", "docs", F.col("place").cast("long").alias("place"), "total")


_PIN = _pick_sql("n_nationkey", ["upper(n_name)", "lower(n_name)", "'É' || lower(n_name)", "n_name"])


@query("o09_ranked_pins", f"SELECT place_id, name, first_year, row_number() OVER (ORDER BY first_year, name COLLATE en, place_id) AS place FROM (SELECT n_nationkey AS place_id, {_PIN} AS name, CAST(1900 + n_nationkey % 2 AS BIGINT) AS first_year FROM nation)")
def o09(spark, sf):
    kind = F.col("n_nationkey") % 4
    name = F.when(kind == 0, F.upper("n_name")).when(kind == 1, F.lower("n_name")).when(kind == 2, F.concat(F.lit("É"), F.lower("n_name"))).otherwise(F.col("n_name"))
    pins = load(spark, sf, "nation").select(F.col("n_nationkey").alias("place_id"), name.alias("name"), (1900 + F.col("n_nationkey") % 2).cast("long").alias("first_year"))
    return reports.ranked_pins(pins, 100).select("place_id", "name", "first_year", F.col("place").cast("long").alias("place"))


@query("a28_by_collection", "SELECT c_mktsegment, 'events[' || c_custkey || ']' AS locator, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS place FROM customer ORDER BY place LIMIT 300")
def a28(spark, sf):
    rows = load(spark, sf, "customer").select("c_mktsegment", F.format_string("events[%d]", "c_custkey").alias("locator"))
    return reports.by_collection(rows, "c_mktsegment", "locator", 300).select("c_mktsegment", "locator", F.col("place").cast("long").alias("place"))


@query("o13_sorted_ids", f"SELECT n_regionkey, array_to_string(list(name ORDER BY name COLLATE en), ',') AS ids FROM (SELECT DISTINCT n_regionkey, {_PIN} AS name FROM nation) GROUP BY 1")
def o13(spark, sf):
    kind = F.col("n_nationkey") % 4
    name = F.when(kind == 0, F.upper("n_name")).when(kind == 1, F.lower("n_name")).when(kind == 2, F.concat(F.lit("É"), F.lower("n_name"))).otherwise(F.col("n_name"))
    twice = load(spark, sf, "nation").select("n_regionkey", F.explode(F.array(name, name)).alias("id"))
    return twice.groupBy("n_regionkey").agg(F.array_join(reports.sorted_ids(F.col("id")), ",").alias("ids"))


@query(
    "o12_capped_lists",
    "WITH s AS (SELECT c_custkey, string_split(repeat('x,', CAST(c_custkey % 9 AS INTEGER)) || 'y', ',') AS a FROM customer) SELECT c_custkey, array_to_string(list_slice(a, 1, 5), ',') || CASE WHEN len(a) > 5 THEN ',+' || (len(a) - 5) || ' more' ELSE '' END AS text FROM s",
)
def o12(spark, sf):
    items = F.split(F.concat(F.repeat(F.lit("x,"), (F.col("c_custkey") % 9).cast("int")), F.lit("y")), ",")
    return load(spark, sf, "customer").select("c_custkey", reports.capped(items, 5).alias("text"))


@query(
    "p24_dated_lists",
    """WITH o AS (SELECT o_custkey AS key, o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS d FROM orders),
         k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS k, count(*) OVER (PARTITION BY key) AS n FROM o)
    SELECT key, string_agg(id || '(' || coalesce(d, '?') || ')', ',' ORDER BY id) || CASE WHEN max(n) > 4 THEN ',+' || (max(n) - 4) ELSE '' END AS text FROM k WHERE k <= 4 GROUP BY key""",
)
def p24(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    return reports.dated_lists(orders, orders.filter("id % 4 <> 0"), 4)


@query(
    "o11_incomplete_line",
    """WITH i AS (SELECT doc_id, n_chars / 2000.0 AS c FROM documents WHERE n_chars / 2000.0 < 0.75), r AS (SELECT *, row_number() OVER (ORDER BY c, doc_id) AS k, count(*) OVER () AS n FROM i)
    SELECT max(n) AS n, string_agg(doc_id || ' ' || CAST(round_even(c * 100, 0) AS INTEGER) || '%', ', ' ORDER BY k) || CASE WHEN max(n) > 5 THEN ', +' || (max(n) - 5) || ' more' ELSE '' END AS worst FROM r WHERE k <= 5""",
)
def o11(spark, sf):
    return reports.incomplete_line(load(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 2000.0).alias("coverage")))


@query("u08_two_way", "SELECT n, CASE WHEN a THEN 'left' ELSE 'right' END AS side FROM (SELECT c_custkey AS n, c_custkey % 3 <> 0 AS a, c_custkey % 5 <> 0 AS b FROM customer) WHERE a <> b")
def u08(spark, sf):
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("n"))
    return reports.only_in(rows.filter("n % 3 <> 0"), rows.filter("n % 5 <> 0"), "n")


# ---- caches and vendored copies ----


@query("k11_snapshot_cache", "SELECT url, min(page_id) AS page FROM pages GROUP BY 1")
def k11(spark, sf):
    """The cache as it is read back from its written form."""
    scratch = Scratch(spark, "snapshots")
    sinks.write_records(load(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("page")), f"{scratch.root}/cache", "url")
    return spark.read.schema("url string, page long").json(f"{scratch.root}/cache")


@query(
    "k12_translation_meta",
    """SELECT lang, count(*) || '/' || (SELECT count(*) FROM documents) AS coverage, CASE lang WHEN 'x0' THEN 'a person' ELSE 'unknown' END AS made_by
    FROM (SELECT 'x' || doc_id % 3 AS lang FROM documents WHERE doc_id % 7 <> 0) GROUP BY 1""",
)
def k12(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id")
    strings = docs.filter("doc_id % 7 <> 0").select(F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string")).alias("lang"), F.col("doc_id").alias("key"))
    previous = spark.createDataFrame([("x0", "a person"), ("x1", "")], "lang string, made_by string")
    return sinks.translation_meta(strings, docs, previous)


_SOURCE = "SELECT doc_id AS name, 'a' || chr(13) || chr(10) || text AS text FROM documents WHERE doc_id % 5 <> 0"
_COPIES = "SELECT doc_id AS name, CASE WHEN doc_id % 5 = 2 THEN 'old' ELSE 'a' || chr(10) || text END AS text FROM documents WHERE doc_id % 5 <> 1"


def _vendored(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("name"), "text")
    old = F.when(F.col("name") % 5 == 2, F.lit("old")).otherwise(F.concat(F.lit("a\n"), "text"))
    return docs.filter("name % 5 <> 0").withColumn("text", F.concat(F.lit("a\r\n"), "text")), docs.filter("name % 5 <> 1").withColumn("text", old)


_PLAIN = "replace({0}, chr(13) || chr(10), chr(10))"


@query("k13_vendored_manifest", f"SELECT name, sha256({_PLAIN.format('text')}) AS sha256, length(text) AS bytes FROM ({_SOURCE})")
def k13(spark, sf):
    return sinks.vendored_manifest(_vendored(spark, sf)[0])


@query(
    "k13_synced",
    f"""WITH s AS ({_SOURCE}), c AS ({_COPIES}), b AS (SELECT s.name, s.text AS a, c.text AS b FROM s LEFT JOIN c ON s.name = c.name)
    SELECT name, CASE WHEN b IS NULL THEN 'add' WHEN {_PLAIN.format('a')} <> {_PLAIN.format('b')} THEN 'update' ELSE 'ok' END AS action,
        length(CASE WHEN {_PLAIN.format('a')} = {_PLAIN.format('b')} THEN b ELSE a END) AS n FROM b""",
)
def k13_synced(spark, sf):
    return sinks.synced(*_vendored(spark, sf)).select("name", "action", F.length("text").cast("long").alias("n"))


_TRACK = _pick_sql("c_custkey", ["'pt-BR'", "'EN'", "NULL", "'es_MX'"])


@query("p20_expected_tracks", f"SELECT repo, lang, expected, coalesce(lower(regexp_extract(lang, '^[^-_]*')) = 'pt', false) AS agrees FROM (SELECT c_custkey AS repo, {_TRACK} AS lang, 'pt' AS expected FROM customer)")
def p20(spark, sf):
    tracks = load(spark, sf, "customer").select(F.col("c_custkey").alias("repo"), _pick("c_custkey", ["pt-BR", "EN", None, "es_MX"]).alias("lang"))
    return readers.expected_tracks(tracks, tracks.select("repo", F.lit("pt").alias("lang")))


# ---- entries of several sources ----


@query("t06_fact_names", "SELECT p_partkey, n FROM (SELECT p_partkey, unnest(regexp_extract_all('The ' || p_name || ' of  Anna van Berg and ' || p_brand || ' John Roe. Paul, so', '\\b[A-Z][\\w''.-]+(?:\\s+(?:de|da|do|dos|das|del|van|von|of|al|ibn|bin|the)\\s+[A-Za-z][\\w''.-]+|\\s+[A-Z][\\w''.-]+)+')) AS r, rtrim(r, '.') AS n FROM part)")
def t06(spark, sf):
    label = F.concat(F.lit("The "), "p_name")
    value = F.concat(F.lit("of [[g1|Anna van Berg]] and "), "p_brand", F.lit(" John Roe. Paul, so"))
    return load(spark, sf, "part").select("p_partkey", F.explode(crossref.fact_names(label, value)).alias("n"))


@query(
    "u01_entity_entries",
    f"""WITH f AS (SELECT 'r' || s_nationkey AS repo, {_FOLD.format('s_name')} AS key, 'figures[' || s_suppkey || ']' AS locator, 'figures' AS kind FROM supplier),
         o AS (SELECT 'r' || c_nationkey AS repo, unnest([{_FOLD.format('c_name')}, 'guild n' || c_custkey]) AS key, 'organizations[' || c_custkey || ']' AS locator, 'organizations' AS kind FROM customer),
         x AS (SELECT 'r' || c_nationkey AS repo, 'guild n' || (c_custkey % 40) AS key FROM customer)
    SELECT * FROM f UNION ALL SELECT * FROM o WHERE length(key) >= 6 UNION ALL
    SELECT DISTINCT repo, key, 'facts', 'facts' FROM x WHERE length(key) >= 6 AND (repo, key) NOT IN (SELECT (repo, key) FROM o)""",
)
def u01(spark, sf):
    repo = lambda c: F.concat(F.lit("r"), F.col(c).cast("string")).alias("repo")
    figures = load(spark, sf, "supplier").select(repo("s_nationkey"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("description"))
    customer = load(spark, sf, "customer")
    guild = F.concat("c_name", F.lit(" — Guild N"), F.col("c_custkey").cast("string"))
    organizations = customer.select(repo("c_nationkey"), F.col("c_custkey").alias("pos"), guild.alias("name"), F.lit("kept").alias("description"))
    facts = customer.select(repo("c_nationkey"), F.col("c_custkey").alias("pos"), F.lit("in").alias("label"), F.format_string("the [[g|Guild N%d]], 1", F.col("c_custkey") % 40).alias("value"))
    return crossref.entries(figures, organizations, facts).select("repo", "key", "locator", "kind")


# ---- manifests, witnesses, provenance ----


@query(
    "s09_transcripts",
    f"SELECT s_suppkey AS repo, CAST(unnest(range(CASE s_suppkey % 5 WHEN 4 THEN 0 ELSE 2 END)) AS BIGINT) AS pos, 'T' || s_suppkey || '.' || pos AS id, CASE pos WHEN 0 THEN 't.txt' END AS file FROM supplier",
)
def s09(spark, sf):
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo"))
    own = F.col("repo").cast("string")
    items = F.concat(F.lit('[{"id":"T'), own, F.lit('.0","file":"t.txt"},{"id":"T'), own, F.lit('.1"}]'))
    kind = F.col("repo") % 5
    wrapped = [F.concat(F.lit('{"docs":'), items, F.lit(',"items":[]}')), F.concat(F.lit('{"docs":3,"transcripts":'), items, F.lit("}")), F.concat(F.lit('{"items":'), items, F.lit("}")), items]
    text = F.coalesce(*[F.when(kind == i, w) for i, w in enumerate(wrapped)], F.lit('{"other":1}'))
    return readers.transcript_entries(_json(rows, text)).select("repo", F.col("pos").cast("long").alias("pos"), "id", "file")


@query(
    "s10_resolve",
    f"""SELECT c_custkey AS n, {_pick_sql('c_custkey', ["'d/f' || c_custkey || '.txt'"] * 3 + ["'x/g' || c_custkey || '.txt'", "'d/h' || c_custkey || '.txt'", "'gone' || c_custkey"])} AS path,
               CASE WHEN c_custkey % 6 < 3 THEN 'I' || c_custkey END AS id FROM customer""",
)
def s10(spark, sf):
    rows = load(spark, sf, "customer").select(F.col("c_custkey").alias("n"), F.col("c_custkey").cast("string").alias("s"))
    text = lambda a, b="": F.concat(F.lit(a), "s", F.lit(b))
    kind = F.col("n") % 6
    # By id, by file, by a path that ends in the file; a path that exists, a name in the folder, and nothing known.
    forms = [text("I"), text("f", ".txt"), text("/any/f", ".txt"), text("x/g", ".txt"), text("q/h", ".txt"), text("gone")]
    wanted = rows.select("n", F.coalesce(*[F.when(kind == i, f) for i, f in enumerate(forms)]).alias("arg"))
    entries = rows.filter(kind < 3).select(F.col("n").alias("pos"), text("I").alias("id"), text("f", ".txt").alias("file"))
    files = rows.filter(kind == 3).select(text("x/g", ".txt").alias("path")).union(rows.filter(kind == 4).select(text("d/h", ".txt")))
    return readers.resolve_transcripts(wanted, entries, files, "d/").join(wanted, "arg").select("n", "path", "id")


@query("s15_pinned", "SELECT s_suppkey AS repo, CASE WHEN s_suppkey % 2 = 0 THEN 'b' ELSE '' END AS base, unnest(['a' || s_suppkey, 'x']) AS id, CASE id WHEN 'x' THEN 'Last' ELSE '' END AS term FROM supplier")
def s15(spark, sf):
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("repo"))
    items = F.concat(F.lit('["a'), F.col("repo").cast("string"), F.lit('",{"id":"x","term":"First"},{"term":"none"},7,{"id":""},{"id":"x","term":"Last"}]'))
    text = F.when(F.col("repo") % 2 == 0, F.concat(F.lit('{"baseUrl":"b","terms":'), items, F.lit("}"))).otherwise(items)
    return readers.pinned_terms(_json(rows, text))


@query("s17_witness", "SELECT CAST(o_orderkey AS INTEGER) AS n, CAST(o_orderdate AS DATE) AS d, 'map' AS who FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT CAST(o_orderkey AS INTEGER), CAST(o_orderdate AS DATE), 'files' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey > 0")
def s17(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("n"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    dated = F.when(F.col("n") % 3 != 0, F.concat(F.lit('"'), "d", F.lit('"'))).otherwise(F.lit("null"))
    by_map = readers.witness(_json(rows, F.concat(F.lit('{"aulas":{"'), "n", F.lit('":{"date":'), dated, F.lit("}}}"))))
    # Odd numbers have a second file of another date.
    entry = lambda day: F.concat(F.lit('{"aula":'), "n", F.lit(',"date":"'), day, F.lit('"}'))
    other = F.when(F.col("n") % 2 != 0, entry(F.lit("1970-01-01"))).otherwise(entry(F.col("d")))
    by_files = readers.filename_witness(_json(rows, F.concat(F.lit('{"files":['), entry(F.col("d")), F.lit(","), other, F.lit("]}"))))
    return by_map.withColumn("who", F.lit("map")).unionByName(by_files.withColumn("who", F.lit("files")))


_CODE = _pick_sql("page_id", ["200", "429", "NULL", "204", "500"])


@query(
    "h03_snapshot_lookup",
    f"""WITH p AS (SELECT page_id, {_CODE} AS code, page_id % 4 AS b FROM pages), s AS (SELECT *, CASE WHEN code IS NULL OR code NOT BETWEEN 200 AND 299 OR b = 3 THEN 'inconclusive' WHEN b = 0 THEN 'found' ELSE 'none' END AS state FROM p)
    SELECT page_id, state, CASE state WHEN 'found' THEN 'https://web.example/' || page_id END AS archive_url, CASE state WHEN 'found' THEN '20200102' END AS timestamp FROM s""",
)
def h03(spark, sf):
    own = F.col("page_id").cast("string")
    held = lambda flag: F.concat(F.lit('{"archived_snapshots":{"closest":{"available":' + flag + ',"url":"http://web.example/'), own, F.lit('","timestamp":"20200102"}}}'))
    kind = F.col("page_id") % 4
    body = F.when(kind == 0, held("true")).when(kind == 1, held("false")).when(kind == 2, F.lit('{"archived_snapshots":{}}')).otherwise(F.lit("<html>busy"))
    return load(spark, sf, "pages").select("page_id", web.snapshot_lookup(_pick("page_id", [200, 429, None, 204, 500]), body).alias("s")).select("page_id", "s.*")


@query("j24_tier_rank", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN 1 WHEN 2 THEN 2 END AS rank FROM nation")
def j24(spark, sf):
    tiers = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, pos long")
    return layout.tier_ranks(load(spark, sf, "nation").select("n_nationkey", _pick("n_nationkey", ["a", "b", "c", "z"]).alias("tier")), tiers).select("n_nationkey", "rank")


@query("m06_intensity", "SELECT c_nationkey, count(*) FILTER (c_acctbal > 0) AS total, CASE WHEN total > 0 THEN CAST(CASE WHEN max(total) OVER () > 1 THEN ceil(total / max(total) OVER () * 4) ELSE 4 END AS INTEGER) END AS step FROM customer GROUP BY 1")
def m06(spark, sf):
    cells = load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 0).alias("total"))
    return cells.join(F.broadcast(cells.agg(F.max("total").alias("largest")))).select("c_nationkey", "total", layout.intensity(F.col("total"), F.col("largest")).alias("step"))


@query("m03_clamp_int", f"SELECT c_custkey, CAST({_pick_sql('c_custkey', ['greatest(10, least(500, c_custkey))', '77', '10', '500', '77'])} AS BIGINT) AS v FROM customer")
def m03(spark, sf):
    forms = [F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit("ms")), F.lit("none"), F.lit("-3"), F.lit("99999999999999999999"), F.lit(None)]
    raw = F.coalesce(*[F.when(F.col("c_custkey") % 5 == i, f.cast("string")) for i, f in enumerate(forms)])
    return load(spark, sf, "customer").select("c_custkey", web.clamp_int(raw, 77, 10, 500).alias("v"))


@query("r03_indirect_edges", "SELECT n_nationkey AS repo, n_nationkey % 4 IN (1, 2) AS indirect FROM nation")
def r03(spark, sf):
    tree = lambda inner: F.lit('{"lineage":{"trees":[{"root":{"edge":"direct","children":[{"edge":"direct"},' + inner + "]}}]}}")
    # Deep, at once, in a key that is no node, and without lineage.
    kind = F.col("n_nationkey") % 4
    text = (
        F.when(kind == 0, tree('{"note":{"edge":"indirect"}}'))
        .when(kind == 1, tree('{"children":[{"children":[{"edge":"indirect"}]}]}'))
        .when(kind == 2, F.lit('{"lineage":{"trees":[{"root":{"edge":"direct"}},{"root":{"edge":"indirect"}}]}}'))
        .otherwise(F.lit('{"edge":"indirect"}'))
    )
    return layout.indirect_edges(_json(load(spark, sf, "nation").select(F.col("n_nationkey").alias("repo"), "n_nationkey"), text))


@query("l10_disclaimer", f"SELECT c_custkey, {_pick_sql('c_custkey', [repr(x) for x in ['reviewed', 'machine', 'authored', 'authored', 'authored', 'machine']])} AS shown FROM customer")
def l10(spark, sf):
    kind = F.col("c_custkey") % 6
    made_by = F.coalesce(*[F.when(kind == i, F.lit(t)) for i, t in enumerate(["tools/auto.js", " tools/auto.js v2", "by hand, not tools/auto.js", "tools/auto.jsx", "tools/auto.js", "tools/auto.js"])])
    return load(spark, sf, "customer").select("c_custkey", web.disclaimer(kind != 4, kind == 0, made_by, "tools/auto.js").alias("shown"))


# ---- publication, reading order, reports with counts ----


def _texts(spark, sf):
    return load(spark, sf, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))


@query(
    "k13_publication_check",
    """SELECT 'f' || doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'stale' WHEN doc_id % 7 = 0 THEN 'add' WHEN doc_id % 3 = 0 THEN 'update' ELSE 'ok' END AS action FROM documents""",
)
def k13_check(spark, sf):
    """A set is published, then another one checked: every fifth text is gone, every seventh new, every third changed, others have other line ends."""
    texts, root = _texts(spark, sf).withColumn("k", F.substring("name", 2, 20).cast("long")), Scratch(spark, "site").root
    publish.publish(texts.filter("k % 7 <> 0 or k % 5 = 0").select("name", F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text")), root)
    after = F.when(F.col("k") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return publish.check(texts.filter("k % 5 <> 0").select("name", after.alias("text")), root)


@query(
    "k15_published_places",
    """SELECT r_name || '/places.json' AS name, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS ids FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 4 > 0 GROUP BY 1""",
)
def k15(spark, sf):
    """Each region's part of a gazetteer of nations, read back from its publication."""
    nations = load(spark, sf, "nation")
    wanted = nations.join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("repo"), F.col("n_nationkey").alias("place_id"))
    places, root = nations.filter("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("name")), Scratch(spark, "places").root
    publish.publish(publish.vendored_places(places, wanted), root)
    ids = F.transform(F.from_json("text", "array<struct<place_id: int>>"), lambda x: x["place_id"].cast("string"))
    return publish.published(spark, root).select("name", F.array_join(ids, ",").alias("ids"))


@query(
    "l07_reading_order",
    """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 100 > 0 THEN c_custkey - 1 - (c_custkey * 7) % least(c_custkey % 100, 5) END AS parent, c_nationkey AS pos, CASE WHEN c_custkey % 4 = 0 THEN 'indirect' ELSE 'direct' END AS edge FROM customer),
 t AS (SELECT id, id AS root, 0 AS depth, [lpad(CAST(pos AS VARCHAR), 6, '0') || lpad(CAST(id AS VARCHAR), 12, '0')] AS label FROM n WHERE parent IS NULL
       UNION ALL SELECT n.id, t.root, t.depth + 1, list_append(t.label, lpad(CAST(n.pos AS VARCHAR), 6, '0') || lpad(CAST(n.id AS VARCHAR), 12, '0')) FROM n JOIN t ON n.parent = t.id)
SELECT id, root, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY root ORDER BY label) AS place, edge FROM t JOIN n USING (id)""",
)
def l07(spark, sf):
    """Customers as trees of hundreds: each hangs on one of the five before it."""
    key = F.col("c_custkey")
    parent = F.when(key % 100 > 0, key - 1 - (key * 7) % F.least(key % 100, F.lit(5)))
    nodes = load(spark, sf, "customer").select(key.alias("id"), parent.alias("parent"), F.col("c_nationkey").alias("pos"), F.when(key % 4 == 0, "indirect").otherwise("direct").alias("edge"))
    return layout.reading_order(nodes).select("id", "root", "depth", "place", "edge")


@query(
    "x29_counted_report",
    """WITH d AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)
SELECT CAST(count(*) FILTER (length(t) < 40) AS BIGINT) AS errors, CAST(count(*) FILTER (length(t) > 0 AND NOT regexp_matches(t, '[.!?…"''”)\\]]$')) AS BIGINT) AS warnings FROM d""",
)
def x29(spark, sf):
    """The counts that one job makes while it writes the issues of all documents."""
    text = F.trim(F.coalesce("text", F.lit("")))
    docs = load(spark, sf, "documents")
    found = validate.report(
        [
            validate.issues(docs, F.length(text) < 40, "V15", F.col("doc_id"), "too small"),
            validate.issues(docs, (F.length(text) > 0) & ~text.rlike(r"[.!?…\"'”)\]]$"), "V15", F.col("doc_id"), "ends within a sentence", "warning"),
        ]
    )
    counts = validate.write_report(found, f"{Scratch(spark, 'issues').root}/issues")
    return spark.createDataFrame([(counts["errors"], counts["warnings"])], "errors long, warnings long")


@query(
    "s14_gazetteer_index",
    """WITH n AS (SELECT n_nationkey AS place_id, unnest([n_name, 'Old ' || lower(n_name), CASE WHEN n_nationkey % 5 = 0 THEN 'Straße ' || (n_nationkey % 2) END]) AS name FROM nation)
SELECT replace(lower(name), 'ß', 'ss') AS key, min(place_id) AS place_id FROM n WHERE name IS NOT NULL GROUP BY 1""",
)
def s14(spark, sf):
    key = F.col("n_nationkey")
    street = F.when(key % 5 == 0, F.concat(F.lit("Straße "), key % 2))
    places = load(spark, sf, "nation").select(key.alias("place_id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Old "), F.lower("n_name")), street).alias("variants"))
    return readers.gazetteer_index(places)
