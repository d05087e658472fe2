"""Queries over entities, graphs, dated sequences, links and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import dates, fold, web
from loomstone.operators import consistency, entities, graph, layout, records
from loomstone.operators.components import connected_components
from loomstone.plans.base import query
from loomstone.session import Scratch, load

_FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"


# ---- dates ----


def _orders(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), F.to_date("o_orderdate").alias("d"), "o_orderstatus", "o_totalprice", "o_custkey")


@query("d04_decade", "SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS BIGINT) AS decade, count(*) AS n FROM orders GROUP BY 1")
def d04(spark, sf):
    return _orders(spark, sf).groupBy(dates.decade(F.year("d")).cast("long").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("d06_span", "SELECT o_orderstatus, min(year(o_orderdate)) || '–' || max(year(o_orderdate)) AS span FROM orders GROUP BY 1 HAVING min(year(o_orderdate)) < max(year(o_orderdate))")
def d06(spark, sf):
    lo, hi = F.min(F.year("d")), F.max(F.year("d"))
    return _orders(spark, sf).groupBy("o_orderstatus").agg(dates.span(lo, hi).alias("span"), lo.alias("lo"), hi.alias("hi")).filter("lo < hi").select("o_orderstatus", "span")


@query("p16_off_cadence", "SELECT o_orderkey AS n, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(o_orderdate)] AS weekday FROM orders WHERE isodow(o_orderdate) <> 6")
def p16(spark, sf):
    return _orders(spark, sf).filter(dates.off_cadence(F.col("d"))).select("n", dates.weekday_name(F.col("d")).alias("weekday"))


@query("m01_round1", "SELECT c_custkey, floor(c_acctbal * 10 + 0.5) / 10 AS r FROM customer")
def m01(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", dates.round1(F.col("c_acctbal")).alias("r"))


@query("d07_snapshot_age", "SELECT o_orderkey AS n, CAST(datediff('day', o_orderdate, TIMESTAMP '2002-01-01') AS DOUBLE) AS age FROM orders")
def d07(spark, sf):
    stamp = F.date_format("d", "yyyyMMddHHmmss")
    return _orders(spark, sf).select("n", dates.age_days(stamp, F.lit("2002-01-01").cast("timestamp")).alias("age"))


_SEQ = "SELECT o_orderkey AS n, CAST(o_orderdate AS DATE) AS d FROM orders"


@query(
    "w01_date_anomaly",
    f"""
WITH s AS ({_SEQ}), a AS (SELECT *, lag(d) OVER (ORDER BY n) AS prev, lead(d) OVER (ORDER BY n) AS next FROM s),
     o AS (SELECT *, least(abs(datediff('day', prev, d)), abs(datediff('day', next, d))) AS off FROM a WHERE prev <= next AND NOT (d BETWEEN prev AND next))
SELECT n, off AS off_by, CASE WHEN off >= 300 AND (month(d) = month(prev) OR month(d) = month(next)) THEN 'probable-year-typo' ELSE 'ordering-anomaly' END AS kind FROM o""",
)
def w01(spark, sf):
    return consistency.neighbour_anomalies(_orders(spark, sf)).select("n", F.col("off_by").cast("long").alias("off_by"), "kind")


_WITNESS = f"""
WITH s AS (SELECT n, CASE WHEN n % 5 = 0 THEN NULL ELSE d END AS d, d + CAST(CASE WHEN n % 3 = 0 THEN 400 WHEN n % 3 = 1 THEN -7 ELSE 0 END AS INTEGER) AS i, CASE WHEN n % 2 = 0 THEN d END AS f FROM ({_SEQ})),
     w AS (SELECT *, last_value(d IGNORE NULLS) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
                  first_value(d IGNORE NULLS) OVER (ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM s),
     j AS (SELECT *, coalesce(lo <= hi AND d BETWEEN lo AND hi, false) AS h_fits, coalesce(lo <= hi AND i BETWEEN lo AND hi, false) AS i_fits FROM w),
     v AS (SELECT *, CASE WHEN h_fits AND NOT i_fits THEN 'header' WHEN i_fits AND NOT h_fits THEN 'index' ELSE 'undecided' END AS verdict FROM j)"""


def _witnesses(spark, sf):
    seq = _orders(spark, sf)
    moved = F.date_add("d", F.when(F.col("n") % 3 == 0, 400).when(F.col("n") % 3 == 1, -7).otherwise(0))
    return seq.select("n", F.when(F.col("n") % 5 != 0, F.col("d")).alias("d"), moved.alias("index_d"), F.when(F.col("n") % 2 == 0, F.col("d")).alias("files"))


@query("j09_adjudicate", f"{_WITNESS} SELECT n, verdict FROM v")
def j09(spark, sf):
    return consistency.adjudicate(_witnesses(spark, sf)).select("n", "verdict")


@query(
    "j10_witnesses",
    f"""{_WITNESS} SELECT n, CAST(abs(datediff('day', d, i)) AS BIGINT) AS off_by, verdict, CASE WHEN f IS NULL THEN NULL WHEN f = d THEN 'header' WHEN f = i THEN 'index' ELSE 'neither' END AS files_matches,
    concat_ws(',', CASE WHEN isodow(d) = 6 THEN 'header' END, CASE WHEN isodow(i) = 6 THEN 'index' END, CASE WHEN isodow(f) = 6 THEN 'files' END) AS on_cadence
FROM v WHERE d IS NOT NULL AND d <> i""",
)
def j10(spark, sf):
    rows = consistency.compare_witnesses(_witnesses(spark, sf), ["files"])
    return rows.select("n", F.col("off_by").cast("long").alias("off_by"), "verdict", "files_matches", "on_cadence")


@query("a22_verdict_tally", f"{_WITNESS} SELECT verdict, count(*) AS rows FROM v WHERE d IS NOT NULL AND d <> i GROUP BY 1")
def a22(spark, sf):
    return consistency.compare_witnesses(_witnesses(spark, sf), ["files"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "p17_cadence",
    f"""WITH s AS (SELECT n, CASE WHEN n % 4 = 0 THEN NULL ELSE d END AS d, d + 1 AS c FROM ({_SEQ}))
SELECT n, CASE WHEN isodow(d) <> 6 THEN 'header' ELSE 'candidate' END AS kind, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(CASE WHEN isodow(d) <> 6 THEN d ELSE c END)] AS weekday
FROM s WHERE isodow(d) <> 6 OR isodow(c) <> 6""",
)
def p17(spark, sf):
    docs = _orders(spark, sf).select(F.col("n").alias("id"), "n", F.when(F.col("n") % 4 != 0, F.col("d")).alias("d"), F.date_add("d", 1).alias("candidate"))
    return consistency.cadence(docs).select("n", "kind", "weekday")


@query("a21_single_date", "SELECT l_orderkey AS n, CAST(min(l_shipdate) AS DATE) AS d FROM lineitem GROUP BY 1 HAVING count(DISTINCT CAST(l_shipdate AS DATE)) = 1")
def a21(spark, sf):
    return consistency.single_date(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("n"), F.to_date("l_shipdate").alias("d")))


# ---- entities and graphs ----


def _surfaces(spark, sf):
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("surface"))
    return load(spark, sf, "lineitem").select("l_partkey", F.col("l_orderkey").alias("doc")).join(part, "l_partkey").select("doc", "surface")


def _postings(spark, sf):
    return entities.postings(_surfaces(spark, sf))


_POST = "SELECT DISTINCT l_orderkey AS doc, p_name AS surface FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("a04_postings", f"SELECT surface, count(*) AS docs FROM ({_POST}) GROUP BY 1")
def a04(spark, sf):
    return _postings(spark, sf).groupBy("surface").agg(F.count(F.lit(1)).alias("docs"))


_CANON = f"""
WITH p AS ({_POST}), k AS (SELECT *, {_FOLD.format('surface')} AS key FROM p),
     f AS (SELECT key, surface, count(DISTINCT doc) AS n FROM k GROUP BY ALL),
     t AS (SELECT key, arg_min(surface, row(-n, surface)) AS display, count(*) AS variants FROM f GROUP BY 1),
     c AS (SELECT t.key, display, docs, variants FROM t JOIN (SELECT key, count(DISTINCT doc) AS docs FROM k GROUP BY 1) USING (key))"""


def _canonical(spark, sf):
    # The pairs are as many as the lines at most; counting these reads no rows.
    return entities.canonical_table(_surfaces(spark, sf), rows=load(spark, sf, "lineitem").count())


@query("a05_canonical", f"{_CANON} SELECT * FROM c")
def a05(spark, sf):
    return _canonical(spark, sf).select("key", "display", "docs", "variants")


@query("a06_merge_counts", f"{_CANON} SELECT count(*) FILTER (variants > 1) AS merged_groups, CAST(coalesce(sum(variants - 1) FILTER (variants > 1), 0) AS BIGINT) AS absorbed, count(*) FILTER (variants > 1) AS by_fold, CAST(0 AS BIGINT) AS by_alias FROM c")
def a06(spark, sf):
    return entities.merge_counts(_canonical(spark, sf))


def _parts(spark, sf):
    """A table of entities from part names with a suffix, so that there are many and close ones."""
    name = F.concat_ws(" ", "p_name", F.concat(F.lit("Number"), F.pmod("p_partkey", F.lit(97)).cast("string")))
    return entities.canonical_table(load(spark, sf, "part").select(F.col("p_partkey").alias("doc"), name.alias("surface")))


_PARTS = "SELECT DISTINCT " + _FOLD.format("p_name || ' Number' || (p_partkey % 97)") + " AS key FROM part"


@query(
    "j05_tiered_match",
    f"""
WITH t AS ({_PARTS}), n AS (SELECT DISTINCT p_name || ' Number' || (p_partkey % 97) AS name FROM part UNION SELECT DISTINCT c_name FROM customer)
SELECT name, key, CASE WHEN key IS NULL THEN 'none' ELSE 'high' END AS confidence FROM n LEFT JOIN t ON {_FOLD.format('name')} = key""",
)
def j05(spark, sf):
    part = load(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.concat(F.lit("Number"), F.pmod("p_partkey", F.lit(97)).cast("string"))).alias("name"))
    return entities.tiered_match(part.union(load(spark, sf, "customer").select("c_name")), _parts(spark, sf))


_TOK = f"WITH t AS ({_PARTS}), w AS (SELECT DISTINCT key, unnest(string_split(key, ' ')) AS token FROM t), c AS (SELECT token, count(*) AS m FROM w GROUP BY 1)"


@query(
    "j06_near_miss",
    f"""{_TOK}, q AS (SELECT DISTINCT p_name || ' Numbr' || (p_partkey % 97) AS name FROM part), o AS (SELECT name, {_FOLD.format('name')} AS own FROM q),
    a AS (SELECT o.name, w.key, CAST(NULL AS BIGINT) AS d FROM o JOIN w ON w.token = list_last(string_split(o.own, ' ')) JOIN c USING (token) WHERE m <= 3 AND length(token) >= 4 AND own <> w.key),
    b AS (SELECT o.name, t.key, levenshtein(o.own, t.key) AS d FROM o JOIN t ON abs(length(o.own) - length(t.key)) <= 2 AND o.own[1] = t.key[1] WHERE length(own) >= 8 AND levenshtein(o.own, t.key) <= 2 AND own <> t.key),
    u AS (SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (name, key)),
    s AS (SELECT DISTINCT p_partkey AS doc, {_FOLD.format("p_name || ' Number' || (p_partkey % 97)")} AS key, p_name || ' Number' || (p_partkey % 97) AS display FROM part),
    n AS (SELECT key, count(*) AS docs, min(display) AS display FROM s GROUP BY 1)
SELECT name, key, coalesce('edit distance ' || d, 'rare name part') AS why FROM u JOIN n USING (key)
QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN d IS NULL THEN 1 ELSE 0 END, docs DESC, display, key) <= 3""",
)
def j06(spark, sf):
    name = F.concat_ws(" ", "p_name", F.concat(F.lit("Numbr"), F.pmod("p_partkey", F.lit(97)).cast("string")))
    return entities.near_misses(load(spark, sf, "part").select(name.alias("name")).distinct(), _parts(spark, sf))


@query(
    "j07_suggestions",
    f"""{_TOK}, s AS (SELECT token, key, m FROM w JOIN c USING (token) WHERE length(token) > 2 AND m <= 12),
    p AS (SELECT x.key AS a, y.key AS b, x.token, x.m FROM s x JOIN s y USING (token) WHERE x.key < y.key),
    k AS (SELECT a, b, CASE WHEN levenshtein(a, b) <= CASE WHEN greatest(length(a), length(b)) >= 14 THEN 2 ELSE 1 END THEN 0
              WHEN (len(list_filter(string_split(a, ' '), lambda z: NOT list_contains(string_split(b, ' '), z))) = 0) <> (len(list_filter(string_split(b, ' '), lambda z: NOT list_contains(string_split(a, ' '), z))) = 0) THEN 1
              WHEN m <= 3 AND length(token) >= 4 THEN 2 END AS r FROM p)
SELECT a, b, ['edit1', 'token-subset', 'shared-token'][min(r) + 1] AS kind FROM k WHERE r IS NOT NULL GROUP BY a, b""",
)
def j07(spark, sf):
    return entities.suggestions(_parts(spark, sf))


def _edges(spark, sf, least):
    return graph.cooccurrence(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("entity")), least)


def _edge_sql(least: int) -> str:
    return f"""SELECT a.e AS source, b.e AS target, count(*) AS weight FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS e FROM lineitem) a
    JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS e FROM lineitem) b ON a.o = b.o AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= {least}"""


@query("j08_edges", _edge_sql(1))
def j08(spark, sf):
    return _edges(spark, sf, 1)


@query("p15_cut", _edge_sql(2))
def p15(spark, sf):
    return _edges(spark, sf, 2)


@query(
    "a07_degree",
    f"""WITH e AS ({_edge_sql(2)}), d AS (SELECT source AS n, weight FROM e UNION ALL SELECT target, weight FROM e)
SELECT p_partkey AS entity, count(weight) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weighted FROM part LEFT JOIN d ON n = p_partkey GROUP BY 1""",
)
def a07(spark, sf):
    return graph.degrees(load(spark, sf, "part").select(F.col("p_partkey").alias("entity")), _edges(spark, sf, 2))


@query("o05_top_edges", f"SELECT * FROM ({_edge_sql(1)}) ORDER BY weight DESC, source, target LIMIT 20")
def o05(spark, sf):
    return _edges(spark, sf, 1).orderBy(F.desc("weight"), "source", "target").limit(20)


def _components(spark, sf):
    edges = _edges(spark, sf, 3)
    return connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), Scratch(spark, "graph"))


@query(
    "a08_components",
    f"""WITH RECURSIVE e AS ({_edge_sql(3)}), b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e),
r AS (SELECT x AS node, x AS m FROM b UNION SELECT b.y, r.m FROM r JOIN b ON b.x = r.node) SELECT node, min(m) AS component FROM r GROUP BY 1""",
)
def a08(spark, sf):
    return _components(spark, sf)


@query(
    "a09_component_sizes",
    f"""WITH RECURSIVE e AS ({_edge_sql(3)}), b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e),
r AS (SELECT x AS node, x AS m FROM b UNION SELECT b.y, r.m FROM r JOIN b ON b.x = r.node), c AS (SELECT node, min(m) AS component FROM r GROUP BY 1) SELECT component, count(*) AS size FROM c GROUP BY 1""",
)
def a09(spark, sf):
    return _components(spark, sf).groupBy("component").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "component")


_GRAPH = f"WITH e AS ({_edge_sql(3)}), n AS (SELECT source AS x FROM e UNION SELECT target FROM e)"


@query(
    "k06_graphml",
    f"""{_GRAPH} SELECT * FROM (VALUES (0, '0', '<?xml version="1.0" encoding="UTF-8"?>'), (0, '1', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (0, '2', '<key id="w" for="edge" attr.name="weight" attr.type="int"/>'),
 (0, '3', '<graph id="g" edgedefault="undirected">'), (3, '0', '</graph>'), (3, '1', '</graphml>')) v(part, k, line)
UNION ALL SELECT 1, CAST(x AS VARCHAR), '<node id="' || x || '"/>' FROM n
UNION ALL SELECT 2, source || ' ' || target, '<edge source="' || source || '" target="' || target || '"><data key="w">' || weight || '</data></edge>' FROM e""",
)
def k06(spark, sf):
    edges = _edges(spark, sf, 3)
    nodes = edges.select(F.col("source").alias("entity")).union(edges.select("target")).distinct()
    return graph.graphml_lines(nodes, edges)


@query(
    "k07_dot",
    f"""{_GRAPH} SELECT * FROM (VALUES (0, '', 'graph g {{'), (3, '', '}}')) v(part, k, line)
UNION ALL SELECT 1, CAST(x AS VARCHAR), '  "' || x || '";' FROM n
UNION ALL SELECT 2, source || ' ' || target, '  "' || source || '" -- "' || target || '" [weight=' || weight || '];' FROM e""",
)
def k07(spark, sf):
    edges = _edges(spark, sf, 3)
    nodes = edges.select(F.col("source").alias("entity")).union(edges.select("target")).distinct()
    return graph.dot_lines(nodes, edges)


@query(
    "k16_graph_json",
    f"""{_GRAPH}, r AS (SELECT *, row_number() OVER (ORDER BY source, target) AS k FROM e)
SELECT 0 AS part, CAST(0 AS BIGINT) AS k, '{{"repo":"lineitem","kind":"graph","subcommand":"edges","count":' || count(*) || ',"fields":["source","target","weight"],"rows":[' AS line FROM e
UNION ALL SELECT 1, k, CASE WHEN k > 1 THEN ',' ELSE '' END || '{{"source":' || source || ',"target":' || target || ',"weight":' || weight || '}}' FROM r UNION ALL SELECT 2, 0, ']}}'""",
)
def k16(spark, sf):
    """The graph's edges as one JSON document, by lines."""
    return records.envelope(_edges(spark, sf, 3).select("source", "target", "weight"), "lineitem", "graph", "edges", ["source", "target"])


# ---- across datasets ----


def _brands(spark, sf):
    return load(spark, sf, "part").select(F.col("p_brand").alias("repo"), fold.fold_key(F.col("p_name")).alias("key"), F.array(F.lower(F.split("p_type", " ")[0])).alias("terms"))


_BR = f"SELECT p_brand AS repo, {_FOLD.format('p_name')} AS key, lower(string_split(p_type, ' ')[1]) AS term FROM part"


@query("j04_shared_entities", f"SELECT key, array_to_string(list_sort(list(DISTINCT repo)), ',') AS repos FROM ({_BR}) GROUP BY 1 HAVING count(DISTINCT repo) >= 2")
def j04(spark, sf):
    return consistency.shared_entities(_brands(spark, sf)).select("key", F.array_join("repos", ",").alias("repos"))


@query(
    "a23_divergence",
    f"""SELECT key, count(DISTINCT repo) AS repos, CASE WHEN count(DISTINCT term) > 1 THEN 'differs' ELSE 'ok' END AS status FROM ({_BR}) GROUP BY 1 HAVING count(DISTINCT repo) >= 2""",
)
def a23(spark, sf):
    return consistency.divergence(_brands(spark, sf)).select("key", F.col("repos").cast("long").alias("repos"), "status")


@query(
    "t07_affiliation",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'adjacent,!member' WHEN 1 THEN 'founder,member' WHEN 2 THEN '!follower' ELSE '' END AS terms FROM documents""",
)
def t07(spark, sf):
    said = (
        F.when(F.col("doc_id") % 4 == 0, F.lit(" adjacent to it, never a member of it."))
        .when(F.col("doc_id") % 4 == 1, F.lit(" founder; not rich; a member."))
        .when(F.col("doc_id") % 4 == 2, F.lit(" não foi seguidor."))
        .otherwise(F.lit(""))
    )
    terms = consistency.affiliation_terms(F.concat(F.col("source"), said))
    order = F.array_sort(terms, lambda a, b: F.when(F.ltrim(a, F.lit("!")) < F.ltrim(b, F.lit("!")), -1).otherwise(1))
    return load(spark, sf, "documents").select("doc_id", F.array_join(order, ",").alias("terms"))


def _gazetteer(spark, sf):
    return load(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("place_id"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Land of "), "n_name")).alias("variants"), F.col("n_regionkey").alias("region"))


_PLACES = """SELECT c_custkey, c_nationkey, trim(unnest(string_split(place, ' / '))) AS part FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % 3 WHEN 0 THEN n_name || ' / Nowhere' WHEN 1 THEN 'land of ' || n_name ELSE n_name || ', North' END AS place
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _placed(spark, sf):
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    place = F.when(F.col("c_custkey") % 3 == 0, F.concat("n_name", F.lit(" / Nowhere"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("land of "), "n_name")).otherwise(F.concat("n_name", F.lit(", North")))
    rows = load(spark, sf, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey").select("c_custkey", place.alias("place"))
    return consistency.resolve_places(rows, _gazetteer(spark, sf))


_RESOLVED = f"WITH p AS ({_PLACES}), g AS (SELECT CAST(n_nationkey AS VARCHAR) AS place_id, lower(n_name) AS key FROM nation UNION SELECT CAST(n_nationkey AS VARCHAR), lower('Land of ' || n_name) FROM nation)"


@query("j11_place_resolve", f"{_RESOLVED} SELECT c_custkey, part, place_id FROM p LEFT JOIN g ON lower(part) = key")
def j11(spark, sf):
    return _placed(spark, sf).select("c_custkey", "part", "place_id")


@query("a12_place_usage", f"{_RESOLVED} SELECT coalesce(place_id, '-') AS place_id, count(*) AS n, count(DISTINCT part) AS spellings FROM p LEFT JOIN g ON lower(part) = key GROUP BY 1")
def a12(spark, sf):
    return _placed(spark, sf).groupBy(F.coalesce("place_id", F.lit("-")).alias("place_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("spellings"))


@query("j15_quote_verify", "SELECT item_id, doc_id FROM benchmark JOIN documents d ON contains(d.text, benchmark.text)")
def j15(spark, sf):
    quotes = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return consistency.holding(load(spark, sf, "documents").select("doc_id", "text"), quotes)


@query(
    "j15_quote_verdicts",
    """SELECT item_id, CASE WHEN d.text IS NULL THEN 'file-missing' WHEN contains(d.text, b.text) THEN 'verified' ELSE 'NOT-LITERAL' END AS verdict
       FROM benchmark b LEFT JOIN documents d ON d.doc_id = CASE WHEN item_id % 9 = 0 THEN -1 ELSE item_id * 7 END""",
)
def j15b(spark, sf):
    quotes = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"), F.when(F.col("item_id") % 9 == 0, -1).otherwise(F.col("item_id") * 7).cast("long").alias("doc_id"))
    return consistency.verify_quotes(quotes, load(spark, sf, "documents")).select("item_id", "verdict")


def _halves(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("name"), web.text_digest(F.col("text")).alias("digest"), F.col("doc_id").alias("i"))
    copy = docs.filter("i % 5 <> 1").withColumn("digest", F.when(F.col("i") % 5 == 2, F.lit("old")).otherwise(F.col("digest")))
    return docs.filter("i % 5 <> 0"), copy


@query("j18_sync_plan", "SELECT doc_id AS name, CASE doc_id % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'add' WHEN 2 THEN 'update' ELSE 'ok' END AS action FROM documents")
def j18(spark, sf):
    return consistency.sync_plan(*_halves(spark, sf))


@query("a27_action_counts", "SELECT CASE doc_id % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'add' WHEN 2 THEN 'update' ELSE 'ok' END AS action, count(*) AS n FROM documents GROUP BY 1")
def a27(spark, sf):
    return consistency.sync_plan(*_halves(spark, sf)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("u04_except", "SELECT doc_id AS name FROM documents WHERE doc_id % 5 = 1")
def u04(spark, sf):
    a, b = _halves(spark, sf)
    return a.select("name").exceptAll(b.select("name"))


@query("j21_missing_stale", "SELECT doc_id AS name, CASE doc_id % 5 WHEN 1 THEN 'missing' ELSE 'stale' END AS state FROM documents WHERE doc_id % 5 IN (0, 1)")
def j21(spark, sf):
    return consistency.missing_and_stale(*_halves(spark, sf), "name")


@query("a30_coverage", "SELECT count(*) FILTER (doc_id % 5 <> 1) AS done, count(*) AS total FROM documents WHERE doc_id % 5 <> 0")
def a30(spark, sf):
    a, b = _halves(spark, sf)
    done = a.join(b.select("name"), "name", "left_semi").agg(F.count(F.lit(1)).alias("done"))
    return done.crossJoin(a.agg(F.count(F.lit(1)).alias("total")))


def _served(spark, sf):
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("url"), F.lit(200).alias("status"), web.text_digest(F.col("html")).alias("digest"))
    changed = F.when(F.col("url") % 7 == 0, F.lit("old")).otherwise(F.col("digest"))
    served = pages.select("url", F.when(F.col("url") % 11 == 0, 500).otherwise(200).alias("status"), changed.alias("digest"))
    return served, pages


@query("j20_byte_equal", "SELECT page_id AS url, CASE WHEN page_id % 11 = 0 THEN 'unreachable' WHEN page_id % 7 = 0 THEN 'stale' ELSE 'current' END AS state FROM pages")
def j20(spark, sf):
    return consistency.served_state(*_served(spark, sf))


@query("j22_snapshot_upsert", "SELECT url, CASE WHEN k % 3 = 0 THEN '2' ELSE '1' END AS stamp FROM (SELECT url, min(page_id) AS k FROM pages GROUP BY 1)")
def j22(spark, sf):
    pages = load(spark, sf, "pages").groupBy("url").agg(F.min("page_id").alias("k"))
    old = pages.filter("k % 2 = 0 or k % 3 <> 0").select("url", F.lit("1").alias("stamp"))
    return consistency.upsert(old, pages.filter("k % 3 = 0").select("url", F.lit("2").alias("stamp")), "url")


_HEAD = "(CASE page_id % 6 WHEN 0 THEN 403 WHEN 1 THEN 404 WHEN 2 THEN 200 WHEN 3 THEN 301 WHEN 4 THEN 503 ELSE 410 END)"
_GET = "(CASE page_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 200 WHEN 2 THEN 429 ELSE 200 END)"
_STATUS = f"CASE WHEN {_HEAD} IN (0, 403, 404, 405, 429, 501) THEN {_GET} ELSE {_HEAD} END"
_STATE = f"CASE WHEN s IN (404, 410) THEN 'dead' WHEN s BETWEEN 200 AND 399 THEN CASE WHEN page_id % 10 = 0 THEN 'suspect' ELSE 'ok' END ELSE 'inconclusive' END"


def _verdicts(spark, sf):
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    found = F.when(F.col("page_id") % 10 == 0, F.lit("Page not found")).otherwise(F.lit("A quiet archive"))
    verdict = web.link_verdict(pick(6, [403, 404, 200, 301, 503, 410]), pick(4, [404, 200, 429, 200]), F.lit(False), F.lit("A quiet archive"), found)
    return load(spark, sf, "pages").select("page_id", verdict.alias("verdict"))


@query("h01_verdict", f"SELECT page_id, {_STATE} AS verdict FROM (SELECT page_id, {_STATUS} AS s FROM pages)")
def h01(spark, sf):
    return _verdicts(spark, sf)


@query("a17_summary", f"SELECT {_STATE} AS verdict, count(*) AS n FROM (SELECT page_id, {_STATUS} AS s FROM pages) GROUP BY 1")
def a17(spark, sf):
    return _verdicts(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h04_schedule",
    """WITH u AS (SELECT url, min(page_id) AS pos FROM pages WHERE regexp_matches(url, '^https?://') GROUP BY 1),
w AS (SELECT *, CASE WHEN pos % 4 = 0 THEN 'lookup' WHEN pos % 3 = 0 AND pos % 50 > 30 THEN 'recapture' ELSE 'skip' END AS wanted FROM u),
k AS (SELECT *, count(*) FILTER (wanted <> 'skip') OVER (ORDER BY pos, url) AS k FROM w)
SELECT url, CASE WHEN wanted <> 'skip' AND k > 20 THEN 'defer' ELSE wanted END AS decision FROM k""",
)
def h04(spark, sf):
    refs = consistency.first_by_url(load(spark, sf, "pages").select("url", F.col("page_id").alias("pos")))
    refs = refs.withColumns({"official": F.col("pos") % 3 == 0, "age": F.when(F.col("pos") % 4 != 0, (F.col("pos") % 50).cast("double"))})
    return consistency.capture_schedule(refs, 30.0, 20).select("url", "decision")


@query("p19_first_by_url", "SELECT url, min(page_id) AS pos FROM pages WHERE regexp_matches(url, '^https?://') GROUP BY 1")
def p19(spark, sf):
    return consistency.first_by_url(load(spark, sf, "pages").select("url", F.col("page_id").alias("pos"))).select("url", "pos")


# ---- figures ----


def _events(spark, sf):
    """Orders as events: the years 1997 to 2000 stretched apart, so that there is a gap."""
    rows = load(spark, sf, "orders")
    year = (F.year("o_orderdate") - 1995) * 30 + 1700
    return rows.select(F.col("o_orderkey").alias("id"), year.alias("year"), (F.col("o_orderstatus") != "O").alias("verified"), F.array("o_orderpriority", "o_orderstatus").alias("threads"), F.col("o_custkey"))


_EV = "SELECT o_orderkey AS id, (year(o_orderdate) - 1995) * 30 + 1700 AS year, o_orderstatus <> 'O' AS verified, o_orderpriority, o_orderstatus, o_custkey FROM orders"
_COLS = f"""
e AS ({_EV}), c AS (SELECT CAST(floor(year / 10) * 10 AS BIGINT) AS decade, count(*) AS total, count(*) FILTER (NOT verified) AS unverified FROM e GROUP BY 1),
g AS (SELECT unnest(range((SELECT min(decade) FROM c), (SELECT max(decade) FROM c) + 1, 10)) AS decade),
m AS (SELECT g.decade, total, unverified, count(total) OVER (ORDER BY g.decade) AS island FROM g LEFT JOIN c USING (decade)),
z AS (SELECT *, count(*) OVER (PARTITION BY island, total IS NULL) AS n FROM m),
col AS (SELECT 'decade' AS kind, decade AS start, total, unverified, CAST(1 AS BIGINT) AS count FROM z WHERE total IS NOT NULL OR n < 2
      UNION ALL SELECT 'break', min(decade), NULL, NULL, count(*) FROM z WHERE total IS NULL AND n >= 2 GROUP BY island)"""


@query("a14_columns", f"WITH {_COLS} SELECT kind, start, count FROM col")
def a14(spark, sf):
    present = _events(spark, sf).select(dates.decade(F.col("year")).alias("decade")).distinct()
    return layout.decade_columns(present).select("kind", F.col("start").cast("long").alias("start"), "count")


@query(
    "a13_spine",
    f"WITH {_COLS} SELECT kind, start, CASE WHEN kind = 'decade' THEN coalesce(total, 0) END AS total, CASE WHEN kind = 'decade' THEN coalesce(unverified, 0) END AS unverified, CASE WHEN kind = 'decade' THEN floor(coalesce(total, 0) / (SELECT max(total) FROM c) * 100 * 10 + 0.5) / 10 END AS pct FROM col",
)
def a13(spark, sf):
    return layout.spine(_events(spark, sf)).select("kind", F.col("start").cast("long").alias("start"), "total", "unverified", "pct")


@query(
    "a15_swimlanes",
    f"""WITH {_COLS}, t AS (SELECT CAST(floor(year / 10) * 10 AS BIGINT) AS start, verified, unnest([o_orderpriority, o_orderstatus]) AS lane FROM e), n AS (SELECT lane, start, count(*) AS total, count(*) FILTER (NOT verified) AS unverified FROM t GROUP BY ALL),
l AS (SELECT DISTINCT lane FROM t UNION SELECT 'empty')
SELECT l.lane, col.kind, col.start, CASE WHEN kind = 'decade' THEN coalesce(n.total, 0) END AS total, CASE WHEN kind = 'decade' THEN coalesce(n.unverified, 0) END AS unverified FROM l CROSS JOIN col LEFT JOIN n ON n.lane = l.lane AND n.start = col.start""",
)
def a15(spark, sf):
    events = _events(spark, sf)
    lanes = events.select(F.explode("threads").alias("lane")).distinct().union(spark.createDataFrame([("empty",)], "lane string"))
    return layout.swimlanes(events, lanes).select("lane", "kind", F.col("start").cast("long").alias("start"), "total", "unverified")


def _mapped(spark, sf):
    nation = load(spark, sf, "nation").select(F.col("n_nationkey").alias("place_id"), (F.col("n_nationkey") * 5.0 - 60).alias("lat"), F.when(F.col("n_nationkey") != 3, F.col("n_nationkey") * 12.0 - 150).alias("lon"))
    nations = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("place_id"))
    return layout.places_map(_events(spark, sf).join(nations, "o_custkey"), nation)


_MAP = f"""WITH e AS ({_EV}), p AS (SELECT n_nationkey AS place_id, n_nationkey * 5.0 - 60 AS lat, n_nationkey * 12.0 - 150 AS lon FROM nation WHERE n_nationkey <> 3),
j AS (SELECT p.*, e.year, e.verified FROM e JOIN customer ON c_custkey = o_custkey JOIN p ON p.place_id = c_nationkey), f AS (SELECT place_id, min(year) AS first_year, count(*) AS n, any_value(lat) AS lat, any_value(lon) AS lon FROM j GROUP BY 1)"""


@query(
    "a16_places_map",
    f"""{_MAP} SELECT f.place_id, f.n, f.first_year, bool_or(NOT j.verified) AS first_unverified, CAST(f.lon + 180 AS DOUBLE) AS x, CAST(90 - f.lat AS DOUBLE) AS y, floor((1 + sqrt(f.n)) * 10 + 0.5) / 10 AS radius
FROM f JOIN j ON j.place_id = f.place_id AND j.year = f.first_year GROUP BY ALL""",
)
def a16(spark, sf):
    return _mapped(spark, sf).select("place_id", "n", F.col("first_year").cast("long").alias("first_year"), "first_unverified", "x", "y", "radius")


@query(
    "m05_crop",
    f"""{_MAP}, b AS (SELECT min(lon + 180.0) AS x0, max(lon + 180.0) AS x1, min(90.0 - lat) AS y0, max(90.0 - lat) AS y1 FROM f),
 s AS (SELECT *, greatest(x1 - x0 + 12, 60.0) AS w, greatest(y1 - y0 + 12, 30.0) AS h FROM b)
SELECT CAST(floor(greatest(0.0, least((x0 + x1 - w) / 2, 360 - w)) * 10 + 0.5) / 10 AS DOUBLE) AS x, CAST(floor(greatest(0.0, least((y0 + y1 - h) / 2, 180 - h)) * 10 + 0.5) / 10 AS DOUBLE) AS y,
       CAST(floor(least(w, 360.0) * 10 + 0.5) / 10 AS DOUBLE) AS width, CAST(floor(least(h, 180.0) * 10 + 0.5) / 10 AS DOUBLE) AS height FROM s""",
)
def m05(spark, sf):
    return layout.crop(_mapped(spark, sf))


@query(
    "a24_numbers",
    """WITH p AS (SELECT c_mktsegment AS series, c_custkey AS k, c_acctbal AS value FROM customer), m AS (SELECT *, greatest(max(value) OVER (PARTITION BY series), 1.0) AS top FROM p)
SELECT series, k, floor(least(greatest(value / CASE WHEN series = 'BUILDING' THEN 5000.0 ELSE top END * 100, 0.0), 100.0) * 10 + 0.5) / 10 AS pct FROM m""",
)
def a24(spark, sf):
    rows = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("series"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit(5000.0)).alias("axis_max"))
    return layout.numbers_chart(rows).select("series", "k", "pct")


@query(
    "l01_branches",
    """WITH b AS (SELECT n_nationkey AS pos, n_name AS id, 1900 + n_nationkey * 4 AS year, CASE WHEN n_nationkey % 3 = 0 THEN 2000 END AS stop, CASE WHEN n_nationkey > 4 THEN n_nationkey - 4 END AS f FROM nation),
l AS (SELECT *, row_number() OVER (ORDER BY pos) AS lane FROM b)
SELECT l.id, l.lane, (l.lane - 1) % 6 AS colour, l.stop IS NOT NULL AS terminal, CAST(20 + (l.year - 1900) * 4 AS BIGINT) AS x_fork, CAST(20 + (coalesce(l.stop, 2020) - 1900) * 4 AS BIGINT) AS x_end, CAST(20 + l.lane * 30 AS BIGINT) AS y, CAST(20 + coalesce(p.lane, 0) * 30 AS BIGINT) AS y_from
FROM l LEFT JOIN l p ON p.pos = l.f""",
)
def l01(spark, sf):
    nation = load(spark, sf, "nation")
    parents = nation.select((F.col("n_nationkey") + 4).alias("n_nationkey"), F.col("n_name").alias("parent"))
    rows = nation.join(parents, "n_nationkey", "left").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id"), (F.col("n_nationkey") * 4 + 1900).alias("year"), F.when(F.col("n_nationkey") % 3 == 0, 2000).alias("stop"), F.when(F.col("n_nationkey") > 4, F.col("parent")).alias("parent"))
    out = layout.branches(rows, 1900, 2020)
    return out.select("id", "terminal", *[F.col(c).cast("long").alias(c) for c in ("lane", "colour", "x_fork", "x_end", "y", "y_from")])


@query(
    "w06_header",
    f"""WITH e AS (SELECT DISTINCT year FROM ({_EV})), d AS (SELECT year, CAST(floor(year / 10) * 10 AS BIGINT) AS decade FROM e)
SELECT CAST(year AS BIGINT) AS year, CASE WHEN lag(decade) OVER (ORDER BY year) IS DISTINCT FROM decade THEN decade || 's' END AS header FROM d""",
)
def w06(spark, sf):
    years = _events(spark, sf).select("year").distinct().select("year", F.lit(None).cast("string").alias("date"), F.col("year").alias("id"))
    return layout.decade_headers(years).select(F.col("year").cast("long").alias("year"), "header")


@query(
    "events_by_hour",
    "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def events_by_hour(spark, sf):
    return load(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
