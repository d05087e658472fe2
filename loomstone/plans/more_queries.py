"""Queries over vocabulary, citations, translations, and the remaining scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import dates, fold, web
from loomstone.operators import records, validate, vocabulary
from loomstone.plans.base import query
from loomstone.session import load


@query("x07_conjunctions", "SELECT c_custkey, n_name AS l, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE length(trim(lower(n_name))) >= 4 AND length(trim(lower(r_name))) >= 4")
def x07(spark, sf):
    nation = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = fold.conjunction_parts(F.concat("n_name", F.lit(" and "), "r_name"))
    return both.select("c_custkey", parts.alias("p")).filter("p is not null").select("c_custkey", F.col("p.left").alias("l"), F.col("p.right").alias("r"))


@query("x08_name_variants", "SELECT s_suppkey, s_name || '|Branch|Old ' || s_suppkey AS v FROM supplier")
def x08(spark, sf):
    name = F.concat("s_name", F.lit(" — Branch (Old "), F.col("s_suppkey").cast("string"), F.lit(")"))
    return load(spark, sf, "supplier").select("s_suppkey", F.array_join(fold.name_variants(name), "|").alias("v"))


@query("x09_search_variants", "SELECT s_suppkey, 'Ada ' || s_name || ' Lima|Bea Costa|OLD' AS v FROM supplier")
def x09(spark, sf):
    name = F.concat(F.lit("Ada "), "s_name", F.lit(" Lima / Bea Costa (OLD) (not this)"))
    return load(spark, sf, "supplier").select("s_suppkey", F.array_join(fold.search_variants(name), "|").alias("v"))


@query("x10_dataset_variants", "SELECT s_suppkey, s_name || ' & Sons, Rome|' || s_name || '|Sons|Rome' AS v FROM supplier")
def x10(spark, sf):
    return load(spark, sf, "supplier").select("s_suppkey", F.array_join(fold.dataset_variants(F.concat("s_name", F.lit(" & Sons, Rome"))), "|").alias("v"))


@query("x11_paren_terms", "SELECT s_suppkey, s_name || '|AB' AS v FROM supplier")
def x11(spark, sf):
    return load(spark, sf, "supplier").select("s_suppkey", F.array_join(fold.paren_terms(F.concat(F.lit("Of ("), "s_name", F.lit(", AB; lower) and (x)"))), "|").alias("v"))


@query("x12_snippet", "SELECT doc_id, CASE WHEN i - 1 - 46 > 0 THEN '…' ELSE '' END || substr(text, greatest(i - 47, 0) + 1, 140) || CASE WHEN greatest(i - 47, 0) + 140 < length(text) THEN '…' ELSE '' END AS s FROM (SELECT *, instr(text, ' en') AS i FROM documents) WHERE i > 0")
def x12(spark, sf):
    at = F.instr("text", " en")
    return load(spark, sf, "documents").filter(at > 0).select("doc_id", records.snippet(F.col("text"), at).alias("s"))


@query("x19_header_safe", "SELECT s_suppkey, 'Elan - ' || s_name || ' x' AS h FROM supplier")
def x19(spark, sf):
    return load(spark, sf, "supplier").select("s_suppkey", web.header_safe(F.concat(F.lit("Élan — "), "s_name", F.lit(" x☃"))).alias("h"))


@query("x26_soft_redirect", "SELECT page_id, page_id % 2 = 0 AS soft FROM pages")
def x26(spark, sf):
    return load(spark, sf, "pages").select("page_id", web.soft_redirect(F.col("page_id") % 2 == 0, F.lit("Quiet archive"), F.lit("Parking lot")).alias("soft"))


@query("x27_slugs", "SELECT page_id, 'a-b,p' || page_id AS slugs FROM pages")
def x27(spark, sf):
    html = F.concat(F.lit('<a href="/p'), F.col("page_id").cast("string"), F.lit('/en/"> <a href="/a-b/pt/"> <a href="/a-b/en/"> <a href="/no/fr/">'))
    return load(spark, sf, "pages").select("page_id", F.array_join(vocabulary.slugs(html), ",").alias("slugs"))


@query("x28_dot_escape", "SELECT doc_id, sha256(replace(replace(text, '\\', '\\\\'), '\"', '\\\"')) AS digest FROM documents")
def x28(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2(web.escape_dot(F.col("text")), 256).alias("digest"))


@query("d01_iso_date", "SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def d01(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), dates.iso_date(text).alias("d"))


@query("d05_event_year", "SELECT o_orderkey AS n, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders")
def d05(spark, sf):
    date = F.concat(F.lit("about "), F.year("o_orderdate").cast("string"), F.lit(" or so"))
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), dates.event_year(F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate").cast("string")), date).cast("long").alias("y"))


@query("a11_date_window", "SELECT o_orderstatus AS scope, CAST(min(year(o_orderdate)) AS BIGINT) AS lo, CAST(max(year(o_orderdate)) AS BIGINT) AS hi FROM orders GROUP BY 1 UNION ALL SELECT '*', min(year(o_orderdate)), max(year(o_orderdate)) FROM orders")
def a11(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), F.concat(F.lit("In "), F.year("o_orderdate").cast("string"), F.lit(", no. 123.")).alias("t"))
    return vocabulary.date_window(rows, "s", "t").select("scope", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


_IDS = "SELECT doc_id, unnest([source, lang, source]) AS id FROM documents"


@query("a26_marker_usage", f"SELECT id, count(*) AS uses, array_to_string(list_slice(list_sort(list(DISTINCT doc_id)), 1, 4), ',') AS places FROM ({_IDS}) GROUP BY 1")
def a26(spark, sf):
    text = F.concat(F.lit("[["), "source", F.lit("]] [["), "lang", F.lit("|x]] [["), "source", F.lit("]]"))
    ids = load(spark, sf, "documents").select("doc_id", F.explode(web.marker_ids(text)).alias("id"))
    uses = ids.groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    from pyspark.sql import Window

    # The first four places by a rank limit, not by a list of all.
    first = ids.distinct().withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("doc_id"))).filter("k <= 4")
    places = first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("places"))
    return uses.join(places, "id")


@query("j12_citations", "SELECT CAST(c_custkey AS VARCHAR) AS locator, CAST(0 AS BIGINT) AS pos, CAST(c_nationkey + 1 AS VARCHAR) AS mark FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, 'web' FROM customer")
def j12(spark, sf):
    rows = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("locator"), F.array(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")), F.lit("https://x.org"), F.lit("gone")).alias("sources"))
    refs = load(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("pos"))
    return vocabulary.cite(rows, refs).select("locator", F.col("pos").cast("long").alias("pos"), "mark")


@query("j13_glossary_terms", f"SELECT id, count(*) AS uses, CASE WHEN id = 'en' THEN 'English' WHEN id LIKE 'src%' THEN 'Source ' || id END AS term, id IN ('fr', 'src1') AS pinned FROM ({_IDS}) GROUP BY 1")
def j13(spark, sf):
    ids = load(spark, sf, "documents").select(F.explode(F.array("source", "lang", "source")).alias("id"))
    sibling = load(spark, sf, "documents").select(F.col("source").alias("id")).distinct().withColumn("term", F.concat(F.lit("Source "), "id"))
    own = spark.createDataFrame([("en", "English")], "id string, term string")
    return vocabulary.glossary_terms(ids, own, sibling, spark.createDataFrame([("fr",), ("src1",)], "id string"))


@query("j14_translate", "SELECT c_custkey, CASE WHEN n_nationkey % 2 = 0 THEN 'T-' || n_name ELSE n_name END AS place, n_name AS place_key FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j14(spark, sf):
    nation = load(spark, sf, "nation")
    rows = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("place"))
    dictionary = nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("source"), F.concat(F.lit("T-"), "n_name").alias("target"))
    return vocabulary.translate(rows, dictionary, "place")


@query("j19_line_differences", "SELECT CAST(doc_id AS VARCHAR) AS name, doc_id % 3 <> 0 AS same, CAST(0 AS BIGINT) AS removed, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS added FROM documents")
def j19(spark, sf):
    base = F.concat(F.lit("// note\nlet a = '"), F.sha2("text", 256), F.lit("';\n"))
    other = F.concat(base, F.lit("\n# more\n/* x */\n"), F.when(F.col("doc_id") % 3 == 0, F.lit("call();\n")).otherwise(F.lit("")))
    return vocabulary.line_differences(load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), base.alias("a"), other.alias("b")))


@query("u03_dedupe", "SELECT arg_min(w, i) AS w FROM (SELECT p_name AS w, p_partkey AS i FROM part UNION ALL SELECT upper(p_name), p_partkey + 1000000 FROM part) GROUP BY trim(regexp_replace(lower(strip_accents(w)), '[^a-z0-9]+', ' ', 'g'))")
def u03(spark, sf):
    part = load(spark, sf, "part")
    rows = part.select(F.col("p_name").alias("w"), F.col("p_partkey").alias("i")).union(part.select(F.upper("p_name"), F.col("p_partkey") + 1000000))
    return vocabulary.dedupe(rows, "w", "i").select("w")


@query("u05_proper_subset", "SELECT count(*) AS n FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name <> b.p_name AND starts_with(b.p_name, a.p_name || ' ')")
def u05(spark, sf):
    """Names of which another is a proper beginning: joined on their first word."""
    names = load(spark, sf, "part").select("p_name", F.split("p_name", " ")[0].alias("w")).distinct()
    other = names.withColumnRenamed("p_name", "longer")
    return names.join(other, "w").filter(F.col("longer").startswith(F.concat("p_name", F.lit(" ")))).agg(F.count(F.lit(1)).alias("n"))


@query("p22_subject_names", "SELECT r_name AS repo, unnest([r_name || ' Studies', 'RS', r_name, 'OLD']) AS name FROM region")
def p22(spark, sf):
    meta = load(spark, sf, "region").select(F.col("r_name").alias("repo"), F.concat("r_name", F.lit(" Studies (RS)")).alias("title"), F.array(F.concat(F.upper("r_name"), F.lit("  STUDIES")), F.lit("Timeline")).alias("altTitles"), F.concat(F.lit("About ("), "r_name", F.lit(") and (OLD, not)")).alias("description"))
    return vocabulary.subject_names(meta, "timeline").select("repo", "name")


@query("v06_lineage", "SELECT 'V06' AS rule, 'error' AS severity, n_name AS locator, 'unknown edge' AS message FROM nation WHERE n_nationkey % 7 = 0")
def v06(spark, sf):
    rows = load(spark, sf, "nation").select(F.col("n_name").alias("path"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 7 == 0, "odd").when(F.col("n_nationkey") % 7 == 1, "direct").alias("edge"))
    return validate.lineage(rows)


@query("v08_numbers", "SELECT 'V08' AS rule, 'error' AS severity, n_name AS locator, 'no points' AS message FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'V08', 'error', n_name, 'unit is missing' FROM nation WHERE n_nationkey % 5 = 0")
def v08(spark, sf):
    rows = load(spark, sf, "nation").select(F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 5 != 0, "people").alias("unit"), F.lit("s").alias("sourceLabel"), F.when(F.col("n_nationkey") % 4 != 0, F.array(F.lit(1))).alias("points"))
    return validate.numbers(rows)


@query("v11_markers", "SELECT 'V11' AS rule, 'error' AS severity, CAST(doc_id AS VARCHAR) AS locator, 'unknown term' AS message FROM documents WHERE lang = 'de'")
def v11(spark, sf):
    rows = load(spark, sf, "documents").select(F.col("doc_id").alias("locator"), F.col("lang").alias("term"))
    return validate.markers(rows, spark.createDataFrame([("en",), ("fr",), ("es",)], "term string"))


@query("v00_verdict", "SELECT count(*) AS checked, count(*) FILTER (n_nationkey % 7 = 0) AS errors, CAST(0 AS BIGINT) AS warnings, CAST(1 AS BIGINT) AS code FROM nation")
def v00(spark, sf):
    return validate.verdict(v06(spark, sf), load(spark, sf, "nation")).withColumn("code", F.col("code").cast("long"))


@query("p14_join_eligible", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'not capitalised' WHEN c_custkey % 3 = 1 THEN 'too short' WHEN NOT contains(c_name, ' ') THEN 'one word' END AS reason FROM customer")
def p14(spark, sf):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("a"), "c_name")).when(F.col("c_custkey") % 3 == 1, F.lit("Ab Cd")).otherwise(F.col("c_name"))
    return load(spark, sf, "customer").select("c_custkey", fold.skip_reason(name).alias("reason"))


@query("k04_markdown", "SELECT n_regionkey, '## ' || n_regionkey || chr(10) || chr(10) || string_agg('- [ ] ' || n_name, chr(10) ORDER BY n_name) AS text FROM (SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, n_name FROM nation) GROUP BY 1")
def k04(spark, sf):
    from loomstone.sources.sinks import markdown

    return markdown(load(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("n_regionkey"), "n_name"), "n_regionkey", "n_name")


@query(
    "p23_vocabulary_bundle",
    """WITH p AS (SELECT p_brand AS repo, 'names' AS section, p_partkey AS place, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS value FROM part UNION ALL SELECT p_brand, 'types', p_partkey, p_type FROM part
       UNION ALL SELECT r_name, 'places', n_nationkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'places', n_nationkey + 50, lower(n_name) FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'names', 0, ' ' FROM region),
 k AS (SELECT *, trim(regexp_replace(lower(strip_accents(value)), '[^a-z0-9]+', ' ', 'g')) AS key FROM p WHERE trim(value) <> ''), f AS (SELECT repo, section, key, min((place, value)) AS m FROM k GROUP BY ALL)
SELECT repo, section, row_number() OVER (PARTITION BY repo, section ORDER BY m[1], m[2]) AS pos, m[2] AS value FROM f""",
)
def p23(spark, sf):
    part, nation = load(spark, sf, "part"), load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    section = lambda rows, repo, pos, value: rows.select(F.col(repo).alias("repo"), pos.alias("pos"), value.alias("value"))
    names = section(part, "p_brand", F.col("p_partkey"), name).union(section(load(spark, sf, "region"), "r_name", F.lit(0), F.lit(" ")))
    places = section(nation, "r_name", F.col("n_nationkey"), F.col("n_name")).union(section(nation, "r_name", F.col("n_nationkey") + 50, F.lower("n_name")))
    return vocabulary.bundle({"names": names, "types": section(part, "p_brand", F.col("p_partkey"), F.col("p_type")), "places": places})
