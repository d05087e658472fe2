"""Queries over JSON records, mining and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions.web import strip_speaker
from loomstone.operators import mining, records, validate
from loomstone.plans.base import query
from loomstone.session import load


def _dataset(spark, sf):
    """The nations as a chronology of JSON values, one dataset per region: what the record operators read."""
    nation = load(spark, sf, "nation")
    event = F.struct(
        (F.col("n_nationkey") * 7 + 1700).alias("year"), F.concat(F.lit("About "), F.col("n_nationkey").cast("string")).alias("date"), (F.col("n_nationkey") % 2 == 0).alias("dateVerified"),
        F.concat(F.lit("Founding of "), "n_name").alias("title"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("Source to verify.")).otherwise(F.lit("Well known.")).alias("text"), F.col("n_name").alias("place"),
    )
    ref = F.struct(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("https://x.org/"), F.col("n_nationkey").cast("string")).alias("url"))
    figure = F.struct(F.concat(F.lit("Élder "), "n_name").alias("name"), F.lit("leader").alias("role"))
    note = F.struct(F.struct(F.lit("See there").alias("note"), F.array(F.struct(F.lit("Not that").alias("title"), F.lit("other").alias("text"))).alias("items")).alias("disambiguation"))
    rows = nation.groupBy(F.col("n_regionkey").cast("string").alias("repo")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", event.alias("e"), ref.alias("r"), figure.alias("f")))).alias("a"))
    pick = lambda k: F.transform("a", lambda x: x[k])
    data = F.to_json(F.struct(F.struct(F.lit("Nations").alias("title")).alias("meta"), pick("e").alias("events"), pick("r").alias("references"), pick("f").alias("figures"), note["disambiguation"].alias("disambiguation")))
    return rows.select("repo", F.parse_json(data).alias("v"))


_N = "SELECT n_nationkey AS k, n_name, CAST(n_regionkey AS VARCHAR) AS repo, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS VARCHAR) AS i FROM nation"


@query(
    "p01_records",
    f"""WITH n AS ({_N}) SELECT repo, 'events[' || i || ']' AS locator, 'Founding of ' || n_name AS id, 'About ' || k AS date FROM n UNION ALL SELECT repo, 'references[' || i || ']', 'r' || k, '-' FROM n
UNION ALL SELECT repo, 'figures[' || i || ']', 'Élder ' || n_name, '-' FROM n UNION ALL SELECT DISTINCT repo, 'disambiguation.items[0]', 'Not that', '-' FROM n""",
)
def p01(spark, sf):
    return records.records(_dataset(spark, sf)).select("repo", "locator", records.record_id().alias("id"), records.record_date().alias("date"))


@query("p04_record_text", f"WITH n AS ({_N}) SELECT repo, 'figures[' || i || ']' AS locator, 'Élder ' || n_name || ' leader' AS t FROM n")
def p04(spark, sf):
    rows = records.records(_dataset(spark, sf)).filter("collection = 'figures'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "leaf"))), lambda x: x["leaf"]), " ")
    return records.leaves(rows).filter("kind = 'STRING'").groupBy("repo", "locator").agg(text.alias("t"))


@query("p05_find", f"WITH n AS ({_N}) SELECT repo, 'figures[' || i || ']' AS locator, 'Élder ' || n_name || ' leader' AS snippet FROM n")
def p05(spark, sf):
    return records.find(records.records(_dataset(spark, sf)), "ELDER").select("repo", "locator", "snippet")


@query("p06_event", f"WITH n AS ({_N}) SELECT repo, 'events[' || i || ']' AS locator, CAST(k * 7 + 1700 AS BIGINT) AS year FROM n WHERE k * 7 + 1700 BETWEEN 1720 AND 1800")
def p06(spark, sf):
    return records.events_between(records.records(_dataset(spark, sf)), 1720, 1800).select("repo", "locator", F.col("year").cast("long").alias("year"))


@query("p07_figure", f"WITH n AS ({_N}) SELECT repo, 'Élder ' || n_name AS name FROM n WHERE contains(lower('Élder ' || n_name), 'a')")
def p07(spark, sf):
    return records.named(records.records(_dataset(spark, sf)), "Á").select("repo", "name")


@query("p08_refs", f"WITH n AS ({_N}) SELECT repo, 'r' || k AS id, k % 2 = 0 AS archived FROM n")
def p08(spark, sf):
    rows = records.records(_dataset(spark, sf))
    nation = load(spark, sf, "nation").filter("n_nationkey % 2 = 0")
    archives = nation.select(F.col("n_regionkey").cast("string").alias("repo"), F.concat(F.lit("https://x.org/"), F.col("n_nationkey").cast("string")).alias("url"))
    return records.references(rows, archives).select("repo", "id", "archived")


@query(
    "p09_flags",
    f"""WITH n AS ({_N}) SELECT repo, 'events[' || i || ']' AS locator, 'dateVerified' AS path, 'dateVerified:false' AS reason, '' AS value FROM n WHERE k % 2 <> 0
UNION ALL SELECT repo, 'events[' || i || ']', 'text', 'text:to verify', 'Source to verify.' FROM n WHERE k % 3 = 0""",
)
def p09(spark, sf):
    return records.flags(records.records(_dataset(spark, sf))).select("repo", "locator", "path", "reason", "value")


def _orders_dataset(spark, sf):
    """Five chronologies of orders as JSON: lists of more than ten events, flags of both kinds, a long text."""
    order = load(spark, sf, "orders").filter("o_custkey % 100 = 1")
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("UNVERIFIED  \n note "), F.repeat(F.lit("of it "), (key % 40).cast("int")))).when(key % 3 == 1, F.lit("date (To Verify)")).otherwise(F.lit("well known"))
    event = F.struct(key.cast("string").alias("id"), (key % 4 > 0).alias("verified"), text.alias("text"))
    rows = order.groupBy(F.concat(F.lit("r"), F.pmod("o_orderkey", F.lit(5))).alias("repo")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", event.alias("e")))).alias("a"))
    data = F.to_json(F.struct(F.transform("a", lambda x: x["e"]).alias("events")))
    return rows.select("repo", F.parse_json(data).alias("v"))


_FLAGS = """WITH o AS (SELECT o_orderkey AS k, 'r' || (o_orderkey % 5) AS repo FROM orders WHERE o_custkey % 100 = 1), e AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY k) - 1 AS i FROM o),
 t AS (SELECT *, trim(regexp_replace(CASE k % 3 WHEN 0 THEN 'UNVERIFIED  ' || chr(10) || ' note ' || repeat('of it ', CAST(k % 40 AS INTEGER)) WHEN 1 THEN 'date (To Verify)' ELSE 'well known' END, '\\s+', ' ', 'g')) AS text FROM e),
 f AS (SELECT repo, i, k, 'text' AS path, 'text:' || lower(regexp_extract(text, '(?i)\\(to verify\\)|to verify|to confirm|unverified|\\(a verificar\\)|por verificar')) AS reason, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS value FROM t WHERE k % 3 < 2
       UNION ALL SELECT repo, i, k, 'verified', 'verified:false', '' FROM t WHERE k % 4 = 0),
 p AS (SELECT *, 'events[' || i || ']' AS locator, row_number() OVER (ORDER BY repo, i, path) AS place FROM f)"""


@query("p10_worklist", f"{_FLAGS} SELECT repo, locator, path, reason, value, place FROM p")
def p10(spark, sf):
    return records.worklist(records.records(_orders_dataset(spark, sf))).select("repo", "locator", "path", "reason", "value", "place")


@query(
    "k05_worklist_report",
    f"""{_FLAGS}, r AS (SELECT repo, count(p.place) AS n FROM (SELECT DISTINCT repo FROM o UNION SELECT 'r9') d LEFT JOIN p USING (repo) GROUP BY 1),
 l AS (SELECT 0 AS a, '' AS repo, '' AS c, 0 AS b, 0 AS place, '# unverified-report | repos=' || (SELECT count(*) FROM r) || ' | flags=' || (SELECT count(*) FROM p) AS line
       UNION ALL SELECT 0, '', '', 1, 0, 'rule: dateVerified:false, verified:false, or text matching (to verify)/to confirm/unverified' UNION ALL SELECT 0, '', '', 2, 0, 'fields: locator | entity | field | reason | value'
       UNION ALL SELECT 1, repo, '', 0, 0, '' FROM r UNION ALL SELECT 1, repo, '', 1, 0, '## ' || repo || ' (chronology) — ' || n FROM r
       UNION ALL SELECT 1, repo, 'events', 0, 0, '### events (' || count(*) || ')' FROM p GROUP BY repo
       UNION ALL SELECT 1, repo, 'events', 1, place, concat_ws(' | ', locator, CAST(k AS VARCHAR), path, reason, CASE value WHEN '' THEN '-' ELSE value END) FROM p)
SELECT row_number() OVER (ORDER BY a, repo, c, b, place) AS k, line FROM l""",
)
def k05(spark, sf):
    """The report's lines; one dataset has no flags."""
    data = _orders_dataset(spark, sf)
    rows = records.records(data)
    entities = rows.select("repo", "locator", records.record_id().alias("entity"))
    found = records.worklist(rows).join(entities, ["repo", "locator"])
    datasets = data.select("repo").union(spark.createDataFrame([("r9",)], "repo string")).withColumn("kind", F.lit("chronology"))
    return records.worklist_report(datasets, found).select("k", "line")


@query("a03_stats", f"WITH n AS ({_N}) SELECT repo, c AS collection, CASE WHEN c = 'disambiguation' THEN 1 ELSE count(*) END AS n FROM n, (VALUES ('events'), ('references'), ('figures'), ('disambiguation')) t(c) GROUP BY 1, 2")
def a03(spark, sf):
    return records.stats(records.records(_dataset(spark, sf)))


@query("p18_translatable", "SELECT 'Founding of ' || n_name AS text FROM nation UNION SELECT n_name FROM nation UNION SELECT 'Not that'")
def p18(spark, sf):
    rows = records.records(_dataset(spark, sf))
    return records.translatable(rows, ["title"], {"nothing": []})


@query("a10_places", f"WITH n AS ({_N}) SELECT n_name AS place, count(*) AS n, 'events.place' AS fields FROM n GROUP BY 1")
def a10(spark, sf):
    return records.places(records.records(_dataset(spark, sf))).select("place", "n", F.array_join("fields", ",").alias("fields"))


@query("k02_pipe_rows", f"WITH n AS ({_N}) SELECT 'Founding of ' || n_name || ' | About ' || k || ' | -' AS line FROM n")
def k02(spark, sf):
    rows = records.records(_dataset(spark, sf)).filter("collection = 'events'").select(records.record_id().alias("id"), records.record_date().alias("date"), F.lit(None).cast("int").alias("none"))
    return records.pipe_rows(rows, ["id", "date", "none"])


@query(
    "k03_envelope",
    """WITH n AS (SELECT 'Founding of ' || n_name AS id FROM nation), r AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM n)
SELECT 0 AS part, CAST(0 AS BIGINT) AS k, '{"repo":"nations","kind":"chronology","subcommand":"event","count":' || count(*) || ',"fields":["id"],"rows":[' AS line FROM n
UNION ALL SELECT 1, k, CASE WHEN k > 1 THEN ',' ELSE '' END || '{"id":"' || id || '"}' FROM r UNION ALL SELECT 2, 0, ']}'""",
)
def k03(spark, sf):
    rows = records.records(_dataset(spark, sf)).filter("collection = 'events'").select(records.record_id().alias("id"))
    return records.envelope(rows, "nations", "chronology", "event", ["id"])


@query("r02_event_props", "SELECT k AS name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def r02(spark, sf):
    """Keys of the events' JSON, by opening each VARIANT."""
    rows = load(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("rec"))
    return records.leaves(rows).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# ---- mining ----

_W = "regexp_split_to_array(text, '[^\\p{L}\\p{N}_''’-]+')"


@query("a18_lowercase", f"SELECT lower(strip_accents(w)) AS token, count(*) AS n FROM (SELECT unnest({_W}) AS w FROM documents) WHERE regexp_matches(w, '^\\p{{Ll}}') GROUP BY 1")
def a18(spark, sf):
    return mining.lowercase_counts(load(spark, sf, "documents"))


def _vote(lang: str) -> str:
    low = "(' ' || lower(substr(text, 1, 20000)) || ' ')"
    count = lambda w: f"(length({low}) - length(replace({low}, '{w.replace(chr(39), chr(39) * 2)}', ''))) / {len(w)}"
    return " + ".join([count(w) for w in mining.MARKERS[lang]] + [f"3 * {count(w)}" for w in mining.EXCLUSIVE[lang]])


@query("a20_language", f"SELECT doc_id, CASE WHEN en >= es AND en >= pt THEN 'en' WHEN es >= pt THEN 'es' ELSE 'pt' END AS language FROM (SELECT doc_id, {_vote('en')} AS en, {_vote('es')} AS es, {_vote('pt')} AS pt FROM documents)")
def a20(spark, sf):
    return load(spark, sf, "documents").select("doc_id", mining.language(F.col("text")).alias("language"))


def _dated(spark, sf):
    """Documents in three languages by turns, each behind a sentence with a date, a number and an attribution, since the plain ones hold few."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    year = (F.col("doc_id") % 200 + 1800).cast("string")
    said = {
        "en": F.concat(F.lit(" It was in "), year, F.lit(" that he said 40% had left. ")),
        "pt": F.concat(F.lit(" Foi em julho de "), year, F.lit(" que ele disse que 600 pessoas partiram. ")),
        "es": F.concat(F.lit(" Fue el 3 de mayo de "), year, F.lit(" y dijo que eran 2 mil personas. ")),
    }
    turn = F.coalesce(F.col("doc_id"), F.lit(0)) % 3
    lang = F.when(turn == 0, "en").when(turn == 1, "pt").otherwise("es")
    front = F.when(turn == 0, said["en"]).when(turn == 1, said["pt"]).otherwise(said["es"])
    return docs.select("doc_id", lang.alias("lang"), F.concat(front, F.coalesce("text", F.lit(""))).alias("text"))


@query("t01_dated")
def t01(spark, sf):
    return mining.scan(_dated(spark, sf), "dated")


@query("t03_numbers")
def t03(spark, sf):
    return mining.scan(_dated(spark, sf), "number")


@query("t04_quotes")
def t04(spark, sf):
    return mining.scan(_dated(spark, sf), "quote")


@query("t05_sheet")
def t05(spark, sf):
    return mining.sheet(_dated(spark, sf))


@query("a19_names")
def a19(spark, sf):
    """Names of whole conversations; one, spelled in two ways, is added to each."""
    turns = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    said = F.concat_ws("\n", F.transform("t", lambda x: x["text"]), F.lit(">> Later we met Marcel Lefebvre there, and Marcel Lefevre of the town."))
    return mining.names(turns.select("conv_id", said.alias("text")), "conv_id")


@query("x23_strip_speaker", "SELECT conv_id, turn, sha256(replace('>> ' || text, '>>', '  ')) AS digest FROM conversations")
def x23(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", F.sha2(strip_speaker(F.concat(F.lit(">> "), "text")), 256).alias("digest"))


# ---- validation ----


def _out(found):
    return found.select("rule", "severity", "locator", "message")


@query("v01_meta", "SELECT 'V01' AS rule, 'error' AS severity, n_name AS locator, 'lastUpdated is no date' AS message FROM nation WHERE n_nationkey % 4 = 0")
def v01(spark, sf):
    rows = load(spark, sf, "nation").select(F.col("n_name").alias("repo"), F.lit("t").alias("title"), F.lit("d").alias("description"), F.lit("en").alias("language"), F.when(F.col("n_nationkey") % 4 != 0, "2024-01-02").otherwise("soon").alias("lastUpdated"))
    return _out(validate.meta(rows))


@query(
    "v02_references",
    """SELECT 'V02' AS rule, 'error' AS severity, CAST(page_id AS VARCHAR) AS locator, 'publisher is missing' AS message FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 'V02', 'error', CAST(page_id AS VARCHAR), 'url is no http(s) URL' FROM pages WHERE NOT regexp_matches(url, '^https?://')
UNION ALL SELECT 'V02', 'error', id, 'duplicate id' FROM (SELECT CAST(page_id // 2 AS VARCHAR) AS id FROM pages GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'V13', 'warning', CAST(page_id AS VARCHAR), 'unknown type' FROM pages WHERE page_id % 3 = 0""",
)
def v02(spark, sf):
    rows = load(spark, sf, "pages").select(F.col("page_id").alias("locator"), F.floor(F.col("page_id") / 2).cast("string").alias("id"), "url", F.when(F.col("page_id") % 5 != 0, "P").alias("publisher"), F.when(F.col("page_id") % 3 == 0, "odd").otherwise("web").alias("type"))
    return _out(validate.references(rows, ["web", "book"]))


@query(
    "v03_sources",
    """SELECT 'V03' AS rule, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS locator, 'unknown source' AS message FROM orders WHERE o_custkey % 9 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'V03', 'error', CAST(o_orderkey AS VARCHAR), 'no source' FROM orders WHERE o_custkey % 9 = 0""",
)
def v03(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("locator"), F.when(F.col("o_custkey") % 9 != 0, F.array(F.col("o_custkey").cast("string"), F.lit("https://x.org"))).alias("sources"))
    return _out(validate.sources(rows, load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))))


@query(
    "v04_events",
    """SELECT 'V04' AS rule, 'error' AS severity, CAST(o_orderkey AS VARCHAR) AS locator, 'year out of bounds' AS message FROM orders WHERE year(o_orderdate) >= 2000
UNION ALL SELECT 'V04', 'error', CAST(o_orderkey AS VARCHAR), 'dateVerified is no boolean' FROM orders WHERE o_orderstatus = 'P'""",
)
def v04(spark, sf):
    year = F.year("o_orderdate")
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").alias("locator"), F.when(year < 2000, year).otherwise(year + 200).alias("year"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") != "P", F.lit(True)).alias("dateVerified"))
    return _out(validate.events(rows))


@query(
    "v05_lanes",
    """SELECT 'V05' AS rule, 'error' AS severity, 'Two Words' AS locator, 'id is not kebab-case' AS message UNION ALL SELECT 'V05', 'error', 'a-b', 'duplicate lane'
UNION ALL SELECT 'V05', 'error', 'bare', 'label or basis is missing' UNION ALL SELECT 'V05', 'error', CAST(event_id AS VARCHAR), 'unknown lane' FROM events WHERE event_type <> 'click'""",
)
def v05(spark, sf):
    lanes = spark.createDataFrame([("click", "l", "b"), ("Two Words", "l", "b"), ("a-b", "l", "b"), ("a-b", "l", "b"), ("bare", "l", None)], "lane string, label string, basis string")
    return _out(validate.lanes(lanes, load(spark, sf, "events").select(F.col("event_id").alias("locator"), F.array("event_type").alias("threads"))))


@query("v07_branches", "SELECT 'V07' AS rule, 'error' AS severity, n_name AS locator, 'parent is no earlier branch' AS message FROM nation WHERE n_nationkey < 24 AND n_nationkey % 5 = 0")
def v07(spark, sf):
    nation = load(spark, sf, "nation")
    later = nation.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("next"))
    rows = nation.join(later, "n_nationkey", "left").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id"), F.lit(1950).alias("year"), F.when(F.col("n_nationkey") % 5 == 0, F.col("next")).otherwise("trunk").alias("parent"))
    return _out(validate.branch_rows(rows, 1900, 2000))


@query(
    "v09_gazetteer",
    """SELECT 'V09' AS rule, 'error' AS severity, CAST(n_nationkey AS VARCHAR) AS locator, 'coordinates without source' AS message FROM nation WHERE n_nationkey % 6 = 0
UNION ALL SELECT 'V09', 'error', CAST(n_nationkey AS VARCHAR), 'coordinates out of range' FROM nation WHERE n_nationkey * 10.0 > 90""",
)
def v09(spark, sf):
    rows = load(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("place_id"), F.lit("country").alias("kind"), F.lit("settlement").alias("precision"), (F.col("n_nationkey") * 10.0).alias("lat"), F.lit(0.0).alias("lon"), F.when(F.col("n_nationkey") % 6 != 0, "s").alias("source"))
    return _out(validate.gazetteer(rows))


@query(
    "v10_tiers",
    """SELECT 'V10' AS rule, 'error' AS severity, substr(n_name, 1, 2) AS locator, 'duplicate code' AS message FROM nation GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT 'V10', 'error', substr(n_name, 1, 2), 'unknown tier' FROM nation WHERE n_regionkey > 3
UNION ALL SELECT 'V10', 'error', substr(n_name, 1, 2), 'no ISO code' FROM nation WHERE NOT regexp_full_match(substr(n_name, 1, 2), '[A-Z]{2}')""",
)
def v10(spark, sf):
    tiers = load(spark, sf, "region").filter("r_regionkey <= 3").select(F.col("r_regionkey").alias("tier"))
    return _out(validate.tiers(tiers, load(spark, sf, "nation").select(F.substring("n_name", 1, 2).alias("code"), F.col("n_regionkey").alias("tier"))))


@query("v12_ladder", "SELECT 'V12' AS rule, 'error' AS severity, CAST(n_nationkey AS VARCHAR) AS locator, 'unknown status' AS message FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'V12', 'error', CAST(n_nationkey AS VARCHAR), 'neither cited nor without document' FROM nation WHERE n_nationkey % 4 = 0")
def v12(spark, sf):
    rows = load(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 3 == 0, "odd").otherwise("approved").alias("status"), F.when(F.col("n_nationkey") % 4 != 0, F.array(F.lit("s"))).alias("sources"), F.lit(None).cast("boolean").alias("noDocument"))
    return _out(validate.ladder(rows))


@query("v14_publishers", "SELECT 'V14' AS rule, 'error' AS severity, CAST(s_suppkey AS VARCHAR) AS locator, 'publisher ends in a note' AS message FROM supplier WHERE s_suppkey % 2 = 0")
def v14(spark, sf):
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("locator"), F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, " (second edition)").otherwise(" (Rome)")).alias("publisher"))
    return _out(validate.publishers(rows))


@query(
    "v15_corpus_shape",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS locator, trim(text) AS t, text FROM documents)
SELECT 'V15' AS rule, 'error' AS severity, locator, 'too small' AS message FROM d WHERE length(t) < 40
UNION ALL SELECT 'V15', 'warning', locator, 'ends within a sentence' FROM d WHERE length(t) > 0 AND NOT regexp_matches(t, '[.!?…"''”)\\]]$')""",
)
def v15(spark, sf):
    return _out(validate.corpus_shape(load(spark, sf, "documents")))
