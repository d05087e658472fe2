"""Records of nested JSON datasets: addressable rows, text search, flags, translatable strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.dates import event_year
from loomstone.functions.fold import deaccent
from loomstone.operators import ordered

LISTS = ["facts", "events", "figures", "organizations", "references", "terms"]
SECTIONS = ["disambiguation", "lineage", "episcopalLineage", "branchTimeline", "numbersChart"]
ID_KEYS = ["id", "title", "name", "term", "label", "heading"]
DATE_KEYS = ["date", "dates", "year", "founded", "start"]
PLACE_KEYS = ["place", "country", "location", "birthplace"]
# Phrases that say that something is not verified.
UNSURE_PHRASES = ["(to verify)", "to verify", "to confirm", "unverified", "(a verificar)", "por verificar"]
UNSURE = "(?i)" + "|".join(re.escape(p) for p in UNSURE_PHRASES)
#: Characters of a flagged value that are shown.
CLIP = 120
#: Levels of a record opened between two looks at whether any is left.
STEP = 4


def records(data: DataFrame) -> DataFrame:
    """(repo, collection, idx, locator, rec) of VARIANT datasets (repo, v).

    Items of lists are ``events[3]``; values of sections ``name.key``, and those
    in lists there ``name.key[i]``. An absent collection gives no rows.
    """
    found = None
    for name in LISTS:
        own = data.select("repo", F.expr(f"try_variant_get(v, '$.{name}', 'array<variant>')").alias("a")).filter("a is not null")
        own = own.select("repo", F.lit(name).alias("collection"), F.posexplode("a").alias("idx", "rec"))
        own = own.filter(F.expr("schema_of_variant(rec) like 'OBJECT%'")).withColumn("locator", F.format_string("%s[%d]", "collection", "idx"))
        found = own if found is None else found.unionByName(own)
    for name in SECTIONS:
        own = data.select("repo", F.expr(f"try_variant_get(v, '$.{name}', 'map<string,variant>')").alias("m")).filter("m is not null").select("repo", F.explode("m").alias("key", "item"))
        listed = own.select("repo", "key", F.expr("try_variant_get(item, '$', 'array<variant>')").alias("a")).filter("a is not null").select("repo", "key", F.posexplode("a").alias("idx", "rec"))
        listed = listed.filter(F.expr("schema_of_variant(rec) like 'OBJECT%'"))
        single = own.filter(F.expr("schema_of_variant(item) like 'OBJECT%'")).select("repo", "key", F.lit(0).alias("idx"), F.col("item").alias("rec"))
        listed = listed.withColumn("locator", F.format_string("%s.%s[%d]", F.lit(name), "key", "idx"))
        single = single.withColumn("locator", F.format_string("%s.%s", F.lit(name), "key"))
        both = listed.unionByName(single).withColumn("collection", F.lit(name)).drop("key")
        found = found.unionByName(both)
    return found.select("repo", "collection", "idx", "locator", "rec")


def text_field(rec: str, key: str) -> Column:
    return F.expr(f"try_variant_get({rec}, '$.{key}', 'string')")


def record_id(rec: str = "rec") -> Column:
    """The first non-blank string of the naming keys, else ``-``."""
    named = [F.when(F.expr(f"schema_of_variant(try_variant_get({rec}, '$.{k}', 'variant')) = 'STRING'"), F.nullif(F.trim(text_field(rec, k)), F.lit(""))) for k in ID_KEYS]
    return F.coalesce(*named, F.lit("-"))


def record_date(rec: str = "rec") -> Column:
    return F.coalesce(*[F.nullif(text_field(rec, k), F.lit("")) for k in DATE_KEYS], F.lit("-"))


def leaves(rows: DataFrame, value: str = "rec") -> DataFrame:
    """``rows`` with a row for each scalar within ``value``: path, name, kind and leaf.

    One chain of explodes carries the scalars along while containers are
    opened, ``STEP`` levels between two looks at whether one is left; no depth
    is too great. ``name`` is the nearest key; items of a list have their list's.
    """
    keep = [c for c in rows.columns if c != value]
    level = rows.select(*keep, F.col(value).alias("v"), F.lit("").alias("path"), F.lit("").alias("name"), F.expr(f"schema_of_variant({value})").alias("kind"))
    inner = "kind like 'OBJECT%' or kind like 'ARRAY%'"
    entry = lambda k, i, v: F.struct(k.cast("string").alias("k"), i.cast("int").alias("i"), v.alias("v"))
    none = F.lit(None)
    members = F.transform(F.map_entries(F.expr("try_variant_get(v, '$', 'map<string,variant>')")), lambda e: entry(e["key"], none, e["value"]))
    items = F.transform(F.expr("try_variant_get(v, '$', 'array<variant>')"), lambda x, i: entry(none, i, x))
    opened = F.when(F.col("kind").startswith("OBJECT"), members).when(F.col("kind").startswith("ARRAY"), items).otherwise(F.array(entry(none, none, F.col("v"))))
    key = F.when(F.col("path") == "", F.col("e.k")).otherwise(F.concat_ws(".", "path", "e.k"))
    path = F.when(F.col("e.k").isNotNull(), key).when(F.col("e.i").isNotNull(), F.format_string("%s[%d]", "path", "e.i")).otherwise(F.col("path"))
    while not level.filter(inner).isEmpty():
        for _ in range(STEP):
            inside = level.select(*keep, "path", "name", F.explode(opened).alias("e"))
            level = inside.select(*keep, F.col("e.v").alias("v"), path.alias("path"), F.coalesce("e.k", "name").alias("name"), F.expr("schema_of_variant(e.v)").alias("kind"))
    return level.filter("kind is not null").filter(f"not ({inner})").select(*keep, "path", "name", "kind", F.expr("try_variant_get(v, '$', 'string')").alias("leaf"))


def find(rows: DataFrame, word: str) -> DataFrame:
    """Records that hold ``word``, accents and case aside: with their text's first 140 characters around it."""
    strings = leaves(rows).filter("kind = 'STRING'")
    keys = [c for c in rows.columns if c != "rec"]
    text = strings.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "leaf"))), lambda x: x["leaf"]).alias("t")).withColumn("t", F.array_join("t", " "))
    at = F.instr(F.lower(deaccent(F.col("t"))), F.lower(deaccent(F.lit(word))))
    return text.filter(at > 0).withColumn("snippet", snippet(F.col("t"), at)).drop("t")


def snippet(text: Column, at: Column, width: int = 140) -> Column:
    """``width`` characters, a third of them before place ``at`` (from 1), with marks where text is cut."""
    start = F.greatest(at - 1 - width // 3, F.lit(0))
    cut = F.substring(text, start + 1, F.lit(width))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), cut, F.when(start + width < F.length(text), F.lit("…")).otherwise(F.lit("")))


def events_between(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """Events of a range of years, with ``year``."""
    own = rows.filter("collection = 'events'").withColumn("year", event_year(text_field("rec", "year"), text_field("rec", "date")))
    return own.filter(F.col("year").between(lo, hi))


def named(rows: DataFrame, word: str) -> DataFrame:
    """Figures and organizations whose name holds ``word``, accents and case aside."""
    own = rows.filter("collection in ('figures', 'organizations')").withColumn("name", text_field("rec", "name"))
    return own.filter(F.lower(deaccent(F.col("name"))).contains(F.lower(deaccent(F.lit(word)))))


def references(rows: DataFrame, archives: DataFrame) -> DataFrame:
    """References with ``archived``: whether (repo, url) is among the snapshots."""
    refs = rows.filter("collection = 'references'").select("repo", "idx", text_field("rec", "id").alias("id"), text_field("rec", "title").alias("title"), text_field("rec", "url").alias("url"))
    return refs.join(archives.select("repo", "url", F.lit(True).alias("archived")).distinct(), ["repo", "url"], "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


def clipped(text: Column, width: int = CLIP) -> Column:
    """A text on one line, cut to ``width`` characters with a mark."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def flags(rows: DataFrame) -> DataFrame:
    """Fields that say they are unverified: (…, path, reason, value); the reason names the key or the phrase, the value is that of a text."""
    false = F.col("name").isin("dateVerified", "verified") & (F.col("kind") == "BOOLEAN") & (F.col("leaf") == "false")
    said = (F.col("kind") == "STRING") & F.col("leaf").rlike(UNSURE)
    reason = F.when(false, F.concat("name", F.lit(":false"))).when(said, F.concat(F.lit("text:"), F.lower(F.regexp_extract("leaf", UNSURE, 0))))
    found = leaves(rows).withColumn("reason", reason).filter("reason is not null")
    return found.withColumn("value", F.when(said, clipped(F.col("leaf"))).otherwise(F.lit(""))).drop("kind", "leaf", "name")


def natural(locator: Column) -> Column:
    """A key by which ``events[9]`` comes before ``events[24]``: numbers of up to 20 digits have as many."""
    return F.regexp_replace(F.regexp_replace(locator, r"(\d+)", "00000000000000000000$1"), r"\d*(\d{20})(?!\d)", "$1")


def worklist(rows: DataFrame) -> DataFrame:
    """Flags with ``place``, from 1: by repository, collection, locator in natural order, and path."""
    return ordered.numbered(flags(rows).withColumn("_key", natural(F.col("locator"))), ["repo", "collection", "_key", "path"], "place").drop("_key")


def worklist_report(datasets: DataFrame, found: DataFrame) -> DataFrame:
    """(part, k, line) of a text report on ``datasets`` (repo, kind) and their flags ``found`` (of :func:`worklist`, with ``entity``): for :func:`sinks.write_lines`."""
    total = datasets.agg(F.count(F.lit(1)).alias("repos")).join(found.agg(F.count(F.lit(1)).alias("flags")))
    keys = lambda *k: [x.alias(n) for x, n in zip(k, ("a", "repo", "collection", "b", "place"), strict=True)]
    none, no = F.lit(""), F.lit(0).cast("long")
    intro = F.array(
        F.concat(F.lit("# unverified-report | repos="), "repos", F.lit(" | flags="), "flags"),
        F.lit("rule: dateVerified:false, verified:false, or text matching (to verify)/to confirm/unverified"),
        F.lit("fields: locator | entity | field | reason | value"),
    )
    head = total.select(F.posexplode(intro).alias("i", "line")).select(*keys(F.lit(0), none, none, F.col("i"), no), "line")
    counts = datasets.join(found.groupBy("repo").agg(F.count(F.lit(1)).alias("n")), "repo", "left")
    heading = F.array(none, F.concat(F.lit("## "), "repo", F.lit(" ("), "kind", F.lit(") — "), F.coalesce("n", F.lit(0))))
    repos = counts.select("repo", F.posexplode(heading).alias("i", "line")).select(*keys(F.lit(1), F.col("repo"), none, F.col("i"), no), "line")
    groups = found.groupBy("repo", "collection").agg(F.count(F.lit(1)).alias("n"))
    parts = groups.select(*keys(F.lit(1), F.col("repo"), F.col("collection"), F.lit(0), no), F.concat(F.lit("### "), "collection", F.lit(" ("), "n", F.lit(")")).alias("line"))
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    rows = found.select(*keys(F.lit(1), F.col("repo"), F.col("collection"), F.lit(1), F.col("place")), F.concat_ws(" | ", "locator", "entity", shown("path"), "reason", shown("value")).alias("line"))
    lines = ordered.numbered(head.unionByName(repos).unionByName(parts).unionByName(rows), ["a", "repo", "collection", "b", "place"], "k")
    return lines.select(F.lit(0).alias("part"), "k", "line")


def stats(rows: DataFrame) -> DataFrame:
    """(repo, collection, n) for each collection there is."""
    return rows.groupBy("repo", "collection").agg(F.count(F.lit(1)).alias("n"))


def translatable(rows: DataFrame, general: list[str], subtrees: dict[str, list[str]]) -> DataFrame:
    """Distinct strings under an allowed key: those of ``general``, or within a subtree its own list."""
    allowed = F.col("name").isin(general)
    for tree, keys in subtrees.items():
        allowed = F.when(F.col("path").rlike(rf"(^|\.){re.escape(tree)}(\.|\[|$)"), F.col("name").isin(keys)).otherwise(allowed)
    return leaves(rows).filter("kind = 'STRING'").filter(allowed & (F.trim("leaf") != "")).select(F.col("leaf").alias("text")).distinct()


def places(rows: DataFrame) -> DataFrame:
    """(place, n, fields): strings under a place key, the most frequent first."""
    own = leaves(rows).filter("kind = 'STRING'").filter(F.col("name").isin(PLACE_KEYS))
    return own.groupBy(F.col("leaf").alias("place")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.concat_ws(".", "collection", "name"))).alias("fields")).orderBy(F.desc("n"), "place")


def pipe_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows as text: fields with a pipe between them, ``-`` for nothing."""
    return df.select(F.concat_ws(" | ", *[F.coalesce(F.col(f).cast("string"), F.lit("-")) for f in fields]).alias("line"))


def envelope(df: DataFrame, repo: str, kind: str, command: str, order: list[str]) -> DataFrame:
    """(part, k, line) of one JSON document with scope, count, fields and rows in ``order``, a row a line: for :func:`sinks.write_lines`.

    Lines after the first row begin with the comma, so that each row is a line
    of its own task and none waits for the last.
    """
    placed = ordered.numbered(df, order, "_n")
    scope = F.to_json(F.struct(F.lit(repo).alias("repo"), F.lit(kind).alias("kind"), F.lit(command).alias("subcommand"), F.count(F.lit(1)).alias("count"), F.array(*map(F.lit, df.columns)).alias("fields")))
    head = df.agg(scope.alias("s")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.concat(F.regexp_replace("s", r"\}$", ""), F.lit(',"rows":[')).alias("line"))
    comma = F.when(F.col("_n") > 1, ",").otherwise("")
    rows = placed.select(F.lit(1).alias("part"), F.col("_n").alias("k"), F.concat(comma, F.to_json(F.struct(*df.columns))).alias("line"))
    end = df.sparkSession.createDataFrame([(2, 0, "]}")], "part int, k long, line string")
    return head.unionByName(rows).unionByName(end)

