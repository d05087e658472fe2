"""Checks across datasets and over dated sequences: order, witnesses, divergence, places, drift, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.dates import COURSE_DAY, off_cadence, weekday_name
from loomstone.operators import ordered
from loomstone.operators.textflow import tokens

#: Keys of quotes that are broadcast; more are joined.
KEYS = 4096
#: Days off from which an anomaly in a neighbour's month is a slip of the year.
YEAR_SLIP = 300

# What each affiliation is called.
AFFILIATION = {
    "member": r"\bmembers?\b|\bmembros?\b|\bmiembros?\b",
    "follower": r"\bfollowers?\b|\bseguidor(?:es)?\b|\bdisciples?\b|\bdisc[ií]pulos?\b",
    "adjacent": r"\badjacent\b|\badjacente\b|\bassociated\b|\bassociado\b|\bally\b|\baliado\b|\bfellow[- ]traveller\b",
    "initiate": r"\binitiat(?:e|ed|ion)\b|\biniciad[oa]\b|\binicia[cç][aã]o\b|\bmuqaddam\b",
    "professor": r"\bprofessors?\b|\bacad[eê]mic[oa]?\b|\bscholar\b|\blecturer\b",
    "founder": r"\bfounders?\b|\bfundador(?:a|es)?\b|\bfounded\b|\bfundou\b",
    "leader": r"\bsuperior general\b|\bshaykh\b|\bleader\b|\bl[ií]der\b|\bpresident\b|\bpresidente\b",
    "critic": r"\bcritic\b|\bcr[ií]tico\b|\bopponent\b|\badvers[aá]rio\b",
}
# Labels that a denial before them turns round, and the denials.
NEGATABLE = ("member", "follower", "initiate", "adjacent")
DENIAL = r"\b(?:never|not|no longer|nunca|n[aã]o|jamais|neither)\b[^.;:]{0,24}"


def affiliation_terms(text: Column) -> Column:
    """Sorted labels that a description asserts; ``!label`` where every mention is denied."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    found = []
    for label, pattern in AFFILIATION.items():
        hits = F.regexp_count(flat, F.lit(f"(?iU)(?:{pattern})"))
        own = F.when(hits > 0, F.lit(label))
        if label in NEGATABLE:
            # A mark in place of each mention; a denial reaches the mention after it.
            marked = F.regexp_replace(flat, f"(?iU)(?:{pattern})", "\x01")
            denied = F.regexp_count(marked, F.lit(rf"(?iU)(?<={DENIAL})\x01"))
            own = F.when((hits > 0) & (denied == hits), F.lit(f"!{label}")).when(hits > 0, F.lit(label))
        found.append(own)
    return F.array_sort(F.array_compact(F.array(*found)))


def shared_entities(rows: DataFrame, least: int = 2) -> DataFrame:
    """(key, repos): keys that ``least`` repositories have, from (repo, key)."""
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("repo")).alias("repos")).filter(F.size("repos") >= least)


def divergence(rows: DataFrame, least: int = 2) -> DataFrame:
    """(key, repos, status) from (repo, key, terms), terms being an array of labels.

    contradiction if one repository asserts what another denies, differs if two
    that have labels have others, else ok.
    """
    shared = shared_entities(rows, least).select("key", F.size("repos").alias("repos"))
    labels = rows.select("repo", "key", F.explode("terms").alias("term")).distinct()
    bare = labels.withColumn("label", F.ltrim(F.col("term"), F.lit("!")))
    sides = bare.groupBy("key", "label").agg(
        F.collect_set(F.when(F.col("term").startswith("!"), F.col("repo"))).alias("denied"),
        F.collect_set(F.when(~F.col("term").startswith("!"), F.col("repo"))).alias("claimed"),
    )
    # A contradiction needs two repositories.
    against = (F.size("denied") > 0) & (F.size("claimed") > 0) & (F.size(F.array_union("denied", "claimed")) > 1)
    clash = sides.filter(against).select("key").distinct().withColumn("clash", F.lit(True))
    per_row = rows.filter(F.size("terms") > 0).select("repo", "key", F.array_join(F.array_sort(F.array_distinct("terms")), ",").alias("set"))
    range_ = per_row.groupBy("key").agg(F.min("set").alias("lo"), F.max("set").alias("hi"), F.count_distinct("repo").alias("n"))
    found = shared.join(clash, "key", "left").join(range_, "key", "left")
    status = F.when(F.col("clash"), F.lit("contradiction")).when((F.col("n") > 1) & (F.col("lo") != F.col("hi")), F.lit("differs")).otherwise(F.lit("ok"))
    return found.select("key", "repos", status.alias("status"))


def neighbour_anomalies(seq: DataFrame, part: list[str] | None = None) -> DataFrame:
    """Dates out of order with both neighbours, from (n, d): (n, d, prev, next, off_by, kind).

    ``part`` names columns that split the sequence; without it, it is one sequence, scanned by ranges. Rows without date are left out.
    """
    around = nearest_dated(seq.filter("d is not null and n is not null"), part).withColumnsRenamed({"lo": "prev", "hi": "next"})
    odd = around.filter("prev is not null and next is not null and prev <= next and not (d between prev and next)")
    off = F.least(F.abs(F.datediff("d", "prev")), F.abs(F.datediff("d", "next")))
    month = (F.month("d") == F.month("prev")) | (F.month("d") == F.month("next"))
    kind = F.when((F.col("off_by") >= YEAR_SLIP) & month, F.lit("probable-year-typo")).otherwise(F.lit("ordering-anomaly"))
    return odd.withColumn("off_by", off).withColumn("kind", kind)


def _around(part: list[str]) -> tuple[Window, Window]:
    """The rows before each one, and those after it, by the opposite order: both frames only grow."""
    frame = lambda *order: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame(F.asc_nulls_first("n"), F.asc_nulls_first("d")), frame(F.desc_nulls_last("n"), F.desc_nulls_last("d"))


def nearest_dated(seq: DataFrame, part: list[str] | None = None) -> DataFrame:
    """``seq`` with ``lo`` and ``hi``: the nearest dates before and after, the row itself left out; without ``part`` along one order, by ranges."""
    if not part:
        return ordered.nearest(seq, ["n"], "d")
    before, after = _around(part)
    return seq.withColumns({"lo": F.last("d", ignorenulls=True).over(before), "hi": F.last("d", ignorenulls=True).over(after)})


def fits(value: Column) -> Column:
    """Whether a date fits between ``lo`` and ``hi``; null where these can't judge."""
    usable = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi")) & value.isNotNull()
    return F.when(usable, value.between(F.col("lo"), F.col("hi")))


def adjudicate(seq: DataFrame, part: list[str] | None = None) -> DataFrame:
    """``seq`` of (n, d, index_d) with ``verdict``: header, index or undecided."""
    near = nearest_dated(seq, part)
    header, index = F.coalesce(fits(F.col("d")), F.lit(False)), F.coalesce(fits(F.col("index_d")), F.lit(False))
    return near.withColumn("verdict", F.when(header & ~index, F.lit("header")).when(index & ~header, F.lit("index")).otherwise(F.lit("undecided")))


def compare_witnesses(seq: DataFrame, witnesses: list[str], part: list[str] | None = None) -> DataFrame:
    """Rows whose header and index dates differ, with what each further witness says; witnesses never decide."""
    rows = adjudicate(seq, part).filter("d is not null and index_d is not null and d <> index_d")
    rows = rows.withColumn("off_by", F.abs(F.datediff("d", "index_d")))
    for w in witnesses:
        c = F.col(w)
        match = F.when(c.isNull(), F.lit(None)).when(c == F.col("d"), F.lit("header")).when(c == F.col("index_d"), F.lit("index")).otherwise(F.lit("neither"))
        rows = rows.withColumns({f"{w}_matches": match, f"{w}_fits": fits(c)})
    named = [("header", "d"), ("index", "index_d"), *((w, w) for w in witnesses)]
    on = F.array_compact(F.array(*[F.when(F.weekday(c) == COURSE_DAY, F.lit(k)) for k, c in named]))
    return rows.withColumn("on_cadence", F.array_join(on, ","))


def cadence(docs: DataFrame) -> DataFrame:
    """Dates off the course's weekday, from (id, n, d, candidate): the header's, else the candidate's."""
    kind = F.when(off_cadence(F.col("d")), F.lit("header")).when(off_cadence(F.col("candidate")), F.lit("candidate"))
    rows = docs.withColumn("kind", kind).filter("kind is not null").withColumn("date", F.when(F.col("kind") == "header", F.col("d")).otherwise(F.col("candidate")))
    return rows.select("id", "n", "date", "kind", weekday_name(F.col("date")).alias("weekday"))


def single_date(rows: DataFrame) -> DataFrame:
    """(n, d) for those n that have exactly one distinct date."""
    return rows.filter("d is not null").groupBy("n").agg(F.count_distinct("d").alias("k"), F.min("d").alias("d")).filter("k = 1").select("n", "d")


def resolve_places(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``rows`` with a row for each part of ``place``, split at `` / `` alone: part and place_id (null if unknown)."""
    named = gazetteer.select("place_id", F.explode(F.concat(F.array("name"), F.coalesce("variants", F.expr("cast(array() as array<string>)")))).alias("v"))
    index = named.select("place_id", F.lower("v").alias("key")).distinct()
    parts = rows.withColumn("part", F.explode(F.split("place", " / "))).withColumn("part", F.trim("part")).filter("part <> ''")
    return parts.join(index, F.lower("part") == F.col("key"), "left").drop("key")


def verify_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """``quotes`` (quote, doc_id) with ``verdict``: verified, NOT-LITERAL, incomplete or file-missing."""
    found = quotes.join(docs.select("doc_id", "text"), "doc_id", "left")
    verdict = (
        F.when(F.col("quote").isNull() | F.col("doc_id").isNull(), F.lit("incomplete"))
        .when(F.col("text").isNull(), F.lit("file-missing"))
        .when(F.col("text").contains(F.col("quote")), F.lit("verified"))
        .otherwise(F.lit("NOT-LITERAL"))
    )
    return found.withColumn("verdict", verdict).drop("text")


def holding(docs: DataFrame, quotes: DataFrame, width: int = 3) -> DataFrame:
    """(item_id, doc_id): which documents (doc_id, text) hold which quotes (item_id, quote) literally; empty quotes are in none.

    Blocked on the first words, ``width`` at most, that a quote holds between
    its first and its last one, which may be parts of words; a quote without
    such words is blocked on its first characters. Candidates are confirmed.
    Up to KEYS keys are broadcast, and meet each document's windows within its
    row, so that texts are read once and none is shuffled; more of them are
    joined with the windows.
    """
    words = tokens(F.col("quote"))
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    of = F.least(F.size(inner), F.lit(width))
    short = F.concat(F.lit("c"), F.least(F.length("quote"), F.lit(width)))
    kind = F.when(of > 0, F.concat(F.lit("w"), of)).otherwise(short)
    key = F.when(of > 0, F.array_join(F.slice(inner, F.lit(1), of), " ")).otherwise(F.substring("quote", 1, width))
    keyed = quotes.filter("quote <> ''").select("item_id", "quote", kind.alias("kind"), F.concat_ws(":", kind, key).alias("key"))
    # 2 * width kinds at most.
    counts = {r["kind"]: r["n"] for r in keyed.groupBy("kind").agg(F.count_distinct("key").alias("n")).collect()}
    if not counts:
        return quotes.select("item_id").join(docs.select("doc_id"), F.lit(False))

    def windows(items: Column, kind: str) -> Column:
        n, glue = int(kind[1:]), " " if kind[0] == "w" else ""
        places = F.sequence(F.lit(1), F.greatest(F.size(items) - (n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.lit(f"{kind}:"), F.array_join(F.slice(items, i, F.lit(n)), glue)))

    lists = {"w": tokens(F.col("text")), "c": F.filter(F.split("text", ""), lambda c: c != "")}
    runs = [F.element_at(F.transform(F.array(lists[letter]), lambda x: F.flatten(F.array(*[windows(x, k) for k in own]))), 1) for letter in "wc" if (own := sorted(k for k in counts if k[0] == letter))]
    rows = docs.filter("text is not null")
    if sum(counts.values()) <= KEYS:
        # One row of KEYS short keys at most.
        rows = rows.join(F.broadcast(keyed.agg(F.collect_set("key").alias("_keys"))))
        met = rows.select("doc_id", "text", F.explode(F.array_intersect(F.concat(*runs), "_keys")).alias("key")).join(F.broadcast(keyed), "key")
        return met.filter(F.col("text").contains(F.col("quote"))).select("item_id", "doc_id").distinct()
    found = rows.select("doc_id", F.explode(F.array_distinct(F.concat(*runs))).alias("key")).join(keyed.select("item_id", "key"), "key").select("item_id", "doc_id")
    both = found.distinct().join(rows.select("doc_id", "text"), "doc_id").join(keyed.select("item_id", "quote"), "item_id")
    return both.filter(F.col("text").contains(F.col("quote"))).select("item_id", "doc_id")


def sync_plan(source: DataFrame, copy: DataFrame) -> DataFrame:
    """(name, action) from two tables of (name, digest): add, update, stale or ok."""
    both = source.select("name", F.col("digest").alias("a")).join(copy.select("name", F.col("digest").alias("b")), "name", "full_outer")
    action = F.when(F.col("b").isNull(), F.lit("add")).when(F.col("a").isNull(), F.lit("stale")).when(F.col("a") != F.col("b"), F.lit("update")).otherwise(F.lit("ok"))
    return both.select("name", action.alias("action"))


def served_state(served: DataFrame, source: DataFrame) -> DataFrame:
    """(url, state) from (url, status, digest) on both sides: current, stale, or unreachable if either isn't a 200."""
    both = source.select("url", F.col("status").alias("s"), F.col("digest").alias("a")).join(served.select("url", F.col("status").alias("t"), F.col("digest").alias("b")), "url", "left")
    good = F.coalesce((F.col("s") == 200) & (F.col("t") == 200), F.lit(False))
    return both.select("url", F.when(~good, F.lit("unreachable")).when(F.col("a") == F.col("b"), F.lit("current")).otherwise(F.lit("stale")).alias("state"))


def missing_and_stale(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, state): wanted keys that are not present, and present ones that nobody wants."""
    a, b = wanted.select(key).distinct(), present.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("stale")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with those of ``new`` over them; both have the same columns."""
    others = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*others).alias("a")).join(new.select(key, F.struct(*others).alias("b")), key, "full_outer")
    return both.select(key, *[F.coalesce("b", "a")[c].alias(c) for c in others])


def capture_schedule(refs: DataFrame, window_days: float, cap: int) -> DataFrame:
    """``refs`` (url, pos, official, age) with ``decision``: skip, recapture, lookup, or defer once ``cap`` saves are planned.

    ``age`` is null for a reference without snapshot. The running count goes by
    ``pos``; it is taken over the planned rows alone.
    """
    wanted = F.when(F.col("age").isNull(), F.lit("lookup")).when(F.col("official") & (F.col("age") > window_days), F.lit("recapture")).otherwise(F.lit("skip"))
    rows = refs.withColumn("wanted", wanted)
    saves = ordered.numbered(rows.filter("wanted <> 'skip'"), ["pos", "url"], "k")
    late = saves.select("*", F.when(F.col("k") > cap, F.lit("defer")).otherwise(F.col("wanted")).alias("decision")).drop("k", "wanted")
    return late.unionByName(rows.filter("wanted = 'skip'").withColumnRenamed("wanted", "decision"))


def first_by_url(refs: DataFrame) -> DataFrame:
    """References with an http(s) URL, the first of each URL."""
    order = Window.partitionBy("url").orderBy("pos")
    return refs.filter(F.col("url").rlike(r"^https?://")).withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


