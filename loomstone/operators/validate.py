"""A declarative validator: every rule is a filter that yields (rule, severity, locator, message)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# What an approval stage may be, and which of these need no document.
LADDER = ["approved", "granted", "pending", "refused", "suppressed", "withdrawn", "never-sought", "none"]
NOTHING_HERE = ["never-sought", "none"]
KINDS = ["city", "town", "village", "hamlet", "site", "region", "country", "non-geographic"]
PRECISIONS = ["settlement", "country-centroid", "none"]


@dataclass(frozen=True, eq=False)
class Check:
    """A rule over the rows of one table, not yet run."""

    rows: DataFrame
    bad: Column
    issue: Column


def issues(rows: DataFrame, bad: Column, rule: str, locator: Column, message: str, severity: str = "error") -> Check:
    """The rule that rows for which ``bad`` holds are an issue each."""
    issue = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), locator.cast("string").alias("locator"), F.lit(message).alias("message"))
    return Check(rows, F.coalesce(bad, F.lit(False)), issue)


def report(parts: list[Check | DataFrame]) -> DataFrame:
    """(rule, severity, locator, message) of all rules; those over one table run in one pass over it."""
    tables: dict[int, list[Check]] = {}
    for p in parts:
        if isinstance(p, Check):
            tables.setdefault(id(p.rows), []).append(p)
    found = [p for p in parts if isinstance(p, DataFrame)]
    for checks in tables.values():
        each = F.array_compact(F.array(*[F.when(c.bad, c.issue) for c in checks]))
        found.append(checks[0].rows.select(F.explode(each).alias("i")).select("i.*"))
    return reduce(lambda a, b: a.unionByName(b), found)


def counted(found: DataFrame) -> tuple[DataFrame, Observation]:
    """``found`` with an observation of its errors and warnings, which whatever job writes or reads it makes on its way."""
    seen = Observation()
    return found.observe(seen, F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")), seen


def write_report(found: DataFrame, path: str) -> dict[str, int]:
    """Write all issues and give their counts by severity, in one job."""
    rows, seen = counted(found)
    rows.write.mode("overwrite").json(path)
    return seen.get


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def duplicates(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that occur more than once."""
    twice = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return report([issues(twice, F.col("n") > 1, rule, F.col(key), f"duplicate {key}")])


def unknown(rows: DataFrame, key: str, known: DataFrame, known_key: str, rule: str, locator: str, severity: str = "error") -> DataFrame:
    """Values of ``key`` that ``known`` doesn't have."""
    own = rows.filter(F.col(key).isNotNull())
    return report([issues(own.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti"), F.lit(True), rule, F.col(locator), f"unknown {key}", severity)])


def meta(rows: DataFrame) -> DataFrame:
    """Title, description and language are there; lastUpdated is a date."""
    return report([issues(rows, blank(c), "V01", F.col("repo"), f"{c} is missing") for c in ("title", "description", "language")] + [issues(rows, F.col("lastUpdated").isNull() | ~F.col("lastUpdated").rlike(r"^\d{4}-\d{2}-\d{2}$"), "V01", F.col("repo"), "lastUpdated is no date")])


def references(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Unique id, http(s) URL, publisher, type; unknown types only warn."""
    return report(
        [
            duplicates(rows, "id", "V02"),
            issues(rows, blank("id"), "V02", F.col("locator"), "id is missing"),
            issues(rows, ~F.coalesce(F.col("url"), F.lit("")).rlike(r"^https?://"), "V02", F.col("locator"), "url is no http(s) URL"),
            issues(rows, blank("publisher"), "V02", F.col("locator"), "publisher is missing"),
            issues(rows, blank("type"), "V02", F.col("locator"), "type is missing"),
            issues(rows, ~blank("type") & ~F.col("type").isin(kinds), "V13", F.col("locator"), "unknown type", "warning"),
        ]
    )


def sources(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Each source is a reference's id or a URL; a row that must cite does."""
    cited = rows.select("locator", F.explode("sources").alias("source")).filter(~F.col("source").rlike(r"^https?://"))
    return report([unknown(cited, "source", refs, "id", "V03", "locator"), issues(rows, F.size(F.coalesce("sources", F.expr("cast(array() as array<string>)"))) == 0, "V03", F.col("locator"), "no source")])


def events(rows: DataFrame) -> DataFrame:
    """Year within 1500 to 2100, a title, and dateVerified given."""
    return report(
        [
            issues(rows, F.col("year").isNull() | ~F.col("year").between(1500, 2100), "V04", F.col("locator"), "year out of bounds"),
            issues(rows, blank("title"), "V04", F.col("locator"), "title is missing"),
            issues(rows, F.col("dateVerified").isNull(), "V04", F.col("locator"), "dateVerified is no boolean"),
        ]
    )


def lanes(rows: DataFrame, events_: DataFrame) -> DataFrame:
    """Lane ids are unique kebab-case, with label and basis; events name declared lanes."""
    return report(
        [
            duplicates(rows, "lane", "V05"),
            issues(rows, ~F.coalesce(F.col("lane"), F.lit("")).rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), "V05", F.col("lane"), "id is not kebab-case"),
            issues(rows, blank("label") | blank("basis"), "V05", F.col("lane"), "label or basis is missing"),
            unknown(events_.select("locator", F.explode("threads").alias("lane")), "lane", rows, "lane", "V05", "locator"),
        ]
    )


def lineage(nodes: DataFrame) -> DataFrame:
    """Nodes have names; edges are direct or indirect."""
    return report([issues(nodes, blank("name"), "V06", F.col("path"), "name is missing"), issues(nodes, F.col("edge").isNotNull() & ~F.col("edge").isin("direct", "indirect"), "V06", F.col("path"), "unknown edge")])


def branch_rows(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Unique ids, years within bounds, parents that are the trunk or an earlier branch."""
    earlier = rows.select(F.col("id").alias("parent"), F.col("pos").alias("at"))
    joined = rows.join(earlier, "parent", "left")
    return report(
        [
            duplicates(rows, "id", "V07"),
            issues(rows, ~F.col("year").between(first, last), "V07", F.col("id"), "year out of bounds"),
            issues(joined, F.col("parent").isNotNull() & (F.col("parent") != "trunk") & (F.col("at").isNull() | (F.col("at") >= F.col("pos"))), "V07", F.col("id"), "parent is no earlier branch"),
        ]
    )


def numbers(series: DataFrame) -> DataFrame:
    """Each series has a unit, a source label and points."""
    return report([issues(series, blank(c), "V08", F.col("label"), f"{c} is missing") for c in ("unit", "sourceLabel")] + [issues(series, F.coalesce(F.size("points"), F.lit(0)) <= 0, "V08", F.col("label"), "no points")])


def gazetteer(places: DataFrame) -> DataFrame:
    """Unique ids, known kinds, coordinates in range and cited; none for a non-geographic entry."""
    there = F.col("lat").isNotNull() | F.col("lon").isNotNull()
    return report(
        [
            duplicates(places, "place_id", "V09"),
            issues(places, ~F.col("kind").isin(KINDS), "V09", F.col("place_id"), "unknown kind"),
            issues(places, ~F.col("precision").isin(PRECISIONS), "V09", F.col("place_id"), "unknown precision"),
            issues(places, there & ~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)), "V09", F.col("place_id"), "coordinates out of range"),
            issues(places, there & blank("source"), "V09", F.col("place_id"), "coordinates without source"),
            issues(places, (F.col("kind") == "non-geographic") & there, "V09", F.col("place_id"), "coordinates of a non-geographic entry"),
        ]
    )


def tiers(tiers_: DataFrame, countries: DataFrame) -> DataFrame:
    """One to four tiers, unique ISO codes, declared tiers."""
    n = tiers_.agg(F.count(F.lit(1)).alias("n"))
    return report(
        [
            issues(n, ~F.col("n").between(1, 4), "V10", F.lit("tiers"), "one to four tiers are needed"),
            duplicates(countries, "code", "V10"),
            issues(countries, ~F.coalesce(F.col("code"), F.lit("")).rlike("^[A-Z]{2}$"), "V10", F.col("code"), "no ISO code"),
            unknown(countries, "tier", tiers_, "tier", "V10", "code"),
        ]
    )


def markers(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Glossary markers name known terms, from (locator, term)."""
    return unknown(rows, "term", terms, "term", "V11", "locator")


def ladder(rows: DataFrame) -> DataFrame:
    """Stages have a label and a known status, and cite a source or say that there is no document."""
    cited = F.size(F.coalesce("sources", F.expr("cast(array() as array<string>)"))) > 0
    bare = F.coalesce("noDocument", F.lit(False))
    return report(
        [
            issues(rows, blank("label"), "V12", F.col("pos"), "label is missing"),
            issues(rows, F.col("status").isNull() | ~F.col("status").isin(LADDER), "V12", F.col("pos"), "unknown status"),
            issues(rows, ~cited & ~bare, "V12", F.col("pos"), "neither cited nor without document"),
            issues(rows, F.col("status").isin(NOTHING_HERE) & ~bare, "V12", F.col("pos"), "a document for nothing"),
        ]
    )


def ladder_rungs(rows: DataFrame) -> DataFrame:
    """``rows`` of a ladder as they are; the query that reads them fails at the first stage that breaks V12, and names it."""
    cited = F.size(F.coalesce("sources", F.expr("cast(array() as array<string>)"))) > 0
    bare = F.coalesce("noDocument", F.lit(False))
    known = F.coalesce(F.col("status").isin(LADDER), F.lit(False))
    wrong = (
        F.when(blank("label"), "label is missing")
        .when(~known, "unknown status")
        .when(~cited & ~bare, "neither cited nor without document")
        .when(F.col("status").isin(NOTHING_HERE) & ~bare, "a document for nothing")
    )
    stop = F.raise_error(F.concat(F.lit("V12 at "), F.col("pos").cast("string"), F.lit(": "), wrong)).cast("boolean")
    return rows.filter(F.when(wrong.isNotNull(), stop).otherwise(F.lit(True)))


def publishers(rows: DataFrame) -> DataFrame:
    """No publisher ends in a parenthesis of two words or more."""
    return report([issues(rows, F.size(F.split(F.trim(F.regexp_extract(F.coalesce("publisher", F.lit("")), r"\(([^)]*)\)\s*$", 1)), r"\s+")) >= 2, "V14", F.col("locator"), "publisher ends in a note")])


def corpus_shape(docs: DataFrame, least: int = 40, most_pairs: float = 0.5) -> DataFrame:
    """Documents of a derived corpus are whole: ended sentences, one row each, a least size, few doubled glyphs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # The share of like pairs among the first and second character, the third and fourth and so on, without white space: all in a doubled text.
    # Each pair becomes its character if both are like, else nothing; an odd last character stays.
    glyphs = F.regexp_replace(text, r"(?U)\s+", "")
    like = F.length(F.regexp_replace(glyphs, r"(?s)(.)\1|..", "$1")) - F.length(glyphs) % 2
    pairs = like / F.greatest(F.floor(F.length(glyphs) / 2), F.lit(1))
    last = F.trim(text)
    return report(
        [
            issues(docs, F.col("doc_id").isNull(), "V15", F.lit("-"), "doc_id is missing"),
            duplicates(docs, "doc_id", "V15"),
            issues(docs, F.length(last) < least, "V15", F.col("doc_id"), "too small"),
            issues(docs, (F.length(last) > 0) & ~last.rlike(r"[.!?…\"'”)\]]$"), "V15", F.col("doc_id"), "ends within a sentence", "warning"),
            issues(docs, pairs > most_pairs, "V15", F.col("doc_id"), "doubled glyphs"),
        ]
    )


def verdict(found: DataFrame, checked: DataFrame) -> DataFrame:
    """(checked, errors, warnings, code): 0 without errors, 1 with, 2 if nothing was checked."""
    n = checked.agg(F.count(F.lit(1)).alias("checked"))
    both = n.join(found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")))
    return both.withColumn("code", F.when(F.col("checked") == 0, 2).when(F.col("errors") > 0, 1).otherwise(0))


