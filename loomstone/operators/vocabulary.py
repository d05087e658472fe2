"""Vocabulary of datasets: citations, glossary markers, translations, years, subject names, slugs, line differences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.dates import TEXT_YEAR
from loomstone.functions.fold import deaccent, fold_key, paren_terms, search_variants
from loomstone.operators import ordered

# Keys of a dataset's description that may hold names of its subject, and keys whose text may name it in parentheses.
NAME_KEYS = ["title", "shortTitle", "shortName", "altTitle", "altTitles", "altNames", "alternateNames", "otherNames", "aka", "nativeName", "names"]
PROSE_KEYS = ["subtitle", "description"]


def cite(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """(locator, pos, mark) of each source: the number of its reference, ``web`` for a URL; others are dropped.

    ``refs`` has (id, pos); numbers go by ``pos``.
    """
    numbered = ordered.numbered(refs, ["pos", "id"], "number").select("id", "number")
    cited = rows.select("locator", F.posexplode("sources").alias("pos", "source")).join(numbered, F.col("source") == F.col("id"), "left")
    mark = F.coalesce(F.col("number").cast("string"), F.when(F.col("source").rlike(r"^https?://"), F.lit("web")))
    return cited.select("locator", "pos", mark.alias("mark")).filter("mark is not null")


def glossary_terms(ids: DataFrame, own: DataFrame, sibling: DataFrame, pinned: DataFrame) -> DataFrame:
    """(id, uses, term, pinned): each marker's id, how often it occurs, and its name, from the nearest glossary that has it."""
    uses = ids.groupBy("id").agg(F.count(F.lit(1)).alias("uses"))
    found = uses.join(own.select("id", F.col("term").alias("t1")), "id", "left").join(sibling.select("id", F.col("term").alias("t2")), "id", "left").join(pinned.select("id", F.lit(True).alias("p")), "id", "left")
    return found.select("id", "uses", F.coalesce("t1", "t2").alias("term"), F.coalesce("p", F.lit(False)).alias("pinned"))


def translate(rows: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` translated where the dictionary (source, target) has it, and ``<column>_key``, the original."""
    named = dictionary.select(F.col("source").alias(column), F.col("target").alias("_to"))
    found = rows.join(named, column, "left")
    return found.withColumn(f"{column}_key", F.col(column)).withColumn(column, F.coalesce("_to", column)).drop("_to")


def years(text: Column) -> Column:
    """Years from 1000 to 2099 in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(TEXT_YEAR), F.lit(1)), lambda y: y.cast("int"))


def date_window(rows: DataFrame, scope: str, text: str) -> DataFrame:
    """(scope, lo, hi): first and last year of each scope's texts, and of all."""
    each = rows.select(scope, F.explode(years(F.col(text))).alias("year"))
    return each.rollup(scope).agg(F.min("year").alias("lo"), F.max("year").alias("hi")).select(F.coalesce(scope, F.lit("*")).alias("scope"), "lo", "hi").filter("lo is not null")


def dedupe(rows: DataFrame, value: str, pos: str) -> DataFrame:
    """The first of each value, accents and case aside."""
    return rows.withColumn("_k", fold_key(F.col(value))).groupBy("_k").agg(F.min_by(value, pos).alias(value), F.min(pos).alias(pos)).drop("_k")


def subject_names(meta: DataFrame, suffix: str = "") -> DataFrame:
    """(repo, name, pos): search forms of the naming keys, then terms in parentheses of subtitle and description.

    Values are strings or lists of them. Of names that differ in accents, case
    or spaces alone the first stays; ``suffix``, in lower case, is what titles end in and no name.
    """
    none = F.expr("cast(array() as array<string>)")

    def strings(key: str) -> Column:
        listed = dict(meta.dtypes)[key].startswith("array")
        return F.coalesce(F.filter(F.col(key) if listed else F.array(key), lambda x: x.isNotNull()), none)

    forms = [F.flatten(F.transform(strings(k), search_variants)) for k in NAME_KEYS if k in meta.columns]
    terms = [F.flatten(F.transform(strings(k), paren_terms)) for k in PROSE_KEYS if k in meta.columns]
    squeezed = F.transform(F.flatten(F.array(none, *forms, *terms)), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    rows = meta.select("repo", squeezed.alias("names")).withColumn("keys", F.transform("names", lambda x: F.lower(deaccent(x))))
    first = F.filter(F.sequence(F.lit(1), F.size("keys")), lambda i: (i <= F.size("keys")) & (F.array_position("keys", F.try_element_at("keys", i)) == i) & ~F.try_element_at("keys", i).isin("", suffix))
    return rows.select("repo", F.posexplode(F.transform(first, lambda i: F.element_at("names", i))).alias("pos", "name"))


def bundle(sections: dict[str, DataFrame]) -> DataFrame:
    """(repo, section, pos, value): all vocabulary of datasets in one table, each section's values (repo, pos, value) from 1 in their order, distinct.

    Of a value that a section has twice, accents and case aside, the first place counts.
    """
    parts = [rows.select("repo", F.lit(name).alias("section"), F.col("pos").cast("long").alias("at"), F.col("value").cast("string").alias("value")) for name, rows in sections.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts).filter("trim(coalesce(value, '')) <> ''").withColumn("key", fold_key(F.col("value")))
    first = every.groupBy("repo", "section", "key").agg(F.min(F.struct("at", "value")).alias("f")).select("repo", "section", "f.at", "f.value")
    # A section of one dataset is one figure's, organization's or place's names: small.
    place = F.row_number().over(Window.partitionBy("repo", "section").orderBy("at", "value"))
    return first.select("repo", "section", place.cast("long").alias("pos"), "value")


def slugs(html: Column) -> Column:
    """Sorted slugs of links to translated pages: ``/slug/en/`` and the like."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="/([a-z0-9-]+)/(?:en|es|pt)/"'), F.lit(1))))


def adopted(text: Column) -> Column:
    """A script without ADOPT blocks, comments and blank lines: what a template comparison looks at."""
    plain = F.regexp_replace(text, r"(?s)[^\n]*ADOPT-START.*?ADOPT-END[^\n]*\n?", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?s)/\*.*?\*/", ""), r"(?m)^\s*(//|#).*$", "")
    return F.trim(F.regexp_replace(plain, r"\n\s*\n+", "\n"))


def line_differences(pairs: DataFrame) -> DataFrame:
    """(name, same, removed, added) from (name, a, b): equality on the JVM, a difference of lines only for the rest."""
    rows = pairs.select("name", adopted(F.col("a")).alias("a"), adopted(F.col("b")).alias("b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        for frame in frames:
            out = []
            for r in frame.itertuples():
                marks = [x[:2] for x in difflib.ndiff(r.a.split("\n"), r.b.split("\n"))]
                out.append((r.name, False, marks.count("- "), marks.count("+ ")))
            yield pd.DataFrame(out, columns=["name", "same", "removed", "added"])

    same = rows.filter("a <=> b").select("name", F.lit(True).alias("same"), F.lit(0).cast("long").alias("removed"), F.lit(0).cast("long").alias("added"))
    return same.unionByName(rows.filter("not (a <=> b)").mapInPandas(run, "name string, same boolean, removed long, added long"))
