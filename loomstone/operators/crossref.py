"""Entities across datasets: names in facts, one table of entries from figures, organizations and facts, divergence of all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.fold import is_notable, name_variants, normal_name
from loomstone.operators.consistency import affiliation_terms, divergence

# Fixed value: the form of a name of several words within a fact.
FACT_NAME = r"\b[A-ZÀ-Þ][\wÀ-ÿ'’.-]+(?:\s+(?:de|da|do|dos|das|del|van|von|of|al|ibn|bin|the)\s+[A-Za-zÀ-ÿ][\wÀ-ÿ'’.-]+|\s+[A-ZÀ-Þ][\wÀ-ÿ'’.-]+)+"


def fact_names(label: Column, value: Column) -> Column:
    """Names of several words in a fact, its glossary markers read as their text; in order, repeats included."""
    text = F.concat(F.coalesce(label, F.lit("")), F.lit(" "), F.coalesce(value, F.lit("")))
    plain = F.replace(F.regexp_replace(text, r"\[\[[^\]|]*\|?", " "), F.lit("]]"), F.lit(""))
    return F.transform(F.regexp_extract_all(plain, F.lit(f"(?U){FACT_NAME}"), F.lit(0)), lambda x: F.trim(x, F.lit(" .,;")))


def entries(figures: DataFrame, organizations: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo, key, locator, surface, kind, description) of all sources of names.

    figures and organizations have (repo, pos, name, description), facts (repo,
    pos, label, value). A name gives an entry for each notable variant. A fact
    gives one only for a key that its repository has from nothing before it.
    """

    def listed(rows: DataFrame, kind: str) -> DataFrame:
        own = rows.filter("coalesce(name, '') <> ''").select("repo", F.format_string("%s[%d]", F.lit(kind), "pos").alias("locator"), F.col("name").alias("surface"), F.lit(kind).alias("kind"), F.coalesce("description", F.lit("")).alias("description"))
        return own.withColumn("variant", F.explode(name_variants(F.col("surface")))).withColumn("key", normal_name(F.col("variant"))).drop("variant").filter(is_notable(F.col("key")))

    named = listed(figures, "figures").unionByName(listed(organizations, "organizations"))
    said = facts.select("repo", "pos", F.posexplode(fact_names(F.col("label"), F.col("value"))).alias("at", "surface"), F.concat_ws(" ", "label", "value").alias("description"))
    said = said.withColumn("key", normal_name(F.col("surface"))).filter(is_notable(F.col("key")))
    first = said.groupBy("repo", "key").agg(F.min_by(F.struct("surface", "description"), F.struct("pos", "at")).alias("f"))
    fresh = first.join(named.select("repo", "key").distinct(), ["repo", "key"], "left_anti")
    found = fresh.select("repo", F.lit("facts").alias("locator"), F.col("f.surface").alias("surface"), F.lit("facts").alias("kind"), F.col("f.description").alias("description"), "key")
    squeezed = F.trim(F.regexp_replace("description", r"(?U)\s+", " "))
    return named.unionByName(found).withColumn("description", squeezed).select("repo", "key", "locator", "surface", "kind", "description")


def merged_divergence(tables: list[DataFrame], least: int = 2) -> DataFrame:
    """(key, repos, status) over the entries of several repositories, merged by key."""
    rows = reduce(DataFrame.unionByName, tables)
    return divergence(rows.select("repo", "key", affiliation_terms(F.col("description")).alias("terms")), least)
