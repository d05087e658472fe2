"""Entities: canonical tables, tiered matches, near misses, suggestions. Nothing merges on similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.fold import conjunction_parts, fold_key, initials_key
from loomstone.session import PART, dealt

#: Blocks of a token above this many entities make no pairs; a token of up to RARE is rare.
BLOCK, RARE, MOST = 12, 3, 200


def postings(docs: DataFrame) -> DataFrame:
    """(surface, doc) pairs, each once."""
    return docs.select("doc", "surface").filter("surface is not null").distinct()


def canonical_table(pairs: DataFrame, aliases: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Surfaces grouped by match key: (key, display, docs, variants, surfaces, merged_by).

    ``aliases`` has (key, target): recorded spellings that count as another
    key. Pairs are dealt by document over as many tasks as they ask for (by
    ``rows``, or as counted) and counted within each part, so that no list of
    documents is collected and only counts are shuffled again.
    """
    keyed = dealt(pairs.select("doc", "surface"), "doc", rows).distinct().withColumn("own", fold_key(F.col("surface"))).filter("own <> ''")
    if aliases is not None:
        keyed = keyed.join(aliases.select(F.col("key").alias("own"), "target"), "own", "left").withColumn("key", F.coalesce("target", "own"))
    else:
        keyed = keyed.withColumn("key", F.col("own"))
    docs = keyed.select(PART, "key", "doc").distinct().groupBy(PART, "key").agg(F.count("doc").alias("n")).groupBy("key").agg(F.sum("n").alias("docs"))
    surfaces = keyed.groupBy(PART, "key", "own", "surface").agg(F.count("doc").alias("n")).groupBy("key", "own", "surface").agg(F.sum("n").alias("n"))
    grouped = surfaces.groupBy("key").agg(
        F.min_by("surface", F.struct(-F.col("n"), "surface")).alias("display"),
        F.count(F.lit(1)).alias("variants"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "surface"))), lambda x: x["surface"]).alias("surfaces"),
        F.count_distinct("own").alias("keys"),
    )
    by = F.when(F.col("keys") > 1, F.lit("alias")).when(F.col("variants") > 1, F.lit("fold"))
    return grouped.join(docs, "key").select("key", "display", "docs", "variants", "surfaces", by.alias("merged_by"))


def merge_counts(table: DataFrame) -> DataFrame:
    """Merged groups, surfaces they absorbed, and how many came by folding and by alias."""
    merged = F.col("variants") > 1
    return table.agg(
        F.count_if(merged).alias("merged_groups"),
        F.coalesce(F.sum(F.when(merged, F.col("variants") - 1)), F.lit(0)).alias("absorbed"),
        F.count_if(F.col("merged_by") == "fold").alias("by_fold"),
        F.count_if(F.col("merged_by") == "alias").alias("by_alias"),
    )


def tiered_match(names: DataFrame, table: DataFrame) -> DataFrame:
    """(name, key, confidence): by the fold key (high), else by the key without initials (medium), else none."""
    order = F.struct(-F.col("docs"), -F.col("variants"), F.col("key"))
    weak = table.withColumn("weak", initials_key(F.col("display"))).filter("weak <> ''")
    by_weak = weak.groupBy("weak").agg(F.min_by("key", order).alias("weak_key"))
    keyed = names.select("name").distinct().withColumns({"exact": fold_key(F.col("name")), "short": initials_key(F.col("name"))})
    found = keyed.join(table.select(F.col("key").alias("exact"), F.col("key").alias("exact_key")), "exact", "left").join(by_weak, F.col("short") == F.col("weak"), "left")
    return found.select(
        "name",
        F.coalesce("exact_key", "weak_key").alias("key"),
        F.when(F.col("exact_key").isNotNull(), F.lit("high")).when(F.col("weak_key").isNotNull(), F.lit("medium")).otherwise(F.lit("none")).alias("confidence"),
    )


def token_index(table: DataFrame) -> DataFrame:
    """(token, key, entities): words of keys, and how many entities carry each."""
    words = table.select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("token"))
    return words.join(words.groupBy("token").agg(F.count(F.lit(1)).alias("entities")), "token")


def _third_mates(mine: DataFrame, table: DataFrame) -> DataFrame:
    """(name, own, key, shared) of names and keys with one first letter that share a third of the key, at most two places apart."""

    def third(length: Column, i: Column) -> tuple[Column, Column]:
        base = F.floor(length / 3).cast("int")
        return i * base, F.when(i < 2, base).otherwise(length - 2 * base)

    parts = F.explode(F.sequence(F.lit(0), F.lit(2)))
    keys = table.filter(F.length("key") >= 6).select("key", F.length("key").alias("long"), parts.alias("i"))
    at, size = third(F.col("long"), F.col("i"))
    keys = keys.select("key", "long", "i", F.substring("key", at + 1, size).alias("piece"), F.substring("key", 1, 1).alias("initial"))
    wide = mine.withColumn("long", F.explode(F.sequence(F.length("own") - 2, F.length("own") + 2))).withColumn("i", parts).withColumn("shift", F.explode(F.sequence(F.lit(-2), F.lit(2))))
    at, size = third(F.col("long"), F.col("i"))
    wide = wide.filter((at + F.col("shift") >= 0) & (at + F.col("shift") + size <= F.length("own")))
    wide = wide.select("name", "own", "long", "i", F.substring("own", at + F.col("shift") + 1, size).alias("piece"), F.substring("own", 1, 1).alias("initial")).distinct()
    met = wide.join(keys, ["long", "i", "piece", "initial"])
    return met.filter(F.levenshtein("own", "key", 2) >= 0).select("name", "own", "key", F.lit(False).alias("shared"))


def near_misses(names: DataFrame, table: DataFrame, most: int = 3) -> DataFrame:
    """Entities close to a name without a match: (name, key, why), at most ``most`` each.

    Two equi-joins give the candidates: on a rare last word, and on a third of
    the entity's key at the place where two edits could have moved it. Two
    edits leave one of three parts whole, so that no close key is missed.
    """
    mine = names.select("name", fold_key(F.col("name")).alias("own")).filter("own <> ''")
    last = mine.withColumn("token", F.element_at(F.split("own", " "), -1)).filter(F.length("token") >= 4)
    rare = token_index(table).filter(F.col("entities") <= RARE).select("token", "key")
    by_name = last.join(rare, "token").select("name", "own", "key", F.lit(True).alias("shared"))
    by_edit = _third_mates(mine.filter(F.length("own") >= 8), table)
    both = by_name.unionByName(by_edit).filter("own <> key").groupBy("name", "own", "key").agg(F.max("shared").alias("shared"))
    distance = F.when(F.col("shared"), F.lit(None)).otherwise(F.levenshtein("own", "key", 2))
    scored = both.withColumn("distance", distance).filter("shared or distance between 0 and 2").join(table.select("key", "docs", "display"), "key")
    order = Window.partitionBy("name").orderBy(F.col("shared").cast("int"), F.desc("docs"), "display", "key")
    why = F.when(F.col("shared"), F.lit("rare name part")).otherwise(F.concat(F.lit("edit distance "), F.col("distance").cast("string")))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("name", "key", why.alias("why"))


def suggestions(table: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Pairs a person should look at: (a, b, kind), the strongest kind of each pair."""
    index = token_index(table).filter((F.length("token") > 2) & (F.col("entities") <= BLOCK))
    left = index.select("token", "entities", F.col("key").alias("a"))
    pairs = left.join(index.select("token", F.col("key").alias("b")), "token").filter("a < b")
    limit = F.when(F.greatest(F.length("a"), F.length("b")) >= 14, 2).otherwise(1)
    edit = F.levenshtein("a", "b", 2)
    x, y = F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " "))
    subset = (F.size(F.array_except(x, y)) == 0) != (F.size(F.array_except(y, x)) == 0)
    rare = (F.col("entities") <= RARE) & (F.length("token") >= 4)
    rank = F.when(edit.between(0, limit), 0).when(subset, 1).when(rare, 2)
    best = pairs.withColumn("rank", rank).filter("rank is not null").groupBy("a", "b").agg(F.min("rank").alias("rank"))
    if blocked is not None:
        best = best.join(blocked.select("a", "b"), ["a", "b"], "left_anti")
    kinds = F.array(F.lit("edit1"), F.lit("token-subset"), F.lit("shared-token"))
    return best.select("a", "b", F.element_at(kinds, F.col("rank") + 1).alias("kind"))


def conjunctions(table: DataFrame) -> DataFrame:
    """Surfaces that name two entities at once."""
    parts = table.select("key", F.explode("surfaces").alias("surface")).withColumn("parts", conjunction_parts(F.col("surface")))
    return parts.filter("parts is not null").select("key", "surface", "parts.left", "parts.right")
