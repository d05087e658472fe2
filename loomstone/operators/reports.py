"""Reports: ranked and capped rows with their total, dated lists, lines of incomplete documents, differences both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.entities import conjunctions, suggestions, tiered_match
from loomstone.operators.search import COMPLETE
from loomstone.sources.readers import visited

#: The order of verdicts, confidences and kinds of suggestion in reports.
STATUS = ["contradiction", "differs", "ok"]
CONFIDENCE = ["high", "medium", "low"]
SUGGESTION = ["edit1", "token-subset", "shared-token", "conjunction"]
#: Suggestions a report shows.
SHOWN = 200


def rank_of(value: Column, order: list[str]) -> Column:
    """The place of a value in a fixed order; values that it lacks come last."""
    return F.coalesce(*[F.when(value == v, i) for i, v in enumerate(order)], F.lit(len(order)))


def first_rows(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows in order, with ``place`` from 1 and ``total``, the number of all rows.

    The limit runs in every task before the one that merges, so that this one
    sees ``most`` rows of each; places are given to the rows that stay.
    """
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(total))


def ranked_entities(table: DataFrame, most: int) -> DataFrame:
    """Canonical entities by documents, then variants, then key."""
    return first_rows(table, [F.desc("docs"), F.desc("variants"), F.asc("key")], most)


def ranked_divergence(rows: DataFrame, most: int) -> DataFrame:
    """Rows (key, repos, status): contradictions first, then by repositories and key."""
    return first_rows(rows, [rank_of(F.col("status"), STATUS).asc(), F.desc("repos"), F.asc("key")], most)


def ranked_hits(claims: DataFrame, table: DataFrame, most: int, least: int = 1) -> DataFrame:
    """(key, confidence, docs, repos, claims): entities that claims (repo, locator, name) name, surest first."""
    matched = claims.join(tiered_match(claims.select("name"), table), "name").filter("key is not null")
    best = matched.groupBy("key").agg(F.min(rank_of(F.col("confidence"), CONFIDENCE)).alias("rank"), F.sort_array(F.collect_set("repo")).alias("repos"), F.count(F.lit(1)).alias("claims"))
    found = best.join(table.select("key", "docs").filter(F.col("docs") >= least), "key")
    named = found.withColumn("confidence", F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("rank") + 1))
    return first_rows(named, [F.asc("rank"), F.desc("docs"), F.asc("key")], most).drop("rank")


def ranked_suggestions(table: DataFrame, blocked: DataFrame | None = None, most: int = SHOWN) -> DataFrame:
    """(a, b, kind, docs, display): pairs to look at and names of two entities, by kind, then documents of both, then display."""
    side = lambda k: table.select(F.col("key").alias(k), F.col("docs").alias(f"docs_{k}"), F.col("display").alias(f"display_{k}"))
    pairs = suggestions(table, blocked).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.select("a", "b", "kind", (F.col("docs_a") + F.col("docs_b")).alias("docs"), F.col("display_a").alias("display"))
    double = conjunctions(table).select("key", "surface").join(table.select("key", "docs", "display"), "key")
    double = double.select(F.col("key").alias("a"), F.col("surface").alias("b"), F.lit("conjunction").alias("kind"), "docs", "display")
    return first_rows(pairs.unionByName(double), [rank_of(F.col("kind"), SUGGESTION).asc(), F.desc("docs"), F.asc("display"), F.asc("a"), F.asc("b")], most)


def ranked_pins(pins: DataFrame, most: int) -> DataFrame:
    """Places by first year, then name in the order of English dictionaries."""
    return first_rows(pins, [F.asc("first_year"), F.collate("name", "en").asc(), F.asc("place_id")], most)


def by_collection(rows: DataFrame, group: str, locator: str, most: int) -> DataFrame:
    """Rows by collection, then locator, whose numbers count as numbers."""
    return first_rows(rows, [F.asc(group), visited(F.col(locator)).asc()], most)


def sorted_ids(ids: Column) -> Column:
    """Aggregate: the distinct ids in the order of English dictionaries."""
    return F.transform(F.array_sort(F.transform(F.collect_set(ids), lambda x: F.collate(x, "en"))), lambda x: F.collate(x, "UTF8_BINARY"))


def capped(items: Column, limit: int, separator: str = ",", more: str = "+{} more") -> Column:
    """The first ``limit`` items as one text, and how many more there are."""
    rest = F.size(items) - limit
    first, last = more.split("{}")
    return F.concat_ws(separator, F.slice(items, 1, limit), F.when(rest > 0, F.concat(F.lit(first), rest.cast("string"), F.lit(last))))


def dated_lists(pairs: DataFrame, dates: DataFrame, limit: int) -> DataFrame:
    """(key, text) from (key, id): the first ``limit`` ids of each key with their dates, ``?`` without one, and the number of others."""
    own = pairs.select("key", "id").distinct()
    count = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shown = own.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("k") <= limit)
    named = shown.join(dates.select("id", "date"), "id", "left").withColumn("item", F.concat(F.col("id").cast("string"), F.lit("("), F.coalesce(F.col("date").cast("string"), F.lit("?")), F.lit(")")))
    items = named.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))
    rest = F.when(F.col("n") > limit, F.concat(F.lit("+"), (F.col("n") - limit).cast("string")))
    return items.join(count, "key").select("key", F.concat_ws(",", "items", rest).alias("text"))


def incomplete_line(docs: DataFrame, shown: int = 5) -> DataFrame:
    """(n, worst): how many documents (doc_id, coverage) are incomplete, and the worst of them; no row if none is."""
    top = first_rows(docs.select("doc_id", "coverage").filter(F.col("coverage") < COMPLETE), [F.asc("coverage"), F.asc("doc_id")], shown)
    item = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.bround(F.col("coverage") * 100).cast("int").cast("string"), F.lit("%"))
    line = top.agg(F.max("total").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("items"))
    rest = F.when(F.col("n") > shown, F.concat(F.lit("+"), (F.col("n") - shown).cast("string"), F.lit(" more")))
    return line.filter("n is not null").select("n", F.concat_ws(", ", "items", rest).alias("worst"))


def only_in(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """(key, side): keys that one of two tables lacks; no row if they hold the same."""
    both = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side")))
    sides = both.groupBy(key).agg(F.bit_or("side").alias("side")).filter("side < 3")
    return sides.select(key, F.when(F.col("side") == 1, F.lit(names[0])).otherwise(F.lit(names[1])).alias("side"))
