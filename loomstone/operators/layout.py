"""The numbers behind figures: decade spines, swimlanes, place maps, branch timelines, bar charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.dates import decade, round1
from loomstone.operators import ordered
from loomstone.session import Scratch

#: Empty decades in a row from which they become one break.
COLLAPSE = 2
#: Places and sizes of the branch timeline, in pixels.
LEFT, TOP, LANE, PER_YEAR = 20, 20, 30, 4
COLOURS = 6


def decade_columns(present: DataFrame, collapse: int = COLLAPSE) -> DataFrame:
    """(kind, start, stop, count) from (decade): every decade from first to last, long empty runs as one break.

    At most a few hundred rows, whatever the input: the decades there are.
    """
    bounds = present.agg(F.min("decade").alias("lo"), F.max("decade").alias("hi")).filter("lo is not null")
    every = bounds.select(F.explode(F.sequence("lo", "hi", F.lit(10))).alias("decade"))
    marked = every.join(present.select("decade").distinct().withColumn("has", F.lit(True)), "decade", "left")
    # Empty decades between two present ones share the number of present ones before them.
    island = F.count("has").over(Window.orderBy("decade").rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("island", island).withColumn("empty", F.col("has").isNull())
    sized = runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("island", "empty")))
    gaps = sized.filter(F.col("empty") & (F.col("n") >= collapse)).groupBy("island").agg(F.min("decade").alias("start"), (F.max("decade") + 9).alias("stop"), F.count(F.lit(1)).alias("count"))
    shown = sized.filter(~(F.col("empty") & (F.col("n") >= collapse))).select(F.lit("decade").alias("kind"), F.col("decade").alias("start"), (F.col("decade") + 9).alias("stop"), F.lit(1).cast("long").alias("count"))
    return shown.unionByName(gaps.select(F.lit("break").alias("kind"), "start", "stop", "count"))


def spine(events: DataFrame, collapse: int = COLLAPSE) -> DataFrame:
    """Decade columns with total, unverified and their share of the largest, from (year, verified)."""
    unsure = F.count_if(F.col("verified").eqNullSafe(False))
    counts = events.filter("year is not null").groupBy(decade(F.col("year")).alias("decade")).agg(F.count(F.lit(1)).alias("total"), unsure.alias("unverified"))
    top = counts.agg(F.max("total").alias("top"))
    cells = decade_columns(counts, collapse).join(counts, (F.col("kind") == "decade") & (F.col("start") == F.col("decade")), "left").drop("decade").join(F.broadcast(top))
    zero = lambda c: F.when(F.col("kind") == "decade", F.coalesce(c, F.lit(0)))
    return cells.select("kind", "start", "stop", "count", zero("total").alias("total"), zero("unverified").alias("unverified"), round1(zero("total") / F.col("top") * 100).alias("pct"))


def swimlanes(events: DataFrame, lanes: DataFrame, collapse: int = COLLAPSE) -> DataFrame:
    """(lane, kind, start, stop, total, unverified): each declared lane over each column, from (year, verified, threads)."""
    tagged = events.filter((F.size(F.coalesce("threads", F.expr("cast(array() as array<string>)"))) > 0) & F.col("year").isNotNull()).withColumn("decade", decade(F.col("year")))
    columns = decade_columns(tagged.select("decade"), collapse)
    cells = tagged.select("decade", "verified", F.explode(F.array_distinct("threads")).alias("lane")).groupBy("lane", "decade").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("verified").eqNullSafe(False)).alias("unverified"))
    grid = lanes.select("lane").crossJoin(columns)
    found = grid.join(cells.withColumnRenamed("decade", "start"), ["lane", "start"], "left")
    zero = lambda c: F.when(F.col("kind") == "decade", F.coalesce(c, F.lit(0)))
    return found.select("lane", "kind", "start", "stop", zero("total").alias("total"), zero("unverified").alias("unverified"))


def places_map(events: DataFrame, places: DataFrame) -> DataFrame:
    """(place_id, n, first_year, first_unverified, x, y, radius) of places with coordinates, from resolved events.

    ``first_unverified`` holds if any event of the first year is unverified.
    """
    own = events.join(places.filter("lat is not null and lon is not null"), "place_id")
    counts = own.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.any_value("lat").alias("lat"), F.any_value("lon").alias("lon"))
    first = own.groupBy("place_id", F.col("year").alias("first_year")).agg(F.bool_or(F.col("verified").eqNullSafe(False)).alias("first_unverified"))
    found = counts.join(first, ["place_id", "first_year"])
    return found.select("place_id", "n", "first_year", "first_unverified", (F.col("lon") + 180).alias("x"), (90 - F.col("lat")).alias("y"), round1(1 + F.sqrt("n")).alias("radius"))


def crop(points: DataFrame) -> DataFrame:
    """The box around points (x, y): 6 on each side, 60 by 30 at least, within 360 by 180."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def side(lo: Column, hi: Column, least: int, most: int) -> tuple[Column, Column]:
        width = F.greatest(hi - lo + 12, F.lit(float(least)))
        start = F.greatest(F.lit(0.0), F.least((lo + hi - width) / 2, most - width))
        return start, F.least(width, F.lit(float(most)))

    x, w = side(F.col("x0"), F.col("x1"), 60, 360)
    y, h = side(F.col("y0"), F.col("y1"), 30, 180)
    return box.select(round1(x).alias("x"), round1(y).alias("y"), round1(w).alias("width"), round1(h).alias("height"))


def branches(rows: DataFrame, first_year: int, last_year: int, per_year: int = PER_YEAR) -> DataFrame:
    """Geometry of branches (pos, id, year, stop, parent): lane, colour, ends and the lane that each leaves."""
    order = Window.orderBy("pos")
    own = rows.withColumn("lane", F.row_number().over(order))
    of = own.filter("id is not null").select(F.col("id").alias("parent"), F.col("lane").alias("from_lane"))
    x = lambda c: LEFT + (c - first_year) * per_year
    found = own.join(of, "parent", "left").withColumn("from_lane", F.coalesce("from_lane", F.lit(0)))
    return found.select(
        "id", "lane", F.pmod(F.col("lane") - 1, F.lit(COLOURS)).alias("colour"), F.col("stop").isNotNull().alias("terminal"),
        x(F.col("year")).alias("x_fork"), x(F.coalesce("stop", F.lit(last_year))).alias("x_end"), (TOP + F.col("lane") * LANE).alias("y"), (TOP + F.col("from_lane") * LANE).alias("y_from"),
    )


def numbers_chart(points: DataFrame) -> DataFrame:
    """Points (series, axis_max, value) with ``pct`` of the series' axis: the given one, else its largest value and 1 at least."""
    top = F.greatest(F.max("value").over(Window.partitionBy("series")), F.lit(1.0))
    return points.withColumn("pct", round1(F.least(F.greatest(F.col("value") / F.coalesce("axis_max", top) * 100, F.lit(0.0)), F.lit(100.0))))


def decade_headers(events: DataFrame) -> DataFrame:
    """``events`` in order of year and date with ``header``: the decade where it changes."""
    now = decade(F.col("year"))
    rows = ordered.previous(events.withColumn("_day", F.coalesce("date", F.lit(""))), ["year", "_day", "id"], now, "_before")
    header = F.when(~F.col("_before").eqNullSafe(now), F.concat(now.cast("string"), F.lit("s")))
    return rows.select(*events.columns, header.alias("header"))


def intensity(total: Column, largest: Column) -> Column:
    """The step, 1 to 4, of a cell's shade; null for an empty cell."""
    step = F.when(largest > 1, F.ceil(total / largest * 4)).otherwise(F.lit(4))
    return F.when(total > 0, step.cast("int"))


def tier_ranks(countries: DataFrame, tiers: DataFrame) -> DataFrame:
    """``countries`` (tier, ...) with ``rank``, the place of their tier (id, pos) from 0; null for one undeclared."""
    return countries.join(tiers.groupBy("id").agg(F.max("pos").alias("rank")), F.col("tier") == F.col("id"), "left").drop("id")


def indirect_edges(data: DataFrame) -> DataFrame:
    """(repo, indirect): whether any node of any lineage tree of a dataset has an indirect edge."""
    from loomstone.operators.records import leaves

    lineage = data.select("repo", F.expr("try_variant_get(v, '$.lineage.trees', 'variant')").alias("rec")).filter("rec is not null")
    edges = leaves(lineage).filter(F.col("path").rlike(r"^\[\d+\]\.root(\.children\[\d+\])*\.edge$") & (F.col("leaf") == "indirect")).select("repo").distinct()
    return data.select("repo").distinct().join(edges.withColumn("has", F.lit(True)), "repo", "left").select("repo", F.coalesce("has", F.lit(False)).alias("indirect"))


def lineage_nodes(data: DataFrame) -> DataFrame:
    """(repo, label, name, edge) of the nodes of lineage trees: ``label`` is the tree's place and those of the children on the way, from 0."""
    from loomstone.operators.records import leaves

    lineage = data.select("repo", F.expr("try_variant_get(v, '$.lineage.trees', 'variant')").alias("rec")).filter("rec is not null")
    node = r"^(\[\d+\]\.root(?:\.children\[\d+\])*)\.(name|edge)$"
    rows = leaves(lineage).filter(F.col("path").rlike(node)).select("repo", F.regexp_extract("path", node, 1).alias("at"), F.regexp_extract("path", node, 2).alias("key"), "leaf")
    label = F.transform(F.regexp_extract_all("at", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    last = lambda key: F.max(F.when(F.col("key") == key, F.col("leaf"))).alias(key)
    return rows.groupBy("repo", "at").agg(last("name"), last("edge")).select("repo", label.alias("label"), "name", "edge")


def reading_order(nodes: DataFrame, deepest: int = 1 << 20) -> DataFrame:
    """``nodes`` (id, parent, pos, ...) with root, depth from 0 and place from 1: depth first, children by ``pos``, then id.

    Labels of places on the way from the root grow by doubling: each round joins
    a node to the one its label reaches up to, so rounds go with the logarithm
    of the depth, and no query recurses. Nodes whose way ends at none (a parent
    that there is not, a circle) are left out; ``deepest`` bounds the rounds.
    """
    scratch = Scratch(nodes.sparkSession, "order")
    step = F.array(F.struct(F.col("pos").cast("long").alias("pos"), F.col("id").alias("id")))
    at = scratch.write(nodes.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"), step.alias("label")), "l0")
    rounds = 0
    while 1 << rounds < deepest and not at.filter("up is not null").isEmpty():
        above = at.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("root").alias("top"), F.col("label").alias("before"))
        # A parent that there is not drops its subtree.
        joined = at.filter("up is not null").join(above, "up").select("id", F.col("further").alias("up"), F.col("top").alias("root"), F.concat("before", "label").alias("label"))
        rounds += 1
        at = scratch.write(at.filter("up is null").unionByName(joined), f"l{rounds}")
        scratch.drop(f"l{rounds - 1}")
    whole = at.filter("up is null and root is not null").select("id", "root", "label", (F.size("label") - 1).alias("depth"))
    # Prefixes sort before what they begin, so a parent comes before its children; roots apart, one numbering serves all trees.
    placed = ordered.numbered(whole.withColumn("key", F.struct("root", "label")), ["key"], "place").select("id", "root", "depth", "place")
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    own = placed.join(first, "root").select("id", "root", "depth", (F.col("place") - F.col("first") + 1).alias("place"))
    return nodes.join(own, "id")
