"""Co-occurrence graphs: edges, degrees, components and their text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.web import escape_dot, escape_xml
from loomstone.session import PART, dealt, spread


def cooccurrence(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(source, target, weight) of entities that share ``least`` documents, from (doc, entity).

    Documents are dealt over as many tasks as the rows ask for. A document's
    entities are few, so that its pairs come from one row of them; they are
    counted within each part before these counts are summed up.
    """
    rows = pairs.count()
    own = dealt(pairs.select("doc", "entity").filter("doc is not null and entity is not null"), "doc", rows)
    lists = own.groupBy(PART, "doc").agg(F.array_sort(F.collect_set("entity")).alias("all"))
    first = lists.select(PART, "all", F.posexplode("all").alias("i", "source"))
    both = first.select(PART, "source", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("target"))
    counts = both.groupBy(PART, "source", "target").agg(F.count(F.lit(1)).alias("n")).drop(PART)
    # About two pairs a row.
    return spread(counts, 2 * rows, "source", "target").groupBy("source", "target").agg(F.sum("n").alias("weight")).filter(F.col("weight") >= least)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, degree, weighted), zero for isolated nodes."""
    ends = edges.select(F.col("source").alias("entity"), "weight").union(edges.select("target", "weight"))
    counts = ends.groupBy("entity").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted"))
    return nodes.select("entity").distinct().join(counts, "entity", "left").select("entity", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted", F.lit(0)).alias("weighted"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, k, line): the document's lines in order of part, then k."""
    head = nodes.sparkSession.createDataFrame(
        [
            (0, "0", '<?xml version="1.0" encoding="UTF-8"?>'),
            (0, "1", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'),
            (0, "2", '<key id="w" for="edge" attr.name="weight" attr.type="int"/>'),
            (0, "3", '<graph id="g" edgedefault="undirected">'),
            (3, "0", "</graph>"),
            (3, "1", "</graphml>"),
        ],
        "part int, k string, line string",
    )
    text = lambda c: escape_xml(F.col(c).cast("string"))
    node = nodes.select(F.lit(1).alias("part"), F.col("entity").cast("string").alias("k"), F.concat(F.lit('<node id="'), text("entity"), F.lit('"/>')).alias("line"))
    edge = edges.select(
        F.lit(2).alias("part"),
        F.concat_ws(" ", F.col("source").cast("string"), F.col("target").cast("string")).alias("k"),
        F.concat(F.lit('<edge source="'), text("source"), F.lit('" target="'), text("target"), F.lit('"><data key="w">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("line"),
    )
    return head.unionByName(node).unionByName(edge)


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, k, line) of the graph in DOT."""
    head = nodes.sparkSession.createDataFrame([(0, "", "graph g {"), (3, "", "}")], "part int, k string, line string")
    quoted = lambda c: F.concat(F.lit('"'), escape_dot(F.col(c).cast("string")), F.lit('"'))
    node = nodes.select(F.lit(1).alias("part"), F.col("entity").cast("string").alias("k"), F.concat(F.lit("  "), quoted("entity"), F.lit(";")).alias("line"))
    edge = edges.select(
        F.lit(2).alias("part"),
        F.concat_ws(" ", F.col("source").cast("string"), F.col("target").cast("string")).alias("k"),
        F.concat(F.lit("  "), quoted("source"), F.lit(" -- "), quoted("target"), F.lit(" [weight="), F.col("weight").cast("string"), F.lit("];")).alias("line"),
    )
    return head.unionByName(node).unionByName(edge)
