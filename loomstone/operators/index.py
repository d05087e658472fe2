"""Search over a written index: hits and statistics come from postings, texts are read for the shown hits alone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.search import COLUMN_STEP, Node, Phrase, best_snippet, matches, near, parse, phrases, rank, scored

#: The columns whose words an index may have, in their order.
COLUMNS = ("body", "title")


def _near_phrases(tree: Phrase | Node) -> set[Phrase]:
    """Phrases that stand in a NEAR."""
    if isinstance(tree, Phrase):
        return set()
    return set(tree.parts) if tree.kind == "NEAR" else set().union(*map(_near_phrases, tree.parts))


def _wanted(token: Column, phrase: Phrase, k: int) -> Column:
    last = k == len(phrase.words) - 1
    return token.startswith(phrase.words[k]) if phrase.prefix and last else token == phrase.words[k]


def phrase_counts(postings: DataFrame, wanted: list[Phrase], placed: set[Phrase] = frozenset()) -> DataFrame:
    """(chunk, tf0, tf1, ...): how often each phrase starts in a chunk, for chunks with any of them.

    The filters on ``token`` and ``column`` reach the scan. A phrase stands
    where all its words are found at their places of one column from one start.
    Of phrases in ``placed``, ``at0``, ``at1``, ... are the starts.
    """
    token = F.col("token")
    places = [(i, k) for i, p in enumerate(wanted) for k in range(len(p.words))]
    rows = postings.filter(reduce(lambda x, y: x | y, [_wanted(token, wanted[i], k) for i, k in places]))
    allowed = [F.lit(True) if p.columns is None else F.col("column").isin(*p.columns) if p.columns else F.lit(False) for p in wanted]
    if all(p.columns is not None for p in wanted):
        rows = rows.filter(F.col("column").isin(*{c for p in wanted for c in p.columns}) if any(p.columns for p in wanted) else F.lit(False))
    roles = F.array_compact(F.array(*[F.when(_wanted(token, wanted[i], k) & allowed[i], F.struct(F.lit(i).alias("phrase"), F.lit(k).alias("k"), F.lit(1 << k).cast("long").alias("bit"))) for i, k in places]))
    found = rows.select("chunk", "column", "at", F.explode(roles).alias("role")).select("chunk", "column", "role", F.explode("at").alias("pos"))
    found = found.select("chunk", "column", "role.phrase", (F.col("pos") - F.col("role.k")).alias("start"), "role.bit")
    size = F.element_at(F.array(*[F.lit(len(p.words)) for p in wanted]), F.col("phrase") + 1)
    first = F.element_at(F.array(*[F.lit(p.initial) for p in wanted]), F.col("phrase") + 1)
    # Sets of places as bits, so that the map side combines them.
    whole = found.groupBy("chunk", "column", "phrase", "start").agg(F.bit_or("bit").alias("bits"))
    whole = whole.filter((F.bit_count("bits") == size) & (~first | (F.col("start") == 0)))
    tf = [F.count_if(F.col("phrase") == i).alias(f"tf{i}") for i in range(len(wanted))]
    place = F.col("start") + F.lit(COLUMN_STEP) * sum((F.when(F.col("column") == c, k).otherwise(0) for k, c in enumerate(COLUMNS)), F.lit(0))
    # A chunk's words are few.
    at = [F.collect_list(F.when(F.col("phrase") == i, place)).alias(f"at{i}") for i, p in enumerate(wanted) if p in placed]
    # No chunk is null. Said here, a join by chunk adds nothing that keeps the steps up to here from being shared by two uses.
    return whole.filter(F.col("chunk").isNotNull()).groupBy("chunk").agg(*tf, *at)


@dataclass
class Index:
    """The tables of an index: live rows alone, and ``size``, one row of the number of chunks (_n) and their mean length (_avg)."""

    docs: DataFrame
    chunks: DataFrame
    postings: DataFrame
    blocks: DataFrame
    size: DataFrame
    #: Whether ``blocks`` counts live chunks alone.
    whole: bool = True


def opened(spark: SparkSession, path: str) -> Index:
    """The index that one ``write_index`` wrote."""
    docs, chunks, postings, blocks = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "chunks", "postings", "blocks"))
    return Index(docs, chunks, postings, blocks, chunks.agg(F.count(F.lit(1)).alias("_n"), F.avg("words").alias("_avg")))


@dataclass
class Search:
    """A query over an index, with the filters of its documents."""

    index: Index
    tree: Phrase | Node
    collection: str = "collection"
    only: str | None = None
    review: str | None = None

    def __post_init__(self) -> None:
        self.wanted = phrases(self.tree)
        if any(len(p.words) > 63 for p in self.wanted):
            raise ValueError("a phrase of more than 63 words")

    def counts(self, blocks: DataFrame | None = None) -> DataFrame:
        rows = self.index.postings
        if blocks is not None:
            rows = rows.join(blocks, "block", "left_semi")
        return phrase_counts(rows, self.wanted, _near_phrases(self.tree))

    def frequencies(self) -> DataFrame:
        """One row: how many chunks hold each phrase."""
        return self.counts().agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"_df{i}") for i in range(len(self.wanted))])

    def score(self, counts: dict[Phrase, Column], length: Column, test) -> Column:
        return rank(counts, scored(self.tree, test), {p: F.col(f"_df{i}") for i, p in enumerate(self.wanted)}, F.col("_n"), length, F.col("_avg"))

    def hits(self, statistics: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """Matching chunks, of ``blocks`` alone if given; ``statistics`` is one row of _n, _avg and each phrase's _df."""
        place = {p: i for i, p in enumerate(self.wanted)}
        close = lambda node: near([F.col(f"at{place[p]}") for p in node.parts], [len(p.words) for p in node.parts], node.distance)
        found = {p: F.col(f"tf{i}") for p, i in place.items()}
        test = lambda node: matches(node, found, close)
        candidates = self.counts(blocks).join(self.index.chunks.select("chunk", "doc_id", "offset", "words"), "chunk").filter(test(self.tree))
        docs = self.index.docs
        if self.only is not None:
            docs = docs.filter(F.col(self.collection) == self.only)
        if self.review is not None:
            docs = docs.filter(F.col("review") == self.review)
        # One row of statistics.
        rows = candidates.join(docs, "doc_id").join(F.broadcast(statistics)).withColumn("score", self.score(found, F.col("words"), test))
        return rows.select(*docs.columns, "offset", "score")

    def bounds(self, statistics: DataFrame) -> DataFrame:
        """(block, bound): what no chunk of a block can exceed, for blocks that hold any phrase's words.

        A phrase occurs no more often than the rarest of its words; the score
        rises with occurrences and falls with length.
        """
        token = F.col("token")
        pieces = {}
        for i, p in enumerate(self.wanted):
            inside = F.lit(True) if p.columns is None else F.col("column").isin(*p.columns) if p.columns else F.lit(False)
            pieces |= {f"w{i}_{k}": _wanted(token, p, k) & inside for k in range(len(p.words))}
        rows = self.index.blocks.filter(reduce(lambda x, y: x | y, pieces.values()))
        held = rows.groupBy("block").agg(*[F.sum(F.when(test, F.col("most")).otherwise(F.lit(0))).alias(c) for c, test in pieces.items()])
        tf = {p: F.array_min(F.array(*[F.col(f"w{i}_{k}") for k in range(len(p.words))])) for i, p in enumerate(self.wanted)}
        held = held.join(self.index.chunks.groupBy("block").agg(F.min("words").alias("least")), "block")
        # Any branch may match, so that each phrase counts.
        return held.join(F.broadcast(statistics)).select("block", self.score(tf, F.col("least"), lambda node: F.lit(True)).alias("bound"))


def _search(spark: SparkSession, index: str | Index, query: Phrase | Node | str, collection: str, only: str | None, review: str | None) -> Search:
    return Search(opened(spark, index) if isinstance(index, str) else index, parse(query, COLUMNS) if isinstance(query, str) else query, collection, only, review)


def hits(spark: SparkSession, index: str | Index, query: Phrase | Node | str, collection: str = "collection", only: str | None = None, review: str | None = None) -> DataFrame:
    """Every chunk that matches: the columns of docs, ``offset`` and ``score``, in no order.

    Scores are BM25 over all chunks of the index. ``only`` keeps one value of
    the column ``collection``, ``review`` one of ``review``; neither changes
    the statistics. A phrase may have 63 words at most. No texts are read.
    """
    own = _search(spark, index, query, collection, only, review)
    return own.hits(own.index.size.join(own.frequencies()))


def top_hits(
    spark: SparkSession, index: str | Index, query: Phrase | Node | str, collection: str = "collection", only: str | None = None, review: str | None = None, most: int = 10, seeds: int = 8
) -> tuple[DataFrame, dict[str, int]]:
    """The ``most`` best of :func:`hits`, and how many blocks there were, and how many of them were read.

    Each block has a bound of its scores. The ``seeds`` blocks with the highest
    bounds are read first, and eight times as many while they hold too few hits;
    their hits tell the least score that is wanted, and blocks whose bound lies
    below it are skipped. The result is that of reading all.
    """
    own = _search(spark, index, query, collection, only, review)
    # One row each; it is collected, so that the statistics aren't found anew by each step.
    statistics = spark.createDataFrame(own.index.size.join(own.frequencies()).collect(), own.index.size.join(own.frequencies()).schema)
    bounds = own.bounds(statistics)
    total, least, read = bounds.count(), None, seeds
    while least is None and read < total:
        first = bounds.orderBy(F.desc("bound"), "block").limit(read).select("block")
        best = own.hits(statistics, first).orderBy(F.desc("score")).select("score").limit(most).collect()
        least = best[-1]["score"] if len(best) == most else None
        read *= 8
    # A share of the bound is left for what floating point rounds off.
    wanted = bounds if least is None else bounds.filter(F.col("bound") >= least * (1 - 1e-9))
    top = own.hits(statistics, wanted.select("block")).orderBy(F.desc("score"), "doc_id", "offset").limit(most)
    return top, {"blocks": total, "read": wanted.count()}


def search_index(
    spark: SparkSession, index: str | Index, query: Phrase | Node | str, collection: str = "collection", only: str | None = None, review: str | None = None, most: int = 10
) -> DataFrame:
    """The ``most`` best of :func:`hits` with ``snippet``, best first; ties by document, then offset.

    The shown rows, ``most`` of them, meet the texts by a broadcast; ``most`` is
    for a page of results, all hits come from :func:`hits`.
    """
    tree = parse(query, COLUMNS) if isinstance(query, str) else query
    index = opened(spark, index) if isinstance(index, str) else index
    best = [F.desc("score"), F.asc("doc_id"), F.asc("offset")]
    top = hits(spark, index, tree, collection, only, review).orderBy(*best).limit(most)
    shown = index.chunks.select("doc_id", "offset", "body").join(F.broadcast(top), ["doc_id", "offset"])
    cut = best_snippet(F.col("body"), [p for p in phrases(tree) if p.within("body")])
    return shown.select(*top.columns, cut.alias("snippet")).orderBy(*best)


def catalogue_files(files: DataFrame, manifest: DataFrame, coverage: DataFrame) -> DataFrame:
    """``files`` (name, ...) with the manifest's columns and ``coverage``: by file name, then by ``doc_id``.

    ``manifest`` has (file, id, ...) with each file once, ``coverage`` (doc_id, coverage).
    Without an entry, or without an id in it, ``doc_id`` is the name without its extension.
    """
    own = files.join(manifest.withColumnRenamed("file", "name").withColumnRenamed("id", "_id"), "name", "left")
    stem = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    known = own.withColumn("doc_id", F.coalesce(F.nullif("_id", F.lit("")), stem)).drop("_id")
    return known.join(coverage, "doc_id", "left")
