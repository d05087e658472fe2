"""Sinks: index tables, text documents, guarded writes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.web import text_digest
from loomstone.operators.consistency import sync_plan
from loomstone.operators.search import postings
from loomstone.operators.textflow import chunks, normalise, word_count

#: Folders and files that belong to a dataset, which no report may overwrite.
PROTECTED = re.compile(r"(^|/)(data|corpus)(/|$)|chronology[^/]*\.json$|glossary[^/]*\.json$")

#: Chunks of a block.
BLOCK = 128
#: Characters of texts whose chunks and postings one task writes, about.
PART_CHARS = 12_000_000


class WriteRefused(ValueError):
    """A write that would land on source data."""


def guard(path: str) -> str:
    if PROTECTED.search(path):
        raise WriteRefused(f"{path} belongs to a dataset")
    return path


def write_index(docs: DataFrame, path: str, collection: str = "collection", title: str | None = None, texts: DataFrame | None = None) -> None:
    """docs, chunks, postings and blocks of a corpus as Parquet, rebuilt from nothing.

    Words of ``title``, a column of ``docs``, are indexed with each chunk of
    their document, as a column of their own. Rows without a title have none.
    ``texts`` are ``doc_id``, ``text`` and the title of the same rows, for docs
    that are joined from several tables: their texts take no part in that join.

    Chunks of a document stand in a row and know their number of words, so that
    statistics read no text; BLOCK of them in a row share a block. Documents are
    dealt over tasks by the characters of all of them, PART_CHARS each, however
    many shuffle partitions the session has.
    """
    guard(path)
    spark = docs.sparkSession
    texts = docs if texts is None else texts
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    raw = texts.select("doc_id", "text", *([F.coalesce(title, F.lit("")).alias("title")] if title else []))
    dealt = raw.repartition(index_tasks(chars), "doc_id").sortWithinPartitions("doc_id")
    parts = chunks(dealt.withColumn("text", normalise(F.coalesce("text", F.lit("")))))
    parts = parts.withColumn("chunk", F.concat_ws(":", "doc_id", "offset")).withColumn("words", word_count(F.col("body")))
    if title:
        parts = parts.withColumn("words", F.col("words") + word_count(F.col("title")))
    write_chunks(parts, chars, path)
    # The last chunk of a text ends where the text does.
    ends = spark.read.parquet(f"{path}/chunks").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("offset") + F.length("body")).alias("_end"))
    own = docs.drop("text").join(ends, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("chars", F.coalesce("_end", F.lit(0)))
    own.drop("_id", "_end").write.mode("overwrite").partitionBy(collection).parquet(f"{path}/docs")


def index_tasks(chars: int) -> int:
    """Tasks that texts of so many characters are dealt over."""
    return max(1, -(-chars // PART_CHARS))


def write_chunks(parts: DataFrame, chars: int, path: str) -> None:
    """The tables ``chunks``, ``postings`` and ``blocks`` of an index from chunks in order, whose texts have ``chars`` characters.

    A block's chunks come into one task, which sorts their postings by token,
    then block, column and chunk: each file of postings is an index of its blocks, of
    which a search reads the row groups of its words, and no posting is shuffled.
    ``blocks`` has for each token, column and block the number of chunks that
    hold it, and the most occurrences in one of them.
    """
    spark, n = parts.sparkSession, index_tasks(chars)
    parts.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)).write.mode("overwrite").parquet(f"{path}/chunks")
    written = spark.read.parquet(f"{path}/chunks")
    named = [c for c in ("body", "title") if c in written.columns]
    dealt = written.select("chunk", "block", *named).repartition(n, "block")
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in named])).alias("_text")
    listed = postings(dealt.select("chunk", "block", texts).select("chunk", "block", "_text.*"))
    listed.write.mode("overwrite").parquet(f"{path}/postings")
    most = spark.read.parquet(f"{path}/postings").filter("most is not null").select("token", "column", "block", "n", "most")
    # They come in the order of the files that they are read from: a page of them holds words in a row.
    most.write.mode("overwrite").parquet(f"{path}/blocks")


def write_lines(lines: DataFrame, path: str) -> None:
    """A text document of (part, k, line) rows, in order, as sorted part files."""
    guard(path)
    lines.repartitionByRange("part", "k").sortWithinPartitions("part", "k").select("line").write.mode("overwrite").text(path)


def write_records(rows: DataFrame, path: str, *keys: str) -> None:
    """Rows as lines of JSON in the order of ``keys``, over part files that continue each other: caches, sheets, reports."""
    guard(path)
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def translation_meta(strings: DataFrame, wanted: DataFrame, previous: DataFrame, by: str | None = None, unknown: str = "unknown") -> DataFrame:
    """(lang, coverage, made_by) of each language's translations (lang, key), of the ``wanted`` keys.

    A cache keeps the maker that ``previous`` (lang, made_by) names, unless this
    run wrote the translations and says so by ``by``.
    """
    total = wanted.agg(F.count(F.lit(1)).alias("total"))
    counts = strings.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    known = counts.join(previous.select("lang", F.nullif("made_by", F.lit("")).alias("kept")), "lang", "left")
    return known.select("lang", F.concat_ws("/", "n", "total").alias("coverage"), F.coalesce(F.lit(by), "kept", F.lit(unknown)).alias("made_by"))


def vendored_manifest(source: DataFrame) -> DataFrame:
    """(name, sha256, bytes) of texts (name, text): the digest with plain line ends; ``bytes`` counts characters, as the format has it."""
    return source.select("name", text_digest(F.col("text")).alias("sha256"), F.length("text").cast("long").alias("bytes"))


def synced(source: DataFrame, copies: DataFrame) -> DataFrame:
    """(name, text, action): the copies after a sync of both (name, text): new and changed texts come in, stale copies go, others stay."""
    digests = [rows.select("name", text_digest(F.col("text")).alias("digest")) for rows in (source, copies)]
    plan = sync_plan(*digests).filter("action <> 'stale'")
    texts = plan.join(source.select("name", F.col("text").alias("new")), "name").join(copies.select("name", F.col("text").alias("old")), "name", "left")
    return texts.select("name", F.when(F.col("action") == "ok", F.col("old")).otherwise(F.col("new")).alias("text"), "action")


def splice(existing: str, block: str, start: str, stop: str) -> tuple[str, str]:
    """A text with the block between two marks replaced, or appended where there are none; and which was done."""
    begins, ends = existing.count(start), existing.count(stop)
    if begins != ends or begins > 1 or begins and existing.index(start) > existing.index(stop):
        raise ValueError("the marks of the generated block don't pair")
    made = f"{start}\n{block.strip()}\n{stop}"
    if begins:
        return existing[: existing.index(start)] + made + existing[existing.index(stop) + len(stop) :], "replaced"
    return (existing.rstrip() + "\n\n" if existing.strip() else "") + made + "\n", "appended"


def markdown(rows: DataFrame, group: str, line: str) -> DataFrame:
    """(group, text): a heading and a checklist for each group."""
    items = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit("- [ ] "), x)), "\n")
    return rows.groupBy(group).agg(F.concat(F.lit("## "), F.first(group), F.lit("\n\n"), items).alias("text"))
