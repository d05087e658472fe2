"""Readers: datasets, transcripts, manifests, alias maps, gazetteers, captions. All go through Spark's readers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.web import base_language
from loomstone.operators.records import leaves
from loomstone.sources.files import exists, listing, names


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """(repo, kind, v): one VARIANT per JSON file; the repository is the folder above ``data``."""
    rows = spark.read.option("multiLine", True).option("singleVariantColumn", "v").json(path).select("v", F.col("_metadata.file_path").alias("file"))
    repo = F.regexp_extract("file", r"([^/]+)/data/[^/]+$", 1)
    kind = F.when(F.expr("try_variant_get(v, '$.terms', 'variant') is not null"), F.lit("glossary")).otherwise(F.lit("chronology"))
    return rows.select(F.when(repo == "", F.regexp_extract("file", r"([^/]+)\.json$", 1)).otherwise(repo).alias("repo"), kind.alias("kind"), "v")


def archives(data: DataFrame) -> DataFrame:
    """(repo, url, ref_id, archive_url, timestamp) from VARIANT snapshot maps, wrapped in ``snapshots`` or bare."""
    inner = F.expr("coalesce(try_variant_get(v, '$.snapshots', 'map<string,variant>'), try_variant_get(v, '$', 'map<string,variant>'))")
    rows = data.select("repo", F.explode(inner).alias("url", "s"))
    get = lambda k: F.expr(f"try_variant_get(s, '$.{k}', 'string')")
    return rows.select("repo", "url", get("refId").alias("ref_id"), get("archiveUrl").alias("archive_url"), get("timestamp").alias("timestamp"))


def transcripts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """(file, name, text): whole text files of one folder, by name."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return rows.select("file", name.alias("name"), "text").filter(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*extensions))


def visited(path: Column) -> Column:
    """A path's place in the order of a walk: numbers count as numbers."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p))


def manifest(data: DataFrame) -> DataFrame:
    """(repo, file, id, title, date, review, url) of every nested object that names a file; the last one of a file wins."""
    rows = leaves(data.select("repo", F.col("v").alias("rec"))).withColumn("at", F.regexp_replace("path", r"\.?[^.]*$", ""))
    # Items of a list bear their list's name: the last one speaks for it.
    single = rows.groupBy("repo", "at", "name").agg(F.max_by("leaf", visited(F.col("path"))).alias("leaf"))
    wide = single.groupBy("repo", "at").agg(F.map_from_entries(F.collect_list(F.struct("name", "leaf"))).alias("m")).filter(F.col("m")["file"].isNotNull())
    m = F.col("m")
    out = wide.select(
        "repo", "at", F.regexp_extract(m["file"], r"([^/]+)$", 1).alias("file"), m["id"].alias("id"), F.coalesce(m["title"], m["indexTitle"]).alias("title"),
        F.coalesce(m["date"], m["establishedDate"], m["titleDate"]).alias("date"), F.coalesce(m["reviewStatus"], F.when(m["captured"].isNotNull(), F.lit("captured"))).alias("review"), F.coalesce(m["sourceUrl"], m["url"]).alias("url"),
    )
    own = F.struct("id", "title", "date", "review", "url")
    last = out.groupBy("repo", "file").agg(F.max_by(own, visited(F.col("at"))).alias("r"))
    return last.select("repo", "file", "r.*")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a corpus manifest: its ``docs``, which it must have."""
    rows = spark.read.option("multiLine", True).json(path)
    if "docs" not in rows.columns:
        raise ValueError(f"no docs in {path}")
    return rows.select(F.explode("docs").alias("d")).select("d.*")


def coverage(data: DataFrame, ids: str) -> DataFrame:
    """(doc_id, coverage): the figure without loops where there is one; ``ids`` makes an id of a number, as in ``DOC%03d``."""
    rows = data.select(F.explode(F.expr("try_variant_get(v, '$.aulas', 'map<string,variant>')")).alias("n", "c"))
    get = lambda k: F.expr(f"try_variant_get(c, '$.{k}', 'double')")
    return rows.select(F.format_string(ids, F.col("n").cast("int")).alias("doc_id"), F.coalesce(get("estimatedCoverageExLoops"), get("estimatedCoverage")).alias("coverage"))


def alias_map(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variant, canonical) rows and blocked name pairs (a, b); raises where a rule of the map is broken."""
    rows = data.select(F.explode(F.expr("try_variant_get(v, '$.aliases', 'array<variant>')")).alias("x"))
    text = lambda k: F.expr(f"try_variant_get(x, '$.{k}', 'string')")
    aliases = rows.select(text("canonical").alias("canonical"), text("reason").alias("reason"), text("source").alias("source"), F.expr("try_variant_get(x, '$.variants', 'array<string>')").alias("variants"))
    blocked = data.select(F.explode(F.expr("try_variant_get(v, '$.doNotMerge', 'array<variant>')")).alias("x")).select(F.expr("try_variant_get(x, '$.names', 'array<string>')").alias("names"), text("reason").alias("reason"))
    flat = aliases.select("canonical", F.explode("variants").alias("variant"))
    if not aliases.filter("coalesce(trim(reason), '') = '' or coalesce(trim(source), '') = ''").isEmpty():
        raise ValueError("an alias without reason or source")
    if not flat.groupBy("variant").agg(F.count_distinct("canonical").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a variant that two canonical names claim")
    if not blocked.filter("size(names) < 2 or coalesce(trim(reason), '') = ''").isEmpty():
        raise ValueError("a doNotMerge entry without two names or without reason")
    names = blocked.select(F.posexplode("names").alias("i", "a"), "names")
    pairs = names.select("a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"))
    return flat, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places: place_id, name, kind, lat, lon, precision, source, variants, note."""
    schema = "places array<struct<id:string,name:string,kind:string,lat:double,lon:double,precision:string,source:string,variants:array<string>,note:string>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("places").alias("p")).select(F.col("p.id").alias("place_id"), "p.name", "p.kind", "p.lat", "p.lon", "p.precision", "p.source", "p.variants", "p.note")


def gazetteer_index(places: DataFrame) -> DataFrame:
    """(key, place_id): names and variants of places without regard to case; of a key's places the one listed under the smallest id."""
    named = places.select("place_id", F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("variants", F.expr("cast(array() as array<string>)"))))).alias("name"))
    # Full case folding: the sharp s is two letters.
    keyed = named.select("place_id", F.replace(F.lower("name"), F.lit("ß"), F.lit("ss")).alias("key")).filter("trim(key) <> ''")
    return keyed.groupBy("key").agg(F.min("place_id").alias("place_id"))


def dictionary(data: DataFrame) -> DataFrame:
    """(lang, source, target) of translation dictionaries."""
    lang = F.expr("try_variant_get(v, '$._meta.targetLang', 'string')")
    return data.select(lang.alias("lang"), F.explode(F.expr("try_variant_get(v, '$.strings', 'map<string,string>')")).alias("source", "target"))


def variant_table(lines: DataFrame) -> DataFrame:
    """(canonical, variant) from Markdown tables given as (file, n, line).

    A table counts if its first heading names the actual name and its second
    the variants; any line without a pipe closes it.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("n")
    cells = F.transform(F.split(F.trim(F.col("line"), F.lit("| ")), r"\s*\|\s*"), lambda c: F.trim(c))
    row = F.col("line").contains("|")
    rows = lines.withColumn("cells", cells).withColumn("row", row)
    rows = rows.withColumn("head", F.col("row") & F.lower(F.col("cells")[0]).rlike("actual|philosopher") & F.lower(F.try_element_at("cells", F.lit(2))).rlike("variant|caption"))
    opened = F.last(F.when(F.col("head"), F.lit(True)).when(~F.col("row"), F.lit(False)), ignorenulls=True).over(order)
    body = rows.withColumn("open", opened).filter(F.col("open") & F.col("row") & ~F.col("head") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    name = F.trim(F.regexp_replace(F.col("cells")[0], r"\*\*|`", ""))
    return body.select(name.alias("canonical"), F.explode(variant_cell(F.try_element_at("cells", F.lit(2)))).alias("variant"))


def variant_cell(cell):
    """Variants of one cell: none if it says not to expand; up to a dash or semicolon, without counts, of three characters at least."""
    cut = F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s*[—;].*$", "")
    parts = F.transform(F.split(F.regexp_replace(cut, "`", ""), ","), lambda p: F.trim(F.regexp_replace(p, r"\(\d+\)", "")))
    kept = F.filter(parts, lambda p: (F.length(p) > 2) & ~p.rlike(r"^\(.*\)$"))
    return F.when(F.coalesce(cell, F.lit("")).contains("(do not expand)"), F.expr("cast(array() as array<string>)")).otherwise(kept)


def caption_text(rows: DataFrame) -> DataFrame:
    """(file, text) of WebVTT files: cues without times and tags, repeated lines dropped."""
    from loomstone.operators.textflow import caption_lines

    cleaned = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*>", "")))
    kept = F.filter(cleaned, lambda x: (x != "") & ~x.rlike(r"-->|^WEBVTT|^(Kind|Language):|^\d+$"))
    return rows.select("file", F.array_join(caption_lines(kept), "\n").alias("text"))


def source_tracks(data: DataFrame) -> DataFrame:
    """(repo, lang, url, kind) of the source caption track of each listing: human before automatic, never a translation."""
    found = None
    for rank, pool in enumerate(("subtitles", "automatic_captions")):
        rows = data.select("repo", F.explode(F.expr(f"try_variant_get(v, '$.{pool}', 'map<string,array<struct<ext:string,url:string>>>')")).alias("lang", "tracks")).select("repo", "lang", F.posexplode("tracks").alias("pos", "t"))
        rows = rows.select("repo", "lang", "pos", "t.*", F.lit(rank).alias("pool"))
        found = rows if found is None else found.unionByName(rows)
    usable = found.filter("ext = 'vtt' and try_parse_url(url, 'QUERY', 'tlang') is null")
    best = usable.groupBy("repo").agg(F.min_by(F.struct("lang", "url", "pool"), F.struct("pool", "lang", "pos")).alias("b"))
    lang = F.coalesce(F.expr("try_parse_url(b.url, 'QUERY', 'lang')"), F.col("b.lang"))
    kind = F.when(F.col("b.pool") == 0, F.lit("manual")).otherwise(F.coalesce(F.expr("try_parse_url(b.url, 'QUERY', 'kind')"), F.lit("asr")))
    return best.select("repo", lang.alias("lang"), F.col("b.url").alias("url"), kind.alias("kind"))


def expected_tracks(tracks: DataFrame, expected: DataFrame) -> DataFrame:
    """(repo, lang, expected, agrees) of source tracks and the languages (repo, lang) that were expected; base subtags are compared."""
    both = expected.select("repo", F.col("lang").alias("expected")).join(tracks.select("repo", "lang"), "repo", "left")
    return both.select("repo", "lang", "expected", F.coalesce(base_language(F.col("lang")) == base_language(F.col("expected")), F.lit(False)).alias("agrees"))


def first_source(candidates: list[str | None], read: Callable[[str], DataFrame]) -> tuple[str, DataFrame] | None:
    """The first candidate that can be read and holds a row, with its rows: an argument, a setting, a sibling folder, a URL."""
    for source in filter(None, candidates):
        try:
            found = read(source)
            if not found.isEmpty():
                return source, found
        except PySparkException:
            continue
    return None


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON records at a path; a missing path or a broken file gives none, with the same columns."""
    try:
        rows = spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED")
        rows.isEmpty()
        return rows
    except PySparkException:
        return spark.createDataFrame([], schema)


def skills(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, digest) of ``*/SKILL.md`` below a folder."""
    rows = spark.read.text(f"{path}/*/SKILL.md", wholetext=True).select(F.col("value").alias("text"), F.regexp_extract("_metadata.file_path", r"([^/]+)/SKILL\.md$", 1).alias("name"))
    return rows.select("name", "text", F.sha2(F.replace("text", F.lit("\r\n"), F.lit("\n")), 256).alias("digest"))


def resolve_path(name: str, home: str | None = None) -> str:
    """The folder of a dataset: a path as it is, a bare name below ``home``."""
    return name if re.search(r"[/:]", name) or not home else f"{home.rstrip('/')}/{name}"


def transcript_entries(data: DataFrame) -> DataFrame:
    """(repo, pos, id, file) of transcript manifests: the first list under docs, transcripts or items, or a bare list; else none."""
    lists = [F.expr(f"try_variant_get(v, '{path}', 'array<variant>')") for path in ("$.docs", "$.transcripts", "$.items", "$")]
    rows = data.select("repo", F.posexplode(F.coalesce(*lists)).alias("pos", "e"))
    return rows.select("repo", "pos", F.expr("try_variant_get(e, '$.id', 'string')").alias("id"), F.expr("try_variant_get(e, '$.file', 'string')").alias("file"))


def resolve_transcripts(wanted: DataFrame, entries: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(arg, path, id): what each ``arg`` means: an id or file of a manifest, else a path that exists, else a file of ``folder``.

    ``entries`` has (pos, id, file), of which the first that fits counts; ``files`` (path). What
    nothing knows stays as it is.
    """
    args = wanted.select("arg").distinct().withColumn("base", F.regexp_extract("arg", r"([^/]+)$", 1))
    # One row for each name that an entry answers to.
    names = entries.filter("file is not null").select("pos", "id", "file", F.explode(F.array("id", "file")).alias("name")).filter("name is not null")
    by_arg = args.join(names, F.col("arg") == F.col("name")).select("arg", "pos", "id", "file")
    by_base = args.join(names.filter("name = file"), F.col("base") == F.col("name")).select("arg", "pos", "id", "file")
    known = by_arg.union(by_base).groupBy("arg").agg(F.min_by(F.struct("id", "file"), "pos").alias("e"))
    paths = files.select("path").distinct().withColumn("there", F.lit(True))
    own = args.join(known, "arg", "left").join(paths.select(F.col("path").alias("arg"), F.col("there").alias("exists")), "arg", "left")
    guess = own.withColumn("guess", F.concat(F.lit(folder.rstrip("/") + "/"), "base"))
    found = guess.join(paths.select(F.col("path").alias("guess"), F.col("there").alias("guessed")), "guess", "left")
    path = F.when(F.col("e").isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), F.col("e.file"))).when(F.col("exists"), F.col("arg")).when(F.col("guessed"), F.col("guess")).otherwise(F.col("arg"))
    return found.select("arg", path.alias("path"), F.col("e.id").alias("id"))


def pinned_terms(data: DataFrame) -> DataFrame:
    """(repo, base, id, term) of pinned glossary ids, given as strings or as objects with an id; the last of an id counts."""
    base = F.coalesce(F.expr("try_variant_get(v, '$.baseUrl', 'string')"), F.lit(""))
    items = F.coalesce(F.expr("try_variant_get(v, '$.terms', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"))
    rows = data.select("repo", base.alias("base"), F.posexplode(items).alias("pos", "t")).withColumn("kind", F.expr("schema_of_variant(t)"))
    own = F.when(F.col("kind") == "STRING", F.expr("try_variant_get(t, '$', 'string')")).when(F.col("kind").startswith("OBJECT"), F.nullif(F.expr("try_variant_get(t, '$.id', 'string')"), F.lit("")))
    named = rows.select("repo", "base", "pos", own.alias("id"), F.coalesce(F.expr("try_variant_get(t, '$.term', 'string')"), F.lit("")).alias("term")).filter("id is not null")
    return named.groupBy("repo", "base", "id").agg(F.max_by("term", "pos").alias("term"))


def glossary(data: DataFrame) -> DataFrame:
    """(repo, id, term, variants) of datasets that are glossaries."""
    rows = data.filter("kind = 'glossary'").select("repo", F.posexplode(F.expr("try_variant_get(v, '$.terms', 'array<variant>')")).alias("pos", "t"))
    get = lambda k: F.expr(f"try_variant_get(t, '$.{k}', 'string')")
    own = rows.select("repo", "pos", get("id").alias("id"), F.coalesce(get("term"), F.lit("")).alias("term"), F.coalesce(get("variants"), F.lit("")).alias("variants")).filter("coalesce(id, '') <> ''")
    return own.groupBy("repo", "id").agg(F.max_by(F.struct("term", "variants"), "pos").alias("g")).select("repo", "id", "g.term", "g.variants")


def witness(data: DataFrame) -> DataFrame:
    """(n, d): the date that a witness's map of numbers gives each of them; none without a date."""
    rows = data.select(F.explode(F.expr("try_variant_get(v, '$.aulas', 'map<string,variant>')")).alias("n", "x"))
    date = F.expr("try_variant_get(x, '$.date', 'string')")
    return rows.select(F.col("n").try_cast("int").alias("n"), F.try_to_date(date, "yyyy-MM-dd").alias("d")).filter("n is not null and d is not null")


def filename_witness(data: DataFrame) -> DataFrame:
    """(n, d) of listings of files: numbers whose files bear exactly one date."""
    from loomstone.operators.consistency import single_date

    rows = data.select(F.explode(F.expr("try_variant_get(v, '$.files', 'array<variant>')")).alias("x"))
    number, date = F.expr("try_variant_get(x, '$.aula', 'int')"), F.expr("try_variant_get(x, '$.date', 'string')")
    return single_date(rows.select(number.alias("n"), F.try_to_date(date, "yyyy-MM-dd").alias("d")).filter("n > 0"))


def scan_folder(spark: SparkSession, path: str, extension: str = "txt") -> DataFrame:
    """(name, bytes, status, text) of every file of a folder, not of those below it.

    ``read``; ``broken`` with bytes that are no UTF-8, which are left out of the
    text; ``unreadable`` if it is listed but can't be read; ``skipped`` without
    the extension, of which nothing is read. All of them are counted. The list
    of names is made once, by the driver, as Spark makes its own.
    """
    listed = spark.createDataFrame(listing(spark, path), "name string, bytes long")
    content = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(path)
    read = content.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.lit(True).alias("there"))
    # Spark reads no file without bytes.
    empty = F.col("bytes") == 0
    rows = listed.join(read, "name", "left").withColumns({"there": F.coalesce("there", empty), "content": F.when(empty & F.endswith("name", F.lit(f".{extension}")), F.lit("").cast("binary")).otherwise(F.col("content"))})
    whole = F.expr("try_validate_utf8(cast(content as string))")
    status = F.when(~F.endswith("name", F.lit(f".{extension}")), "skipped").when(~F.col("there"), "unreadable").when(whole.isNull(), "broken").otherwise("read")
    plain = F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("\ufffd"), F.lit(""))
    return rows.select("name", "bytes", status.alias("status"), F.coalesce(whole, plain).alias("text"))


def known_roots(spark: SparkSession, base: str, marker: str = "data") -> list[str]:
    """The folders below ``base`` that hold a ``marker``, sorted: told from the listing alone."""
    return [n for n in names(spark, base) if not n.startswith(".") and exists(spark, f"{base}/{n}/{marker}")]


def resolve_root(spark: SparkSession, name: str, base: str, marker: str = "data") -> str:
    """The data folder of a dataset: ``name`` as a path that holds the marker, that is it, or as a folder below ``base``."""
    for place in (name, f"{base}/{name}"):
        if exists(spark, f"{place}/{marker}"):
            return f"{place.rstrip('/')}/{marker}"
    if re.search(r"/", name) and exists(spark, name):
        return name.rstrip("/")
    raise ValueError(f"no dataset {name!r}; known: {', '.join(known_roots(spark, base, marker)) or 'none'}")
