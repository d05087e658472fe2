"""Behaviour of single operators on small inline tables."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomstone import session
from loomstone.functions import dates, fold, web
from loomstone.operators import consistency, entities, graph, index, layout, mining, records, search, textflow, validate, vocabulary
from loomstone.operators.components import connected_components
from loomstone.session import Scratch
from loomstone.sources import readers, sinks


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first()["x"]


def test_accents_fold_but_other_letters_stay(spark):
    assert one(spark, fold.fold_key(F.col("t")), t="Élève—ŁÓDŹ  ß ø") == "eleve odz"


def test_phonetic_key_joins_spellings(spark):
    keys = {one(spark, fold.name_key(F.col("t")), t=x) for x in ("Lefebvre", "Lefevre", "Mons. Lefébre")}
    assert len(keys) <= 2 and one(spark, fold.name_key(F.col("t")), t="Dom de la Thomas") == "la tomas"


def test_name_variants_split_dashes_and_aliases(spark):
    assert one(spark, fold.name_variants(F.col("t")), t="FSSP — Priestly Fraternity (Old Name)") == ["FSSP", "Priestly Fraternity", "Old Name"]


def test_conjunctions_need_two_names(spark):
    assert one(spark, fold.conjunction_parts(F.col("t")), t="Guénon e Schuon").left == "Guénon"
    assert one(spark, fold.conjunction_parts(F.col("t")), t="Guénon e outros") is None


def test_only_full_dates_are_dates(spark):
    assert one(spark, dates.iso_date(F.col("t")), t="1988-06-30") == datetime.date(1988, 6, 30)
    assert one(spark, dates.iso_date(F.col("t")), t="1988") is None


def test_rounding_is_up_at_the_half(spark):
    assert one(spark, dates.round1(F.col("t").cast("double")), t="-0.25") == -0.2


def test_broken_snapshot_stamp_is_infinitely_old(spark):
    assert one(spark, dates.age_days(F.col("t"), F.lit("2024-01-01").cast("timestamp")), t="2023") == float("inf")


def test_year_range():
    assert dates.parse_year_range("1900-1910") == (1900, 1910)
    with pytest.raises(ValueError):
        dates.parse_year_range("soon")


@pytest.mark.parametrize("text,kept", [("A. " * 5, 3), ("A. A. A.", 3), ("A. B. A. B. A. B. A. B.", 8)])
def test_runs_of_sentences(spark, text, kept):
    assert one(spark, textflow.normalise(F.col("t")), t=text).count(".") == kept


def test_phrase_across_a_line_break_is_found(spark):
    assert one(spark, search.phrase_positions(textflow.squeeze(F.col("t")), search.Phrase(("of", "the"))), t="one of\nthe many of the") == 2


def test_captions_drop_what_the_last_line_ends_with(spark):
    assert one(spark, textflow.caption_lines(F.split("t", ",")), t="go home,home,go,go,home") == ["go home", "go", "home"]


def test_query_grammar():
    tree = search.parse('(a OR "b c"*) NOT ^d')
    assert tree.kind == "NOT" and tree.parts[1].initial and search.phrases(tree)[1] == search.Phrase(("b", "c"), True)
    for bad in ("", "(a", "a )", '"', "OR"):
        with pytest.raises(search.QueryError):
            assert search.parse(bad) and bad != "OR" or search.parse("*")


def test_near_and_prefix(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "alphabet")], "id int, text string")
    assert [r.id for r in search.bm25(docs, "NEAR(alpha beta, 2)").collect()] == [1]
    assert sorted(r.id for r in search.bm25(docs, "alpha*").collect()) == [1, 2, 3]


def test_expansion_reports_itself():
    text, made = search.expand("Guenon", {"guenon": ["ghenon", "genon"]})
    assert text == '("Guenon" OR "genon" OR "ghenon")' and made == [("Guenon", ["genon", "ghenon"])]


def test_ambiguous_name_gives_all_candidates(spark):
    table = spark.createDataFrame([("ada lima", "Ada Lima", ["lima b"]), ("bea lima", "Bea Lima", ["x"])], "key string, canonical string, variants array<string>")
    assert [r.key for r in search.suggest("lima", table).collect()] == ["ada lima", "bea lima"]


def test_canonical_table_never_merges_on_similarity(spark):
    rows = spark.createDataFrame([(1, "René Guénon"), (2, "Rene Guenon"), (2, "Rene Guenonn"), (3, "R. Guenon")], "doc int, surface string")
    table = {r.key: r for r in entities.canonical_table(entities.postings(rows)).collect()}
    assert table["rene guenon"].docs == 2 and table["rene guenon"].merged_by == "fold" and len(table) == 3
    pairs = entities.suggestions(entities.canonical_table(entities.postings(rows)))
    assert ("rene guenon", "rene guenonn", "edit1") in {tuple(r) for r in pairs.collect()}


def test_components_and_degrees(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)], "a int, b int")
    found = {r.node: r.component for r in connected_components(edges, Scratch(spark, "t")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a int, b int")
    assert {r.component for r in connected_components(chain, Scratch(spark, "t")).collect()} == {0}
    nodes = spark.createDataFrame([(1,), (2,), (7,)], "entity int")
    found = graph.degrees(nodes, spark.createDataFrame([(1, 2, 4)], "source int, target int, weight long"))
    assert {tuple(r) for r in found.collect()} == {(1, 1, 4), (2, 1, 4), (7, 0, 0)}


def _seq(spark, days):
    return spark.createDataFrame([(i, datetime.date.fromisoformat(d) if d else None) for i, d in enumerate(days)], "n int, d date")


def test_neighbour_anomalies(spark):
    found = consistency.neighbour_anomalies(_seq(spark, ["2001-01-06", "2002-01-13", "2001-01-20"])).collect()
    assert [(r.n, r.kind) for r in found] == [(1, "probable-year-typo")]
    assert consistency.neighbour_anomalies(_seq(spark, ["2001-02-06", "2000-01-13", "2001-01-20"])).count() == 0
    assert consistency.neighbour_anomalies(_seq(spark, [])).count() == 0


def test_denials_are_scoped_to_their_label(spark):
    assert one(spark, consistency.affiliation_terms(F.col("t")), t="adjacent to it; never a member") == ["!member", "adjacent"]
    assert one(spark, consistency.affiliation_terms(F.col("t")), t="never a member. later a member") == ["member"]


def test_divergence(spark):
    rows = spark.createDataFrame(
        [("a", "k1", ["member"]), ("b", "k1", ["!member"]), ("a", "k2", ["critic"]), ("b", "k2", ["founder"]), ("a", "k3", ["critic"]), ("b", "k3", []), ("a", "k4", ["x"])],
        "repo string, key string, terms array<string>",
    )
    assert {(r.key, r.status) for r in consistency.divergence(rows).collect()} == {("k1", "contradiction"), ("k2", "differs"), ("k3", "ok")}


def test_a_comma_does_not_split_places(spark):
    gazetteer = spark.createDataFrame([("rome", "Rome", ["Roma"]), ("oporto", "Porto", None)], "place_id string, name string, variants array<string>")
    rows = spark.createDataFrame([(1, "roma / Porto"), (2, "Rome, Italy")], "id int, place string")
    assert {(r.id, r.part, r.place_id) for r in consistency.resolve_places(rows, gazetteer).collect()} == {(1, "roma", "rome"), (1, "Porto", "oporto"), (2, "Rome, Italy", None)}


def test_gaps_collapse_only_when_long(spark):
    present = spark.createDataFrame([(1500,), (1880,), (1900,)], "decade int")
    rows = [tuple(r) for r in layout.decade_columns(present).orderBy("start").collect()]
    assert rows == [("decade", 1500, 1509, 1), ("break", 1510, 1879, 37), ("decade", 1880, 1889, 1), ("decade", 1890, 1899, 1), ("decade", 1900, 1909, 1)]
    assert layout.decade_columns(present.filter("decade < 0")).count() == 0


def test_empty_lane_keeps_its_row_and_events_count_in_each_lane(spark):
    events = spark.createDataFrame([(1990, True, ["a", "b"]), (1991, False, ["a"]), (1992, None, None)], "year int, verified boolean, threads array<string>")
    lanes = spark.createDataFrame([("a",), ("b",), ("c",)], "lane string")
    assert {(r.lane, r.total, r.unverified) for r in layout.swimlanes(events, lanes).collect()} == {("a", 2, 1), ("b", 1, 0), ("c", 0, 0)}


@pytest.mark.parametrize("status,verdict", [(404, "dead"), (403, "inconclusive"), (429, "inconclusive"), (500, "inconclusive"), (200, "ok"), (0, "inconclusive")])
def test_inconclusive_is_not_dead(spark, status, verdict):
    assert one(spark, web.link_verdict(F.lit(status), F.lit(status), F.lit(False), F.col("t"), F.col("t")), t="An archive") == verdict


def test_markers_show_their_text(spark):
    assert one(spark, web.strip_markers(F.col("t")), t="a [[x|shown]] b [[y]]") == "a shown b y"
    assert one(spark, web.marker_ids(F.col("t")), t="none") == []


TALK = """A talk | Channel
https://host.invalid/x — transcript: auto-captions
=======================

Bom dia, então é isso, não é.
>> Em 1988 dom Marcel Lefebvre sagrou
quatro bispos em Écône.
>> Exatamente. O Lefevre disse que a
missa de 1962 seria mantida.
Havia cerca de 600 padres e 95% dos
fiéis apoiavam, segundo o Lefébvre.
Em julho de 2026 tudo mudou. [Music] e [Music]
"""


def mined(spark, text, kind, lang="pt", width=200):
    rows = mining.mine(spark.createDataFrame([("x", text, lang)], "doc_id string, text string, lang string"), (kind,), width=width).collect()
    return sorted(rows, key=lambda r: r["at"])


def test_scanner_keeps_its_distance(spark):
    raw = "Title\n====\nIn 1988 it began. " + "word " * 40 + "By 1999 it ended, in 1999."
    found = mined(spark, raw, "dated", "en", 120)
    assert [x.match for x in found] == ["1988", "1999"] and (found[0].line, found[0].char) == (3, 14)


def test_items_lead_back_to_the_file(spark):
    lines = TALK.split("\n")
    dated = mined(spark, TALK, "dated")
    assert [x.match for x in dated] == ["1988", "julho"]  # 1962 is too near
    for x in [*dated, *mined(spark, TALK, "quote"), *mined(spark, TALK, "name")]:
        assert TALK[x.char :].startswith(x.match.split()[0]) and x.match.split()[0] in lines[x.line - 1]
    assert "host.invalid" not in mining.Joined(TALK).text
    own = spark.createDataFrame([(TALK,)], "t string").select(mining.joined_text(F.col("t")).alias("j"), mining.language(mining.joined_text(F.col("t"))).alias("l")).first()
    assert own.j == mining.Joined(TALK).text and own.l == "pt"


def test_one_number_stands_for_its_sentence(spark):
    found = mined(spark, TALK, "number")
    assert [x.match for x in found] == ["600 padres"] and "95%" in found[0].context
    assert mined(spark, "foi em 1988 e pronto", "number") == []
    assert [x.match for x in mined(spark, "eram 12 000 pessoas. " + "e " * 60 + "milhares de fiéis.", "number")] == ["12 000 pessoas", "milhares de fiéis"]


def test_quotes_by_language(spark):
    assert [x.match for x in mined(spark, TALK, "quote")] == ["disse"]
    assert [x.match for x in mined(spark, "yo vi eso", "quote", "es")] == ["yo vi"]
    assert [x.match for x in mined(spark, "when I left, he insisted", "quote", "en")] == ["when I left"]
    assert mined(spark, "a conta de energia", "quote") == [] and mined(spark, None, "quote") == []


def test_dates_by_language(spark):
    assert [x.match for x in mined(spark, "in May we left, on June 30 too", "dated", "en")] == ["June 30"]
    assert [x.match for x in mined(spark, "de 50 anos, em 62 foi", "dated", "pt")] == ["em 62"]
    assert [x.match for x in mined(spark, "el siglo XIX", "dated", "es")] == ["siglo XIX"]


def test_context_ends_with_its_sentence():
    text = "Uma frase antes. O evento de 1988 aconteceu aqui. Depois disso."
    import numpy as np

    flow = mining.Joined(text)
    lo, hi = flow.windows(np.array([text.index("1988")]), 40)
    assert text[lo[0] : hi[0]] == " O evento de 1988 aconteceu aqui."[-(hi[0] - lo[0]) :] and lo[0] >= 16


def test_names_by_spelling(spark):
    df = spark.createDataFrame([("x", TALK), ("y", "b\n====\nEntendi. entendi mesmo, entendi."), ("z", "we saw Ana de Souza, Rui\nand Ana de Souza")], "doc_id string, text string")
    found = {(r.doc_id, r["name"]): r for r in mining.names(df, least=1).collect()}
    one = next(r for (d, _), r in found.items() if d == "x" and r.cluster == "lefevre")
    assert one.n == 2 and len(one.spellings) == 2 and one.free == 2 and one.line == 8
    assert ("x", "Marcel Lefebvre") in found and ("z", "Ana de Souza") in found and ("z", "Ana de Souza Rui") in found
    assert not any(d == "y" for d, _ in found) and not any(n in ("Music", "Exatamente") for _, n in found)
    assert found["z", "Ana de Souza"].total == 2 and [r["name"] for r in mining.names(df.filter("doc_id = 'z'")).collect()] == []


def test_sheet_has_four_sections(spark):
    df = spark.createDataFrame([("x", TALK + " Marcel Lefebvre"), ("n", None)], "doc_id string, text string")
    rows = {r.section: r for r in mining.sheet(df, most=1).collect()}
    assert sorted(rows) == ["dated", "name", "number", "quote"] and {r.doc_id for r in rows.values()} == {"x"}
    assert rows["dated"].total == 2 and len(rows["dated"]["items"]) == 1 and rows["name"]["items"][0].match


def test_records_of_absent_sections_are_empty(spark):
    data = spark.createDataFrame([("r", '{"events": [{"title": "T", "year": 1990, "verified": false}], "facts": []}')], "repo string, j string").select("repo", F.parse_json("j").alias("v"))
    rows = records.records(data)
    assert [(r.locator,) for r in rows.select("locator").collect()] == [("events[0]",)]
    assert [(r.path, r.reason) for r in records.flags(rows).select("path", "reason").collect()] == [("verified", "verified:false")]


def test_nothing_checked_is_not_a_pass(spark):
    empty = spark.createDataFrame([], "rule string, severity string")
    assert validate.verdict(empty, empty).first().code == 2


def test_readers(spark, tmp_path):
    (tmp_path / "one" / "data").mkdir(parents=True)
    (tmp_path / "one" / "data" / "chronology.json").write_text('{"events": [{"title": "T"}]}')
    row = readers.datasets(spark, f"{tmp_path}/*/data/*.json").first()
    assert (row.repo, row.kind) == ("one", "chronology")
    snaps = spark.createDataFrame([("one", '{"snapshots": {"https://x": {"refId": "r", "timestamp": "20240101000000"}}}')], "repo string, j string").select("repo", F.parse_json("j").alias("v"))
    assert readers.archives(snaps).first().ref_id == "r"
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01 --> 00:02\n<c>go home</c>\n\n00:02 --> 00:03\nhome\n")
    text = spark.read.text(str(tmp_path / "a.vtt"), wholetext=True).select(F.lit("a").alias("file"), F.col("value").alias("text"))
    assert readers.caption_text(text).first().text == "go home"
    lines = ["| Actual | Variants |", "|---|---|", "| **Guénon** | `genon`, ghenon (3), xy — no |", "", "| Other | b |"]
    table = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")
    assert {tuple(r) for r in readers.variant_table(table).collect()} == {("Guénon", "genon"), ("Guénon", "ghenon")}


def test_source_track_is_never_a_translation(spark):
    listing = '{"subtitles": {}, "automatic_captions": {"en": [{"ext": "vtt", "url": "https://x/?lang=pt&tlang=en"}], "pt": [{"ext": "vtt", "url": "https://x/?lang=pt&kind=asr"}]}}'
    data = spark.createDataFrame([("r", listing)], "repo string, j string").select("repo", F.parse_json("j").alias("v"))
    row = readers.source_tracks(data).first()
    assert (row.lang, row.kind) == ("pt", "asr")


def test_sinks(spark, tmp_path):
    with pytest.raises(sinks.WriteRefused):
        sinks.guard("x/data/report.txt")
    assert sinks.splice("a\n<!--s-->\nold\n<!--e-->\nb", "new", "<!--s-->", "<!--e-->") == ("a\n<!--s-->\nnew\n<!--e-->\nb", "replaced")
    with pytest.raises(ValueError):
        sinks.splice("<!--s-->", "new", "<!--s-->", "<!--e-->")
    docs = spark.createDataFrame([(1, "en", "One of\nthe many."), (2, "fr", None)], "doc_id long, collection string, text string")
    sinks.write_index(docs, f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/index/postings").count() == 4 and spark.read.parquet(f"{tmp_path}/index/docs").count() == 2


def test_records_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([(k, str(k)) for k in range(50)], "k long, v string")
    sinks.write_records(rows.repartition(7), f"{tmp_path}/cache", "k")
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "cache").glob("part-*"))]
    assert [json.loads(x)["k"] for part in parts for x in part] == list(range(50))
    with pytest.raises(sinks.WriteRefused):
        sinks.write_records(rows, f"{tmp_path}/data/cache", "k")
    assert readers.read_or_empty(spark, f"{tmp_path}/none", "name string").collect() == []
    (tmp_path / "broken.json").write_text("{")
    assert [r for r in readers.read_or_empty(spark, f"{tmp_path}/broken.json", "name string").collect() if r.name] == []
    read = lambda path: spark.read.schema("k long").json(path)
    assert readers.first_source([None, f"{tmp_path}/none", f"{tmp_path}/cache"], read)[0] == f"{tmp_path}/cache"
    assert readers.first_source([f"{tmp_path}/none"], read) is None


def test_makers_of_translations_are_kept_unless_the_run_wrote_them(spark):
    strings = spark.createDataFrame([("pt", "a"), ("pt", "b"), ("es", "a")], "lang string, key string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    before = spark.createDataFrame([("pt", "Ana")], "lang string, made_by string")
    found = lambda by: {(r.lang, r.coverage, r.made_by) for r in sinks.translation_meta(strings, wanted, before, by).collect()}
    assert found(None) == {("pt", "2/3", "Ana"), ("es", "1/3", "unknown")} and found("run") == {("pt", "2/3", "run"), ("es", "1/3", "run")}


@pytest.mark.parametrize("name,text", [("t01_dated", "He left in 1834. "), ("t03_numbers", "Then 77% had gone. "), ("t04_quotes", "He said they had gone. "), ("t05_sheet", "He left in 1834. ")])
def test_mining_queries_read_whole_texts(spark, tmp_path, name, text):
    """n_chars is null, too small or right; the texts are the same."""
    from loomstone.plans.catalogue import QUERIES

    whole = "x" * 500 + ". " + text
    rows = [(3, whole, "en", "s", None), (6, whole, "en", "s", 3), (9, whole, "en", "s", len(whole))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in QUERIES[name](spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append(str(r).replace("1803", "Y").replace("1806", "Y").replace("1809", "Y").replace(f"doc_id={r.doc_id}", ""))
    assert sorted(found) == [3, 6, 9] and sorted(found[3]) == sorted(found[6]) == sorted(found[9])


def test_quotes_within_words_are_found(spark):
    docs = [(1, "inhabitants of the city went home"), (2, "of the"), (3, "often"), (4, None), (5, "x, of the!"), (6, "on the city")]
    quotes = [(1, "of the"), (2, "ants of the city w"), (3, "te"), (4, ""), (5, None), (6, "e city went home"), (7, "f")]
    found = consistency.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string"))
    assert {tuple(r) for r in found.collect()} == {(i, d) for i, q in quotes for d, t in docs if q and t and q in t}
    assert consistency.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes[3:4], "item_id long, quote string")).count() == 0


def test_snippet_brackets_the_phrase(spark):
    text = "Of course, the end of the road: of all, Of The"
    assert one(spark, search.snippet(F.col("t"), search.Phrase(("of", "the")), 6), t=text) == "… course the end [of the] road …"
    assert one(spark, search.snippet(F.col("t"), search.Phrase(("of", "the")), 20), t=text) == "Of course the end [of the] road of all [Of The]"
    assert one(spark, search.snippet(F.col("t"), search.Phrase(("of", "road"))), t=text) is None


def test_subject_names_once_each(spark):
    meta = spark.createDataFrame([("r", "Écône", ["Econe", "Seminary (SX)", None, "Timeline"], "a house (old Name)")], "repo string, title string, altTitles array<string>, subtitle string")
    assert [r["name"] for r in vocabulary.subject_names(meta, "timeline").orderBy("pos").collect()] == ["Écône", "Seminary", "SX", "old Name"]


def test_manifest_takes_the_last_visited(spark):
    items = ",".join(f'{{"file": "a.txt", "title": "t{i}", "tags": ["x", "y"]}}' for i in range(12))
    data = spark.createDataFrame([("r", f'{{"items": [{items}]}}')], "repo string, j string").select("repo", F.parse_json("j").alias("v"))
    assert [r.title for r in readers.manifest(data).collect()] == ["t11"]


def test_index_search_reads_postings(spark, tmp_path):
    long = "alpha\nbeta gamma. " + "filler words here " * 120 + "alpha beta ends"
    docs = spark.createDataFrame(
        [(1, long, "a", "yes"), (2, "gamma beta alpha", "b", None), (3, None, "a", "yes"), (4, "", "b", "yes"), (5, "Alphá alpha beta", "b", "yes")],
        "doc_id long, text string, collection string, review string",
    )
    path = f"{tmp_path}/index"
    sinks.write_index(docs, path)
    found = lambda q, **k: [(r["doc_id"], r["offset"]) for r in index.search_index(spark, path, q, **k).collect()]
    assert sorted(found('"alpha beta"')) == [(1, 0), (1, 1100), (5, 0)]
    assert found('"alpha beta"', only="b") == [(5, 0)] and found("beta", review="yes", only="b") == [(5, 0)]
    assert found("^gamma") == [(2, 0)] and found("gam* NOT filler") == [(2, 0)] and found("absent") == []
    assert found("NEAR(gamma alpha, 1)", only="b") == [(2, 0)]
    assert sorted(found('"alpha alpha"')) == [(5, 0)]
    top = index.search_index(spark, path, '"alpha beta"', only="b").first()
    assert top["snippet"] == "Alphá [alpha beta]"
    plan = index.hits(spark, path, "beta")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,beta)" in plan and "body" not in plan


def test_files_meet_their_manifest(spark):
    files = spark.createDataFrame([("a.txt",), ("b.tar.gz",), (".hidden",)], "name string")
    entries = spark.createDataFrame([("a.txt", "A1", "T"), ("b.tar.gz", None, "U")], "file string, id string, title string")
    coverage = spark.createDataFrame([("A1", 0.5), ("b.tar", 0.25)], "doc_id string, coverage double")
    rows = {r["name"]: (r["doc_id"], r["title"], r["coverage"]) for r in index.catalogue_files(files, entries, coverage).collect()}
    assert rows == {"a.txt": ("A1", "T", 0.5), "b.tar.gz": ("b.tar", "U", 0.25), ".hidden": (".hidden", None, None)}


def test_near_misses_lose_no_close_key(spark):
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(6, 12))) for _ in range(250)]
    table = entities.canonical_table(spark.createDataFrame([(i, "a" + w) for i, w in enumerate(words)], "doc long, surface string"))
    keys = [r["key"] for r in table.collect()]
    names = ["a" + "".join(draw.choice("abc") for _ in range(draw.randint(7, 12))) for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    wanted = {(n, k) for n in names for k in keys if n != k and distance(n, k) <= 2}
    found = entities.near_misses(spark.createDataFrame([(n,) for n in names], "name string"), table, most=10_000)
    assert {(r["name"], r["key"]) for r in found.collect() if r["why"].startswith("edit")} == wanted and wanted


def test_leaves_of_a_deep_record(spark):
    deep = '{"a":' * 60 + '[1,{"b":"x"},[],{}]' + "}" * 60
    rows = spark.createDataFrame([(1, deep), (2, '{"c":null,"d":[["y"]]}'), (3, None), (4, '"bare"')], "id long, t string").select("id", F.parse_json("t").alias("rec"))
    found = {(r["id"], r["path"], r["name"], r["leaf"]) for r in records.leaves(rows).collect()}
    stem = ".".join("a" * 60)
    assert found == {(1, f"{stem}[0]", "a", "1"), (1, f"{stem}[1].b", "b", "x"), (2, "c", "c", None), (2, "d[0][0]", "d", "y"), (4, "", "", "bare")}


def test_suggestions_are_ranked_with_names_of_two(spark):
    from loomstone.operators import reports

    pairs = [(1, "Anna Bell and Rosa Luna"), (2, "Anna Bell"), (3, "Anna Bell"), (4, "Anna Bella"), (5, None)]
    table = entities.canonical_table(entities.postings(spark.createDataFrame(pairs, "doc long, surface string")))
    rows = reports.ranked_suggestions(table).collect()
    assert [(r["kind"], r["place"], r["total"]) for r in rows] == [("edit1", 1, 4), ("token-subset", 2, 4), ("shared-token", 3, 4), ("conjunction", 4, 4)]
    assert len(reports.ranked_suggestions(table, most=1).collect()) == 1
    empty = reports.incomplete_line(spark.createDataFrame([(1, None), (2, 0.9)], "doc_id long, coverage double"))
    assert empty.collect() == []


def test_glossaries_and_witnesses_without_entries(spark):
    texts = [("g", "glossary", '{"terms":[{"id":"a","term":"A"},{"id":"a","term":"B","variants":"x"},{"term":"no id"},"s"]}'), ("c", "chronology", '{"terms":[{"id":"z"}]}')]
    data = spark.createDataFrame(texts, "repo string, kind string, t string").withColumn("v", F.parse_json("t"))
    assert [tuple(r) for r in readers.glossary(data).collect()] == [("g", "a", "B", "x")]
    assert readers.witness(data).collect() == [] and readers.filename_witness(data).collect() == []
    assert readers.transcript_entries(data).collect() == []


def test_doubled_glyphs(spark):
    rows = [(1, "Y gaarra, ñcill ñrr."), (2, "TThhee ccaatt  ssaatt\n oonn tthhee mmaatt aanndd 𝒳𝒳 ssttaayyeedd.."), (3, "The committee agreed: all bookkeepers need good coffee."), (4, ""), (5, None), (6, "aa\nbbc")]
    found = validate.corpus_shape(spark.createDataFrame(rows, "doc_id long, text string")).filter("message = 'doubled glyphs'")
    assert sorted(x.locator for x in found.collect()) == ["2", "6"]


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Pairs of entities and documents of surfaces are counted by more tasks than the session's partitions, with the same results."""
    monkeypatch.setattr(session, "MOST_ROWS", 100)
    rows = [(i // 4, i * 7919 % 97) for i in range(4000)] + [(None, 5), (None, 6), (3, None)]
    pairs = spark.createDataFrame(rows, "doc int, entity int")
    edges = graph.cooccurrence(pairs)
    assert edges.rdd.getNumPartitions() == 81
    docs, want = {}, {}
    for d, e in rows:
        if d is not None and e is not None:
            docs.setdefault(d, set()).add(e)
    for own in docs.values():
        for a in own:
            for b in own:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(x.source, x.target): x.weight for x in edges.collect()} == want
    names = pairs.select("doc", F.concat(F.when(F.col("entity") % 2 == 0, "Ana ").otherwise("ANA "), F.col("entity").cast("string")).alias("surface"))
    found = {x.key: (x.docs, x.variants) for x in entities.canonical_table(names.union(names.limit(9))).collect()}
    assert found == {f"ana {e}": (sum(e in own for own in docs.values()), 1) for e in range(97)}
    assert [session.tasks_for(spark, n) for n in (0, 50, 900)] == [1, 1, 9]


def test_numbers_are_tried_where_they_can_begin():
    r = random.Random(9)
    pieces = "12 1.200 3,5 ٣ 77% 9 % R$ r$ US$ uſ$ $ € £ 40 mil MİL milhões Milhão milhares bilhões bilhão thousand THOUSANDS million billion hundred millón millones miles de anos people priests por cento per cent x ab mi bil th ١٢% 1834".split()
    texts = ["".join(p + r.choice(["", " ", "  ", "\n"]) for p in r.choices(pieces, k=60)) for _ in range(3000)]
    pattern = re.compile(mining.numbers_pattern(), re.IGNORECASE)
    assert all([(m.start(), m[0]) for m in mining.number_matches(pattern, t)] == [(m.start(), m[0]) for m in pattern.finditer(t)] for t in texts)
    assert sum(1 for t in texts for _ in pattern.finditer(t)) > 10_000


def test_each_different_word_is_folded_once(monkeypatch):
    calls, plain = [], mining._plain
    monkeypatch.setattr(mining, "_plain", lambda s: calls.append(s) or plain(s))
    found = mining.found_names(mining.Joined("we know Pedro and pedro pédro " + "word " * 1000))
    assert [(x[3], x[7]) for x in found] == [("Pedro", 2)] and len(calls) < 20


def test_dates_and_quotes_are_tried_where_they_can_begin():
    r = random.Random(4)
    words = "12 1834 1999 '88 '62 62 ٣ em Em até ATÉ ate desde ano De de anos 1/2/2003 3-4-99 junho June JULHO may mar March sept 1990s 80s 19th 3rd century século Siglo XIX in since of until by January março Enero disse Disse afirmou segundo acordo com according to SAYS claimed told eu vi me lembro I saw yo recuerdo según Negou na minha experiência my experience when left quando saí . , x ab"
    texts = ["".join(p + r.choice(["", " ", " ", "  ", "\n", "-"]) for p in r.choices(words.split(), k=60)) for _ in range(600)]
    texts += ["uſ dıſse eu vi, ſaid in 1850", "İ said in 1850", ""]
    for make, kind in ((mining.dated_pattern, "dated"), (mining.quotes_pattern, "quote")):
        for lang in ("pt", "es", "en", "xx"):
            pattern, n = re.compile(make(lang), re.IGNORECASE), 0
            for t in texts:
                wanted = [(m.start(), m[0]) for m in pattern.finditer(t)]
                assert [(m.start(), m[0]) for m in mining.matches(pattern, t, mining.begins(kind, lang, t))] == wanted
                n += len(wanted)
            assert n > 200
    # Few places of a long text without such words are tried.
    assert len(mining.begins("dated", "en", "They went home and came back in winter. " * 500 + "in 1834")) <= 4


def test_sheet_reads_its_texts_once_and_deals_them(spark):
    df = spark.createDataFrame([("x", TALK, "pt")], "doc_id string, text string, lang string").coalesce(1)
    plan = mining.sheet(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and re.search(r"hashpartitioning\(k#\d+, t#\d+", plan)


def test_sheet_puts_rows_of_a_key_together(spark):
    r = random.Random(8)
    first, last = "Ana Rui Écio Marcel Mons Pedro pedro d'Arc X-Ray".split(), "Souza de Souza, Lefebvre Lefevre Lefébvre of Rome [Music] Costa. 'Lima".split()
    talk = lambda: ". ".join(f"{r.choice(first)} {r.choice(last)} said {r.randint(2, 99)}% left in {r.randint(1800, 1999)}" + " of them" * r.randint(0, 9) for _ in range(60))
    same = talk()
    rows = [(1, talk()), (1, talk()), (None, talk()), (None, talk()), (2, same), (2, same), (3, None), (4, "Ana and Ana")]
    df = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string").repartition(4)
    found = {(x.doc_id, x.section): (x.total, [tuple(i) for i in x["items"]]) for x in mining.sheet(df, most=12).collect()}
    item = F.struct("line", "char", "match", "context")
    others = mining.mine(df).filter("kind <> 'name'").groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(item)).alias("a"))
    wanted = {(x.doc_id, x.kind): (x.n, [tuple(i) for i in x.s]) for x in others.select("doc_id", "kind", F.size("a").alias("n"), textflow.even_sample(F.col("a"), 12).alias("s")).collect()}
    names = {}
    for x in mining.clusters(mining.mine(df, ("name",)), "doc_id").collect():
        names.setdefault(x.doc_id, []).append((-x.n, x["name"], (x.line, x.char, x["name"], f"n={x.n} spellings: {', '.join(x.spellings[:5])}")))
    wanted |= {(k, "name"): (len(v), [i for _, _, i in sorted(v)][:12]) for k, v in names.items()}
    assert found == wanted and {k for k, _ in found} == {1, None, 2, 4} and len(found) == 13
    lists = spark.range(1, 90).select("id", F.sequence(F.lit(1), F.col("id")).alias("a"))
    for most in (0, 1, 2, 7, 40):
        assert all(mining.evenly(x.a, most) == x.s for x in lists.select("a", textflow.even_sample(F.col("a"), most).alias("s")).collect())


def test_keys_of_names_are_those_of_the_column(spark):
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzçéÉQckhbvwsszphthßÞKſ'’-_9"
    names = ["".join(r.choice("ABCÉÇÀ") + "".join(r.choices(letters, k=r.randint(0, 9))) + r.choice([" ", " de ", " Dr "]) for _ in range(r.randint(1, 3))).strip() for _ in range(2000)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", fold.name_key(F.col("n")).alias("k")).collect()
    assert all(fold.key_of_name(x.n) == x.k for x in rows)
