"""The query grammar, positions and scores against SQLite's full-text search."""

import itertools
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomstone.operators import index, search, textflow
from loomstone.sources import sinks

QUERIES = [
    "NEAR(a b c, 2)", "NEAR(c a b, 1)", 'NEAR("a b" c, 0)', "NEAR(a a, 1)", "NEAR(a* d, 3)", 'NEAR(a b) NOT "c d"', "title : a", "body : a NOT title : a", "- title : a", "{title body} : b", "-{title body} : b",
    "title : NEAR(a b, 1)", 'body : (a AND "b c") OR title : d', "title : (a OR body : b)", "NEAR(a b d, 4) OR ^c", "title : ^ a", "a b", '"a b" OR d', "TITLE : a", "a OR (b AND a) OR a", "(a OR (b c)) NOT (d AND e)", "(a NOT b) OR (c NOT (d e))",
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randint(0, 4))), " ".join(r.choices("abcdefghab", k=r.randint(1, 14)))) for i in range(150)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(body, title)")
    con.executemany("insert into t(rowid, body, title) values (?, ?, ?)", [(i, body, title) for i, title, body in rows])
    df = spark.createDataFrame([(i, t, b, "x") for i, t, b in rows], "doc_id long, title string, body string, collection string")
    path = f"{tmp_path_factory.mktemp('index')}/i"
    sinks.write_index(df.withColumnRenamed("title", "name").withColumnRenamed("body", "text"), path, title="name")
    return con, df, path


@pytest.mark.parametrize("query", QUERIES)
def test_hits_and_scores(spark, corpus, query):
    con, df, path = corpus
    want = {i: -s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (query,))}
    by_text = {r.doc_id: r.score for r in search.bm25(df, query, ["body", "title"]).collect()}
    by_index = {r.doc_id: r.score for r in index.hits(spark, path, query).collect()}
    assert set(by_text) == set(by_index) == set(want)
    if "NEAR" not in query:  # there the other engine counts the occurrences within the group alone
        assert all(abs(by_text[i] - s) < 1e-9 and abs(by_index[i] - s) < 1e-9 for i, s in want.items())


def test_index_reads_no_texts(spark, corpus):
    plan = index.hits(spark, corpus[2], "NEAR(a b, 2) OR title : c")._jdf.queryExecution().executedPlan().toString()
    assert "body:string" not in plan and "title:string" not in plan


def test_faulty_filters_are_errors():
    for bad in ["text : a", "title a : b :", "{title : a", "title :", ": a", "NEAR(title : a b)", "{nope} : a"]:
        with pytest.raises(search.QueryError):
            search.parse(bad, ("body", "title"))
    with pytest.raises(search.QueryError):
        search.parse("title : a")
    assert search.parse("well-known") == search.Phrase(("well", "known"))


def test_best_window(spark):
    text = "one two filler " + " ".join(f"x{i}" for i in range(30)) + " one two three near three four. " + " ".join(f"y{i}" for i in range(30))
    wanted = [search.Phrase(("one", "two")), search.Phrase(("three",)), search.Phrase(("two", "three"))]
    df = spark.createDataFrame([(1, text), (2, "no hit " * 30), (3, "Three"), (4, "")], "id int, t string")
    from pyspark.sql import functions as F

    found = {r.id: r.s for r in df.select("id", search.best_snippet(F.col("t"), wanted, 10).alias("s")).collect()}
    assert found[1] == "… x28 x29 [one two three] near [three] four y0 y1 …"
    assert found[2].startswith("no hit no") and found[2].endswith("…") and found[3] == "[Three]" and found[4] == ""


def test_near_by_all_places(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(i, [sorted(r.sample(range(40), r.randint(0, 4))) for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame([(i, *map(list, x)) for i, x in rows], "id int, a array<bigint>, b array<bigint>, c array<bigint>")
    sizes, n = [1, 2, 1], 3
    found = {x.id: x.hit for x in df.select("id", search.near([F.col(c) for c in "abc"], sizes, n).alias("hit")).collect()}
    want = {i: any(all(max(t) - (p + s) <= n for p, s in zip(t, sizes, strict=True)) for t in itertools.product(*x)) for i, x in rows}
    assert {k: bool(v) for k, v in found.items()} == want


@pytest.mark.parametrize("query", ["NEAR(a* d, 3)", "- title : a", '"a b" OR d', "(a NOT b) OR (c NOT (d e))"])
def test_top_by_blocks(spark, corpus, query):
    want = index.search_index(spark, corpus[2], query, most=7).drop("snippet").collect()
    assert index.top_hits(spark, corpus[2], query, most=7, seeds=1)[0].collect() == want


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BLOCK", 4)
    r = random.Random(1)
    rows = [(i, " ".join(["rare"] * (9 if i in (5, 70) else 0) + r.choices(["rare", *"abcdefgh"], weights=[1, *[30] * 8], k=40)), "x") for i in range(400)]
    sinks.write_index(spark.createDataFrame(rows, "doc_id long, text string, collection string"), f"{tmp_path}/i")
    top, report = index.top_hits(spark, f"{tmp_path}/i", "rare", most=2)
    assert [x.doc_id for x in top.collect()] == [5, 70] and report["read"] < report["blocks"] / 4
    assert index.top_hits(spark, f"{tmp_path}/i", "absent")[0].count() == 0


def test_an_index_is_dealt_by_its_texts(spark, tmp_path, monkeypatch):
    """However few shuffle partitions there are, tasks follow the texts; a block's postings lie sorted in one file and know its statistics."""
    monkeypatch.setattr(sinks, "PART_CHARS", 500, raising=False)
    monkeypatch.setattr(sinks, "BLOCK", 4)
    r = random.Random(4)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randint(0, 40))), "ab"[i % 2], "x") for i in range(300)]
    sinks.write_index(spark.createDataFrame(rows, "doc_id long, text string, name string, collection string"), f"{tmp_path}/i", title="name")
    chunks, got, blocks = (spark.read.parquet(f"{tmp_path}/i/{t}") for t in ("chunks", "postings", "blocks"))
    files = got.select("token", "block", "chunk", F.input_file_name().alias("f")).collect()
    per_block = {}
    for x in files:
        per_block.setdefault(x.block, set()).add(x.f)
    assert len({x.f for x in files}) > int(spark.conf.get("spark.sql.shuffle.partitions")) and all(len(f) == 1 for f in per_block.values())
    want, texts = {}, {i: {"body": t, "title": n} for i, t, n, _ in rows}
    for c in chunks.collect():
        for column, text in texts[c.doc_id].items():
            for k, w in enumerate(text.split()):
                want.setdefault((c.chunk, c.block, column, w), []).append(k)
    assert {(x.chunk, x.block, x.column, x.token): (x.tf, list(x.at)) for x in got.collect()} == {k: (len(v), v) for k, v in want.items()}
    held = {}
    for (_, block, column, w), v in want.items():
        held.setdefault((w, column, block), []).append(len(v))
    assert sorted((x.token, x.column, x.block, x.n, x.most) for x in blocks.collect()) == sorted((*k, len(v), max(v)) for k, v in held.items())


def test_runs_of_sentences_in_one_pass(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices(["A.", "B!", "c?"], weights=[6, 1, 1], k=n)) for n in (0, 1, 3, 4, 40, 200)] + [None, "A. " * 9 + "A", " ".join(["A.", "B."] * 100_000)]

    def brute(t):
        out = []
        for s in t.split(" "):
            if out[-3:] != [s] * 3:
                out.append(s)
        return " ".join(out)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [x.d for x in df.select("i", textflow.dedup_runs(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [None if t is None else brute(t) for t in texts]


def test_phrases_are_found_without_lists_of_words(spark):
    """Counts and snippets of a phrase against brute force; counting makes no list of words."""
    r = random.Random(6)
    texts = [r.choice(["", " ", "-"]) + "".join(w + r.choice([" ", ", ", " — "]) for w in r.choices(["a", "b", "Á", "ab", "a\u0301b", "Σας", "1"], k=r.choice([0, 1, 3, 30, 80]))) for _ in range(60)]
    df = spark.createDataFrame([(None,), *[(t,) for t in texts]], "t string")
    plain = df.select("t", textflow.tokens(F.col("t")).alias("w"), F.filter(F.split("t", r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "").alias("raw"))
    rows = plain.select("t", "w", "raw", F.transform("raw", lambda x: F.array_join(textflow.tokens(x), "")).alias("folded"), textflow.joined(F.col("t")).alias("j"), textflow.joined_size(textflow.joined(F.col("t"))).alias("n")).collect()
    assert all(x.t is None or (x.j, x.n) == (" ".join(x.w), len(x.w)) for x in rows)

    def starts(words, p):
        n = len(p.words)
        return [i for i in range(len(words) - n + 1) if all(words[i + k].startswith(w) if p.prefix and k == n - 1 else words[i + k] == w for k, w in enumerate(p.words))]

    def count(words, p):
        found, free = 0, 0
        for i in starts(words, p):
            if i >= free and (i == 0 or not p.initial):
                found, free = found + 1, i + len(p.words)
        return found

    def cut(raw, folded, p, width):
        at, n = starts(folded, p), len(p.words)
        if not at:
            return None
        begin = max(at[0] - width // 2, 0)
        shown = " ".join("[" * (i in at) + raw[i] + "]" * (i - n + 1 in at) for i in range(begin, min(begin + width, len(raw))))
        return "… " * (begin > 0) + shown + " …" * (begin + width < len(raw))

    for p in (search.Phrase(("a",)), search.Phrase(("a",), prefix=True), search.Phrase(("a", "a")), search.Phrase(("b", "a"), True), search.Phrase(("a", "b"), initial=True), search.Phrase(("σας",)), search.Phrase(("a", "a", "b"))):
        counted = df.select("t", search.phrase_positions(F.col("t"), p).alias("n"), search.snippet(F.col("t"), p, 6).alias("s"))
        got = {x.t: (x.n, x.s) for x in counted.collect()}
        assert got == {x.t: (None, None) if x.t is None else (count(x.w, p), cut(x.raw, x.folded, p, 6)) for x in rows}
    plan = df.select(search.phrase_positions(F.col("t"), p))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "split(" not in plan


def test_texts_take_no_part_in_the_join_of_docs(spark, tmp_path):
    """An index of docs and texts apart equals that of both in one table; doubled labels double no chunk, and a document knows its characters."""
    r = random.Random(7)
    rows = [(i, None if i == 3 else "" if i == 4 else "A.  B " * 900 if i == 5 else "q. " * 2000 if i == 6 else " ".join(r.choices("abcd", k=r.randint(0, 30))), "xy"[i % 2]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collection string")
    sinks.write_index(docs, f"{tmp_path}/one")
    labels = spark.createDataFrame([(i, "l") for i in (1, 1, 2)], "doc_id long, review string")
    sinks.write_index(docs.join(labels, "doc_id", "left"), f"{tmp_path}/two", texts=docs.select("doc_id", "text"))
    one, two = ({t: spark.read.parquet(f"{tmp_path}/{k}/{t}") for t in ("docs", "chunks", "postings", "blocks")} for k in ("one", "two"))
    for t, columns in (("chunks", ["chunk", "body", "words"]), ("postings", ["chunk", "token", "tf", "at"]), ("docs", ["doc_id", "collection", "chars"])):
        got = [sorted(map(repr, x[t].select(*columns).distinct().collect())) for x in (one, two)]
        assert got[0] == got[1]
    assert two["docs"].count() == 31 and two["chunks"].count() == one["chunks"].count()
    chars = docs.select("doc_id", F.length(textflow.normalise(F.coalesce("text", F.lit("")))).alias("chars"))
    assert {tuple(x) for x in one["docs"].select("doc_id", "chars").collect()} == {tuple(x) for x in chars.collect()}


def test_texts_are_folded_once_for_postings_and_counts(spark):
    """Words and their places are those of ``tokens`` for any letters, and no text is folded a second time by a filter."""
    odd = ["", "!!!", " a ", "Plain ASCII_text\t2\x0bb\x00c--d", "İstanbul Kelvin éa ̇x", "a b’c…d", "٣٤ xy � z", "ﬁn ǅ ß ΣΑΣ", "\U0001d54f\U0001f600q \U000e0100r", "a̸b ́", "é", None]
    df = spark.createDataFrame([(str(i), i // 4, "body", t) for i, t in enumerate(odd)], "chunk string, block long, column string, text string").coalesce(1)
    words = {x.chunk: x.w for x in df.select("chunk", textflow.tokens(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    counted = df.select("chunk", textflow.word_count(F.col("text")).alias("n")).collect()
    assert {x.chunk: x.n for x in counted} == {k: len(w) for k, w in words.items()}
    found = search.postings(df)
    got = {(x.chunk, x.token): list(x["at"]) for x in found.collect()}
    want = {}
    for c, listed in words.items():
        for k, w in enumerate(listed):
            want.setdefault((c, w), []).append(k)
    assert got == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_hits_and_their_statistics_read_postings_once(spark, corpus):
    """The search for a phrase's chunks is one step, which the number of chunks that hold it and the hits themselves share."""
    found = index.hits(spark, corpus[2], '"a b" OR c')
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
