"""Full-text search: postings, phrases, query trees, BM25, expansion, envelope."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.fold import deaccent, fold_key
from loomstone.operators.textflow import ended, half_folded, joined, joined_size, tokens

#: BM25 constants, and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Coverage below which a document counts as incomplete.
COMPLETE = 0.75
SNIPPET = 18


@dataclass(frozen=True)
class Phrase:
    """Words in a row; ``columns`` are those in which they count, None for all."""

    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] | None = None

    def within(self, column: str) -> bool:
        return self.columns is None or column.lower() in self.columns


@dataclass(frozen=True)
class Node:
    """AND, OR, NOT (left without right) or NEAR of its parts."""

    kind: str
    parts: tuple = field(default=())
    distance: int = 10


class QueryError(ValueError):
    """A query that the grammar doesn't allow."""


def _fold(text: str) -> list[str]:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return [w for w in re.split(r"[\W_]+", plain) if w]


def restricted(tree: Phrase | Node, columns: tuple[str, ...]) -> Phrase | Node:
    """The tree with all its phrases in ``columns`` alone; a filter within a filter leaves what both allow."""
    if isinstance(tree, Phrase):
        return replace(tree, columns=tuple(c for c in columns if tree.within(c)))
    return replace(tree, parts=tuple(restricted(p, columns) for p in tree.parts))


def parse(query: str, columns: tuple[str, ...] = ()) -> Phrase | Node:
    """The tree of a query: phrases, ``AND``, ``OR``, ``NOT``, ``NEAR(..., n)``, ``prefix*``, ``^first``, parentheses and column filters.

    A filter ``name :``, ``{a b} :``, or one of these after ``-`` for all others,
    stands before a phrase, a NEAR or a parenthesis; ``columns`` are the names
    there are.
    """
    marks = re.findall(r'"(?:[^"]|"")*"|[(){}:*^,+]|-(?=\s*(?:\{|[^\s(){}:"*^,+-]+\s*:))|[^\s(){}:"*^,+]+', query)
    at = 0
    known = tuple(c.lower() for c in columns)

    def peek() -> str | None:
        return marks[at] if at < len(marks) else None

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(marks) or expected and marks[at] != expected:
            raise QueryError(f"expected {expected or 'a term'} in {query!r}")
        at += 1
        return marks[at - 1]

    def phrase() -> Phrase:
        initial = peek() == "^" and bool(take())
        words: list[str] = []
        while True:
            mark = take()
            if mark in "(){}:*^,+":
                raise QueryError(f"unexpected {mark!r} in {query!r}")
            words += _fold(mark.strip('"') if mark[0] == '"' else mark)
            if peek() != "+":
                break
            take()
        prefix = peek() == "*" and bool(take())
        if not words:
            raise QueryError(f"a term without letters or digits in {query!r}")
        return Phrase(tuple(words), prefix, initial)

    def names() -> tuple[str, ...] | None:
        """The columns of a filter that begins here, if one does."""
        nonlocal at
        start, others = at, peek() == "-"
        if others:
            take()
        if peek() == "{":
            take()
            found = []
            while peek() not in ("}", None):
                found.append(take().strip('"').lower())
            take("}")
            take(":")
        elif at + 1 < len(marks) and marks[at + 1] == ":":
            found = [take().strip('"').lower()]
            take(":")
        else:
            at = start
            return None
        if missing := [c for c in found if c not in known]:
            raise QueryError(f"no column {missing[0]!r} for {query!r}")
        return tuple(c for c in known if (c in found) != others)

    def unit():
        columns = names()
        if columns is not None:
            return restricted(unit(), columns)
        if peek() == "(":
            take()
            inner = either()
            take(")")
            return inner
        if peek() == "NEAR" and at + 1 < len(marks) and marks[at + 1] == "(":
            take(), take()
            parts, distance = [phrase()], 10
            while peek() not in (")", ",", None):
                parts.append(phrase())
            if peek() == ",":
                take()
                distance = int(take())
            take(")")
            return Node("NEAR", tuple(parts), distance)
        return phrase()

    def both():
        parts = [without()]
        while peek() not in (None, ")", "OR", "NOT"):
            if peek() == "AND":
                take()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Node("AND", tuple(parts))

    def without():
        left = unit()
        while peek() == "NOT":
            take()
            left = Node("NOT", (left, unit()))
        return left

    def either():
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("OR", tuple(parts))

    if not marks:
        raise QueryError("an empty query")
    tree = either()
    if at < len(marks):
        raise QueryError(f"unexpected {marks[at]!r} in {query!r}")
    return tree


def phrases(tree: Phrase | Node) -> list[Phrase]:
    """The distinct phrases of a tree, in order; those under the right of NOT too."""
    if isinstance(tree, Phrase):
        return [tree]
    return list(dict.fromkeys(p for part in tree.parts for p in phrases(part)))


#: A word of a text: how often it stands there, its places in order; ``n`` and ``most`` are those of :func:`postings`.
POSTING = "token string, tf int, at array<int>, n int, most int"


def postings(df: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, block, column, and POSTING): a row for each different word of each text of ``df`` (chunk, block, column, text).

    The rows of a block must come in one task, which holds and sorts its rows:
    they leave it by token, then block, column and chunk. The first row of a
    token, block and column has ``n``, how many of the texts hold the word, and
    ``most``, how often it stands in one of them at most.
    """
    # No filter here: it would fold each text a second time.
    words = df.select("chunk", "block", "column", half_folded(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    kinds = dict(words.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        if not table.num_rows:
            return
        given = table["words"].chunk(0)
        lists = pc.ascii_split_whitespace(ended(given))
        flat = lists.flatten()
        # Blanks at the ends of a text leave an empty word.
        filled = pc.not_equal(flat, "")
        owner = np.repeat(np.arange(len(given)), lists.value_lengths().to_numpy())[filled.to_numpy(zero_copy_only=False)]
        flat, size = flat.filter(filled), np.bincount(owner, minlength=len(given))
        if not len(flat):
            return
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        coded = flat.dictionary_encode()
        names = pc.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(names), np.int64)
        place[names] = np.arange(len(names))
        key = place[coded.indices.to_numpy()] * len(size) + owner
        bits = len(key).bit_length()
        if int(key.max()).bit_length() + bits < 63:
            # Keys and places as one number: to sort numbers is cheaper than to sort places by keys.
            both = np.sort(key << bits | np.arange(len(key)))
            key, order = both >> bits, both & ((1 << bits) - 1)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        word, row = np.divmod(key[begins], len(size))
        tf = np.diff(np.append(begins, len(key)))
        # Rows come by block and column, so that those of a word are runs.
        block, column = table["block"].to_numpy(), table["column"].chunk(0).dictionary_encode().indices.to_numpy()
        group = np.cumsum(np.append(0, (np.diff(block) != 0) | (np.diff(column) != 0)))
        first = np.diff(word * len(size) + group[row], prepend=-1) != 0
        heads = np.flatnonzero(first)
        n, most = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
        n[heads], most[heads] = np.diff(np.append(heads, len(row))), np.maximum.reduceat(tf, heads)
        pos = pos[order]
        for k in range(0, len(row), 1 << 16):
            part = slice(k, k + (1 << 16))
            stops = np.append(begins[part], begins[part][-1] + tf[part][-1])
            at = pa.ListArray.from_arrays(pa.array(stops - stops[0], pa.int32()), pa.array(pos[stops[0] : stops[-1]], pa.int32()))
            own = [table[c].chunk(0).take(pa.array(row[part])) for c in ("chunk", "block", "column")]
            later = ~first[part]
            made = [coded.dictionary.take(pa.array(names[word[part]])), pa.array(tf[part], pa.int32()), at, pa.array(n[part], mask=later), pa.array(most[part], mask=later)]
            yield pa.RecordBatch.from_arrays([*own, *made], ["chunk", "block", "column", "token", "tf", "at", "n", "most"])

    return words.sortWithinPartitions("block", "column", "chunk").mapInArrow(run, f"chunk {kinds['chunk']}, block {kinds['block']}, column {kinds['column']}, {POSTING}")


def phrase_positions(text: Column, phrase: Phrase) -> Column:
    """How often a phrase occurs in a text: words and what lies between them are matched in the folded text itself, without a list of its words.

    The pattern begins with the first word, so that most places are passed over;
    what precedes it is looked at afterwards.
    """
    word, (first, *rest) = r"[\p{L}\p{N}\p{Co}]", map(re.escape, phrase.words)
    begin = rf"^[^\p{{L}}\p{{N}}\p{{Co}}]*+{first}" if phrase.initial else f"{first}(?<!{word}{first})"
    pattern = begin + "".join(rf"[^\p{{L}}\p{{N}}\p{{Co}}]++{w}" for w in rest) + (f"{word}*+" if phrase.prefix else f"(?!{word})")
    return F.regexp_count(F.lower(deaccent(text)), F.lit(pattern))


def phrase_starts(words: Column, phrase: Phrase) -> Column:
    """Places, from 0, at which a phrase starts in a list of folded words that is a lambda variable or a plain column."""

    def here(i: Column) -> Column:
        last = len(phrase.words) - 1
        parts = [F.try_element_at(words, i + k) == w if k < last or not phrase.prefix else F.try_element_at(words, i + k).startswith(w) for k, w in enumerate(phrase.words)]
        return reduce(lambda x, y: x & y, [F.coalesce(p, F.lit(False)) for p in parts])

    places = F.sequence(F.lit(1), F.lit(1)) if phrase.initial else F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    return F.transform(F.filter(places, here), lambda i: (i - 1).cast("long"))


def near(starts: list[Column], sizes: list[int], distance: int) -> Column:
    """Whether an occurrence of each phrase lies in one stretch: ``distance`` words at most from the end of each to the start of the last.

    ``starts`` are places in ascending or any order. One fold over all
    occurrences in order keeps the last place of each phrase, so it costs in
    proportion to their number; the smallest stretch that ends at an occurrence
    begins at these.
    """
    events = F.array_sort(F.concat(*[F.transform(s, lambda p: F.struct(p.alias("at"), F.lit(i).alias("phrase"))) for i, s in enumerate(starts)]))  # noqa: B023
    zero = F.struct(*[F.lit(None).cast("long").alias(f"l{i}") for i in range(len(starts))], F.lit(False).alias("hit"))

    def step(state: Column, e: Column) -> Column:
        last = [F.when(e["phrase"] == i, e["at"]).otherwise(state[f"l{i}"]) for i in range(len(starts))]
        fits = reduce(lambda x, y: x & y, [F.coalesce(e["at"] - p <= n + distance, F.lit(False)) for p, n in zip(last, sizes, strict=True)])
        return F.struct(*[p.alias(f"l{i}") for i, p in enumerate(last)], (state["hit"] | fits).alias("hit"))

    return F.aggregate(events, zero, step, lambda s: s["hit"])


#: Places of different columns are so far apart that no NEAR spans them.
COLUMN_STEP = 1 << 40


def text_near(texts: dict[str, Column]) -> Callable[[Node], Column]:
    """The test of a NEAR node over the texts of named columns."""

    def test(node: Node) -> Column:
        def over(words: Column) -> Column:
            starts = []
            for p in node.parts:
                own = [F.transform(phrase_starts(words[k], p), lambda i: i + k * COLUMN_STEP) for k, c in enumerate(texts) if p.within(c)]  # noqa: B023
                starts.append(F.concat(*own) if own else F.expr("cast(array() as array<bigint>)"))
            return near(starts, [len(p.words) for p in node.parts], node.distance)

        return F.element_at(F.transform(F.array(F.array(*[tokens(F.coalesce(t, F.lit(""))) for t in texts.values()])), over), 1)

    return test


def matches(tree: Phrase | Node, found: dict[Phrase, Column], near: Callable[[Node], Column] | None = None) -> Column:
    """The boolean of a tree over the counts of its phrases; ``near`` tests a NEAR node."""
    if isinstance(tree, Phrase):
        return found[tree] > 0
    if tree.kind == "NEAR":
        return near(tree)
    parts = [matches(p, found, near) for p in tree.parts]
    if tree.kind == "NOT":
        return parts[0] & ~parts[1]
    return reduce((lambda x, y: x & y) if tree.kind == "AND" else (lambda x, y: x | y), parts)


def scored(tree: Phrase | Node, test: Callable[[Phrase | Node], Column], active: Column | None = None, sure: bool = True) -> list[tuple[Phrase, Column | None]]:
    """The phrases that count for the score of a matching row, one for each place in the query, each with its condition if it has one.

    A phrase counts where all that encloses it matches: within an OR, a branch
    that doesn't match adds nothing. What stands right of NOT never counts.
    """
    if isinstance(tree, Phrase):
        return [(tree, active)]
    if tree.kind == "OR":
        return [x for p in tree.parts for x in scored(p, test, active, False)]
    if not sure:
        active = test(tree) if active is None else active & test(tree)
    parts = tree.parts[:1] if tree.kind == "NOT" else tree.parts
    return [x for p in parts for x in scored(p, test, active, True)]


def rank(counts: dict[Phrase, Column], parts: list[tuple[Phrase, Column | None]], df: dict[Phrase, Column], rows: Column, length: Column, mean: Column) -> Column:
    """The BM25 of a row from the counts of its phrases and the statistics of all rows."""

    def part(p: Phrase, active: Column | None) -> Column:
        idf = F.greatest(F.ln((rows - df[p] + 0.5) / (df[p] + 0.5)), F.lit(LEAST_IDF))
        tf = counts[p].cast("double")
        value = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        return value if active is None else F.when(active, value).otherwise(F.lit(0.0))

    return reduce(lambda x, y: x + y, [part(p, active) for p, active in parts])


def bm25(df: DataFrame, tree: Phrase | Node | str, text: str | list[str] = "text") -> DataFrame:
    """Rows of ``df`` that match, with ``score``: the BM25 of all phrases of the query, higher is better.

    ``text`` names one column or several, which filters of the query may name;
    a row's length is that of all of them. All occurrences of a phrase in a NEAR
    that matches count, those beside the stretch too. One pass counts the phrases of each text; the
    statistics are one row, which joins back by a broadcast of that row.
    """
    columns = [text] if isinstance(text, str) else text
    tree = parse(tree, tuple(columns)) if isinstance(tree, str) else tree
    wanted = phrases(tree)
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in columns}
    total = lambda parts: reduce(lambda x, y: x + y, parts, F.lit(0))
    counts = {f"_tf{i}": total([phrase_positions(t, p) for c, t in texts.items() if p.within(c)]) for i, p in enumerate(wanted)}
    counted = df.withColumns(counts | {"_len": total([joined_size(joined(t)) for t in texts.values()])})
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))])

    found = {p: F.col(f"_tf{i}") for i, p in enumerate(wanted)}
    test = lambda node: matches(node, found, text_near(texts))
    score = rank(found, scored(tree, test), {p: F.col(f"_df{i}") for i, p in enumerate(wanted)}, F.col("_n"), F.col("_len"), F.col("_avg"))
    hit = test(tree)
    return counted.filter(hit).join(F.broadcast(stats)).withColumn("score", score).select(*df.columns, "score")


def scope(df: DataFrame, registry: DataFrame, collection: str) -> DataFrame:
    """Documents searched in each registered collection, zero included."""
    counts = df.groupBy(collection).agg(F.count(F.lit(1)).alias("n"))
    return registry.join(counts, collection, "left").select(collection, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def canonical_key(c: Column) -> Column:
    """The key of a canonical name: without a parenthesis at its end, if more than two characters stay."""
    short = F.regexp_replace(c, r"\s*\([^)]*\)\s*$", "")
    return fold_key(F.when(F.length(short) > 2, short).otherwise(c))


def variant_map(rows: DataFrame) -> DataFrame:
    """(key, canonical, variants) from (canonical, variant): undecorated names are displayed, empty groups dropped."""
    keyed = rows.withColumn("key", canonical_key(F.col("canonical"))).filter(fold_key(F.col("variant")) != F.col("key"))
    return keyed.groupBy("key").agg(
        F.min_by("canonical", F.struct(F.col("canonical").contains("("), "canonical")).alias("canonical"),
        F.sort_array(F.collect_set("variant")).alias("variants"),
    )


def expand(query: str, variants: dict[str, list[str]]) -> tuple[str, list[tuple[str, list[str]]]]:
    """The query with variants of canonical terms added by OR, and the expansions made."""
    made: list[tuple[str, list[str]]] = []

    def widened(term: str) -> str:
        own = variants.get(" ".join(_fold(term)))
        quoted = lambda x: '"' + x.replace('"', '""') + '"'
        if not own:
            return quoted(term)
        made.append((term, sorted(own)))
        return "(" + " OR ".join([quoted(term), *map(quoted, sorted(own))]) + ")"

    whole = query.strip().strip('"')
    if " ".join(_fold(whole)) in variants:
        return widened(whole), made
    terms = re.findall(r'"([^"]+)"|(\S+)', query)
    return " ".join(b if b in ("AND", "OR", "NOT") else widened(a or b) for a, b in terms), made


def suggest(query_key: str, variants: DataFrame) -> DataFrame:
    """Canonical names of which the query's words are a proper part, with variants that it doesn't cover."""
    mine = F.array(*map(F.lit, query_key.split()))
    key = F.split("key", " ")
    part = (F.size(F.array_except(mine, key)) == 0) & (F.size(F.array_distinct(key)) > len(set(query_key.split())))
    fresh = F.filter("variants", lambda v: F.size(F.array_except(mine, F.split(fold_key(v), " "))) > 0)
    return variants.filter(part).select("key", "canonical", fresh.alias("variants")).orderBy("key")


def trust_stamp(date: Column, verified: Column, review: Column, coverage: Column) -> Column:
    """What a reader should know of a hit's document: date, review, completeness."""
    dated = F.when(date.isNull(), F.lit("undated")).when(verified, date.cast("string")).otherwise(F.concat(date.cast("string"), F.lit(" unverified")))
    partial = F.when(coverage < COMPLETE, F.concat(F.lit("INCOMPLETE "), F.floor(coverage * 100 + 0.5).cast("string"), F.lit("%")))
    return F.concat_ws(" | ", dated, F.coalesce(review, F.lit("—")), partial)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    """(shown, folded): the words of a text as they stand there, and folded in a row, a blank on both sides of each."""
    shown = F.array_remove(F.split(text, r"[^\p{L}\p{N}\p{Co}]+"), "")
    # Words have no blanks, so that they can be folded as one text.
    return _bound(shown, lambda w: F.struct(w.alias("shown"), F.concat(F.lit(" "), F.lower(deaccent(F.array_join(w, " "))), F.lit(" ")).alias("folded")))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def snippet(text: Column, phrase: Phrase, width: int = SNIPPET) -> Column:
    """``width`` words around a phrase's first occurrence, each occurrence in brackets as a whole, and dots where words are left out.

    Of a phrase that ends in a prefix its last word need only begin so. The
    first occurrence is found in the text as a whole, and only words near to it
    are looked at one by one.
    """
    n = len(phrase.words)
    sought = " " + " ".join(phrase.words) + ("" if phrase.prefix else " ")

    def shown(x: Column) -> Column:
        first = _bound(F.substring(x["folded"], F.lit(1), F.instr(x["folded"], sought)), _blanks)
        return _bound(first, lambda first: F.when(first > 0, _bound(F.greatest(first - width // 2, F.lit(1)).cast("int"), lambda start: drawn(x["shown"], x["folded"], start))))

    def drawn(raw: Column, folded: Column, start: Column) -> Column:
        # The words from which an occurrence reaches into the window, and those that it may need.
        begin = F.greatest(start - (n - 1), F.lit(1)).cast("int")
        near = F.slice(F.split(folded, " "), begin + 1, F.lit(width + 2 * (n - 1)))

        def marked(y: Column) -> Column:
            def here(i: Column) -> Column:
                at = [F.try_element_at(y, (i - begin + 1 + k).cast("int")) for k in range(n)]
                tests = [a == w if k < n - 1 or not phrase.prefix else a.startswith(w) for k, (a, w) in enumerate(zip(at, phrase.words, strict=True))]
                return reduce(lambda p, q: p & q, [F.coalesce(t, F.lit(False)) for t in tests])

            def placed(hits: Column) -> Column:
                opens = lambda i: F.when(F.array_contains(hits, i), "[").otherwise("")
                closes = lambda i: F.when(F.array_contains(hits, i - (n - 1)), "]").otherwise("")
                words = F.transform(F.slice(raw, start, width), lambda w, k: F.concat(opens(start + k), w, closes(start + k)))
                dots = lambda test: F.when(test, F.lit("…"))
                return F.concat_ws(" ", dots(start > 1), F.array_join(words, " "), dots(start + width <= F.size(raw)))

            return _bound(F.filter(F.sequence(begin, start + width - 1), here), placed)

        return _bound(near, marked)

    return _bound(_words(text), shown)


def _starts(folded: Column, phrase: Phrase) -> Column:
    """Places, from 0, at which a phrase starts in folded words with a blank on both sides of each.

    The text is cut before each occurrence, overlapping ones too; a piece has
    as many words as blanks.
    """
    first = r"(?<=^\.)" if phrase.initial else ""
    body = " " + " ".join(map(re.escape, phrase.words)) + ("" if phrase.prefix else " ")
    pieces = F.split(F.concat(F.lit("."), folded), f"{first}(?={body})")
    sums = F.aggregate(pieces, F.array(F.lit(0)), lambda out, p: F.array_append(out, F.element_at(out, -1) + _blanks(p)))
    return _bound(sums, lambda a: F.slice(a, F.lit(2), F.size(a) - 2))


def best_snippet(text: Column, wanted: list[Phrase], width: int = SNIPPET) -> Column:
    """The ``width`` words with most distinct phrases, then most occurrences, the first such; each occurrence in brackets.

    A window is tried from each occurrence, and then moved so that what it holds
    stands in its middle, within the text. Overlapping occurrences share their
    brackets; a text without any gives its beginning.
    """

    def placed(x: Column) -> Column:
        own = [F.transform(_starts(x["folded"], p), lambda i: F.struct(i.alias("at"), F.lit(k).alias("phrase"), F.lit(len(p.words)).alias("size"))) for k, p in enumerate(wanted)]  # noqa: B023
        none = F.expr("cast(array() as array<struct<at: int, phrase: int, size: int>>)")
        return _bound(F.array_sort(F.concat(none, *own)), lambda hits: window(x["shown"], hits))

    def window(raw: Column, hits: Column) -> Column:
        def rated(h: Column) -> Column:
            held = F.filter(hits, lambda o: (o["at"] >= h["at"]) & (o["at"] < h["at"] + width))
            distinct = F.size(F.array_distinct(F.transform(held, lambda o: o["phrase"])))
            last = F.array_max(F.transform(held, lambda o: o["at"] + o["size"]))
            return F.struct(distinct.alias("distinct"), F.size(held).alias("n"), (-h["at"]).alias("first"), last.alias("last"))

        best = F.array_max(F.transform(hits, rated))
        middle = F.coalesce(-best["first"] - F.floor((width - (best["last"] + best["first"])) / 2), F.lit(0))
        start = F.greatest(F.least(middle, F.size(raw) - width), F.lit(0)).cast("int")
        return _bound(start, lambda s: drawn(raw, hits, s))

    def drawn(raw: Column, hits: Column, start: Column) -> Column:
        def word(w: Column, k: Column) -> Column:
            i = start + k
            opens = F.exists(hits, lambda o: o["at"] == i) & ~F.exists(hits, lambda o: (o["at"] < i) & (i < o["at"] + o["size"]))
            ends = F.exists(hits, lambda o: o["at"] + o["size"] - 1 == i) & ~F.exists(hits, lambda o: (o["at"] <= i) & (i + 1 < o["at"] + o["size"]))
            return F.concat(F.when(opens, "[").otherwise(""), w, F.when(ends, "]").otherwise(""))

        dots = lambda test: F.when(test, F.lit("…"))
        words = F.array_join(F.transform(F.slice(raw, start + 1, F.lit(width)), word), " ")
        return F.concat_ws(" ", dots(start > 0), words, dots(start + width < F.size(raw)))

    return _bound(_words(text), placed)
