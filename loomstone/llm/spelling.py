"""Spelling variants: words one edit apart, and the much more frequent word that each is a form of.

Words are counted where their texts lie, a table of counts a task. Near words
are found by halves: of two words one edit apart, one holds a half of the other
unchanged, the first half at its start or the second one at its end. Words are
dealt into shards by length and hash; a shard's automaton (Aho-Corasick) holds
both halves of each of its words. All words of fitting lengths are scanned by
it in blocks; a hit counts if the half stands at the offset that it must have,
and the rest of both words is compared in arrays. A task holds one shard and
one block, whatever the size of the vocabulary, and gives one row a word: how
many near words it found, and the best of them. No pairs leave a task.

Defined results: a null text has no words; a null id counts as an empty string
before the colon; rows of one id are read one by one, repeated rows too; an
empty table gives an empty result; other columns are ignored; of near words
with equal counts the smallest in code-point order is taken; a very long text
is cut into words by stretches, and costs in proportion to its length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm import sql
from loomstone.llm.batches import slices
from loomstone.llm.text import UPPER
from loomstone.session import Scratch, load

LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: A run whose hash this divides loses a character.
DAMAGED = 199
#: Words of a shard's automaton, and of a block that it scans, about.
SHARD, BLOCK = 1 << 16, 1 << 14
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Characters of a text that are cut into words at once.
STRETCH = 1 << 20
#: Different lengths of words up to which the plan of shards is broadcast; beyond, it is joined by shuffles.
LENGTHS = 1 << 16
#: Cells of a table of comparisons.
CELLS = 1 << 21
_RUNS = bytes(b"\x20"[0] if not (chr(b).isascii() and chr(b).isalpha() or b >= 0xC0) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text, in Latin-1, stretch by stretch."""
    flat = text.encode("latin-1", "replace").translate(_RUNS)
    at = 0
    while at < len(flat):
        end = len(flat)
        if end - at > STRETCH:
            end = flat.rfind(b" ", at, at + STRETCH)
            end = flat.find(b" ", at + STRETCH) if end < 0 else end
            end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end + 1


def damaged(run: bytes, prefix: int) -> bytes:
    """The run, or what is left of it; ``prefix`` is the checksum of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % DAMAGED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n) over all texts, for words of ``least_chars`` characters at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return rows

        for batch in slices(batches, "t"):
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = zlib.crc32(f"{'' if ident is None else ident}:".encode())
                for stretch in runs(text):
                    for run, n in Counter(stretch).items():
                        if len(run) >= least_chars and len(word := damaged(run, prefix)) >= least_chars:
                            total[word] += n
                    if len(total) > COUNTED:
                        yield out()
        if total:
            yield out()

    texts = df.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are one edit apart; lengths differ by one at most."""
    if a.shape[1] < b.shape[1]:
        return _one_edit(b, a).T
    table = np.zeros((len(a), len(b)), np.int32)
    if a.shape[1] == b.shape[1]:
        for k in range(a.shape[1]):
            table += a[:, k, None] != b[None, :, k]
        return table == 1
    # One more character in ``a``: what they share from the left and from the right covers ``b``.
    for shift, order in ((0, range(b.shape[1])), (1, range(b.shape[1] - 1, -1, -1))):
        alike = np.ones(table.shape, bool)
        for k in order:
            alike &= a[:, k + shift, None] == b[None, :, k]
            if not alike.any():
                break
            table += alike
    return table >= b.shape[1]


def _pairs(own: list[str], scanned: list[str], size: int) -> np.ndarray:
    """Pairs (place in ``scanned``, place in ``own``) one edit apart, as numbers; all of ``own`` have ``size`` characters."""
    import ahocorasick

    cut = size // 2
    halves: dict[tuple[int, str], list[int]] = {}
    for j, v in enumerate(own):
        halves.setdefault((0, v[:cut]), []).append(j)
        halves.setdefault((1, v[cut:]), []).append(j)
    automaton = ahocorasick.Automaton()
    for half in {h for _, h in halves}:
        automaton.add_word(half, half)
    automaton.make_automaton()
    hits: dict[tuple[int, str, int], list[int]] = {}
    for i, w in enumerate(scanned):
        for end, half in automaton.iter(w):
            if end + 1 == len(half) and (0, half) in halves:
                hits.setdefault((0, half, len(w)), []).append(i)
            if end + 1 == len(w) and (1, half) in halves:
                hits.setdefault((1, half, len(w)), []).append(i)
    found = [np.zeros(0, np.int64)]
    for (side, half, length), at in hits.items():
        if abs(length - size) > 1:
            continue
        mine, h = np.array(halves[side, half]), len(half)
        rest = (lambda x: x[h:]) if side == 0 else (lambda x: x[: len(x) - h])  # noqa: B023
        b = _codes([rest(own[j]) for j in mine], size - h)
        step = max(1, CELLS // len(mine))
        for lo in range(0, len(at), step):
            part = np.array(at[lo : lo + step])
            i, j = np.nonzero(_one_edit(_codes([rest(scanned[x]) for x in part], length - h), b))
            found.append(part[i].astype(np.int64) * len(own) + mine[j])
    # A pair may be found by both halves.
    return np.unique(np.concatenate(found))


def _near(own: pa.Table, scanned: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) for the scanned words with near words in a shard."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    if not own.num_rows or not scanned.num_rows:
        return schema.empty_table()
    own = own.sort_by([("n", "descending"), ("word", "ascending")])  # so that the first is the best
    theirs, words = own.column("word").to_pylist(), scanned.column("word").to_pylist()
    pairs = _pairs(theirs, words, len(theirs[0]))
    i, first, near = np.unique(pairs // len(theirs), return_index=True, return_counts=True)
    best = pa.array(pairs[first] % len(theirs), pa.int64())
    return pa.Table.from_arrays([scanned.column("word").take(pa.array(i, pa.int64())), pa.array(near, pa.int64()), own.column("n").take(best), own.column("word").take(best)], schema=schema)


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, n_near, form_n, form) for each of ``words`` (word, n) with a word one edit away; form is the one of largest n."""
    sized = words.withColumn("size", F.length("word"))
    counts = sized.groupBy("size").agg(F.count(F.lit(1)).alias("rows"))
    around = counts.select(F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("size"), "rows").groupBy("size").agg(F.sum("rows").alias("around"))
    plan = scratch.write(counts.join(around, "size").select("size", F.ceil(F.col("rows") / SHARD).cast("int").alias("parts"), F.ceil(F.col("around") / BLOCK).cast("int").alias("blocks")), "plan")
    plan = F.broadcast(plan) if plan.count() <= LENGTHS else plan
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sized.join(plan, "size").select("size", F.pmod(F.xxhash64(F.lit("part"), "word"), F.col("parts")).cast("int").alias("part"), every("blocks").alias("block"), "word", "n")
    aimed = words.select(F.col("word").alias("scan"), F.explode(F.array(*[F.length("word") + d for d in (-1, 0, 1)])).alias("size")).join(plan, "size")
    scanned = aimed.select(F.col("size").alias("to"), F.pmod(F.xxhash64(F.lit("block"), "scan"), F.col("blocks")).cast("int").alias("in"), every("parts").alias("at"), F.col("scan").alias("word"))
    found = own.groupBy("size", "part", "block").cogroup(scanned.groupBy("to", "at", "in")).applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.word").alias("form"))


def follow(forms: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to their last; no chain has more than ``most`` steps."""
    at = scratch.write(forms.select("word", F.col("form").alias("root")), "root0")
    for k in range(math.ceil(math.log2(max(most, 1)))):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = scratch.write(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"root{k + 1}")
        scratch.drop(f"root{k}")
    return at


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word with ``least_count`` occurrences at least."""
    scratch = Scratch(df.sparkSession, "spelling")
    words = scratch.write(count_words(df, id_col, text_col).filter(F.col("n") >= least_count), "words")
    far: Column = F.col("form_n") >= ratio * F.col("n")
    named = words.join(near_words(words, scratch), "word", "left").select("word", *[F.when(far, F.col(c)).alias(c) for c in ("form", "form_n")], "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    named = scratch.write(named, "named")
    # Each step multiplies n by ``ratio`` at least.
    largest = words.agg(F.max("n")).first()[0] or 1
    roots = follow(named.filter("form is not null").select("word", "form"), scratch, int(math.log(max(largest / least_count, 1), ratio)) + 1)
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Contract query: the words of all documents, their near words and forms."""
    return variants(load(spark, sf_dir, "documents").select("doc_id", "text"))


#: Near words meet by what is left of them without one character: at the same place of both, or without one of the longer word.
ORACLE = f"""
WITH RECURSIVE
  r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS x FROM documents),
  g AS (SELECT d, x, count(*) AS n FROM r WHERE length(x) >= {LEAST_CHARS} GROUP BY ALL),
  h AS (SELECT x, n, {sql.crc32("d || ':' || x")} AS h FROM g),
  c AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN x[:h % length(x)] || x[h % length(x) + 2:] ELSE x END AS word, n FROM h),
  w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
  o AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
  k AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS k FROM o),
  p AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
        UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.k = w.word
        UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.k = w.word),
  b AS (SELECT word, count(*) AS n_near, min((-m, other)) AS best FROM p GROUP BY word),
  f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {RATIO} * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= {RATIO} * w.n THEN CAST(-best[1] AS BIGINT) END AS form_n FROM w LEFT JOIN b USING (word)),
  t AS (SELECT word, form AS last FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.last WHERE f.form IS NOT NULL),
  z AS (SELECT word, max_by(last, n) AS root FROM (SELECT t.word, t.last, w.n FROM t JOIN w ON w.word = t.last) GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f LEFT JOIN z USING (word)"""
