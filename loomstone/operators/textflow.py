"""Text normalisation for the index: squeezed white space, runs of repeated sentences, sliding chunks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from loomstone.functions.fold import deaccent, not_ascii, unmarked

#: Characters of a chunk, and from one chunk's start to the next.
CHUNK, STRIDE = 1500, 1100
#: Equal sentences in a row that stay.
KEEP = 3


def squeeze(c: Column) -> Column:
    # A blank by itself stays as it is and is passed over.
    return F.trim(F.regexp_replace(c, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def dedup_runs(c: Column, keep: int = KEEP) -> Column:
    """The text with at most ``keep`` equal sentences in a row.

    A sentence goes if it equals each of the ``keep`` before it, so that a text
    costs in proportion to its sentences and none is shuffled.
    """
    sentences = F.split(c, r"(?<=[.!?])\s+")

    def kept(all_: Column) -> Column:
        def stays(s: Column, i: Column) -> Column:
            return ~F.coalesce(reduce(lambda x, y: x & y, [F.get(all_, i - k) == s for k in range(1, keep + 1)]), F.lit(False))

        return F.filter(all_, stays)

    return F.array_join(F.element_at(F.transform(F.array(sentences), kept), 1), " ")


def normalise(c: Column) -> Column:
    return dedup_runs(squeeze(c))


def chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a row for each chunk: ``offset`` and ``body``; blank chunks are left out."""
    n = F.length(text)
    last = F.when(n <= CHUNK, F.lit(0)).otherwise(F.ceil((n - CHUNK) / STRIDE) * STRIDE).cast("int")
    rows = df.withColumn("offset", F.explode(F.sequence(F.lit(0), last, F.lit(STRIDE))))
    return rows.withColumn("body", F.substring(F.col(text), F.col("offset") + 1, F.lit(CHUNK))).filter(F.trim("body") != "").drop(text)


def tokens(c: Column) -> Column:
    """Folded words: runs of letters and numbers, lower case, without marks."""
    return F.filter(F.split(F.lower(deaccent(c)), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def joined(c: Column) -> Column:
    """The words of :func:`tokens` with a blank between each two, as one text: cheaper where no list is needed."""
    # A blank by itself stays as it is and is passed over.
    return F.trim(F.regexp_replace(F.lower(deaccent(c)), r"[^\p{L}\p{N}\p{Co} ][^\p{L}\p{N}\p{Co}]*| [^\p{L}\p{N}\p{Co}]+", " "))


def half_folded(c: Column) -> Column:
    """A text whose words are those of :func:`tokens` once its ASCII letters are lower case and all other ASCII but numbers is blank.

    That rest is one look at a table for each byte, which Arrow functions do for
    all their texts at once; plain ASCII goes to them as it is.
    """
    return F.when(not_ascii(c), F.regexp_replace(F.lower(unmarked(c)), r"[\x{80}-\x{10FFFF}&&[^\p{L}\p{N}\p{Co}]]", " ")).otherwise(c)


#: What :func:`half_folded` leaves to do, for each byte.
ENDED = np.array([k if k > 127 else ord(chr(k).lower()) if chr(k).isalnum() else 32 for k in range(256)], np.uint8)


def ended(texts: pa.Array) -> pa.Array:
    """Texts of :func:`half_folded`, none of them null, with nothing but words and blanks."""
    offsets, data = texts.buffers()[1:]
    if data is None:
        return texts
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(ENDED[np.frombuffer(data, np.uint8)])], 0, texts.offset)


@F.arrow_udf(IntegerType())
def _words(texts: pa.Array) -> pa.Array:
    texts = ended(texts)
    offsets, data = texts.buffers()[1:]
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if at[0] == at[-1]:
        return pa.array(np.zeros(len(texts), np.int32))
    word = np.frombuffer(data, np.uint8)[at[0] : at[-1]] != 32
    begins, at = word.copy(), at - at[0]
    begins[1:] &= ~word[:-1]
    firsts = at[:-1][np.diff(at) > 0]
    begins[firsts] = word[firsts]
    return pa.array(np.diff(np.append(0, np.cumsum(begins))[at]).astype(np.int32))


def word_count(c: Column) -> Column:
    """The number of words of :func:`tokens`, without a pass of a pattern over texts of plain ASCII."""
    return _words(half_folded(F.coalesce(c, F.lit(""))))


def joined_size(words: Column) -> Column:
    """The number of words of a text of :func:`joined`."""
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + (words != "").cast("int")


def caption_lines(lines: Column) -> Column:
    """Caption lines without those that the line kept before equals or ends with."""

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        return F.when(F.coalesce(last.endswith(x), F.lit(False)), out).otherwise(F.array_append(out, x))

    return F.aggregate(lines, F.expr("cast(array() as array<string>)"), step)


def even_sample(items: Column, most: int) -> Column:
    """``most`` items at even steps, half-way steps to the even index; all if there are no more."""
    n = F.size(items)
    if most <= 0:
        return items
    if most == 1:
        return F.slice(items, 1, 1)
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(items, F.bround(i * (n - 1) / F.lit(float(most - 1))).cast("int") + 1))
    return F.when(n <= most, items).otherwise(F.array_distinct(picks))
