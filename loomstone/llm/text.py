"""Text columns that several operators of this subpackage share (JVM-side only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: blank, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE = 5
#: Bits of a filter that tells which keys are wanted, in bitmaps of 2**15 bits: 8 MB at most, whatever the input.
FILTER = 1 << 26


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text; none for an empty text. The text must not be null."""
    return F.array_remove(F.split(text, SPACES), "")


def ascii_lower(text: Column) -> Column:
    """The text with A-Z, and only these, in lower case.

    ``lower`` is the fast way; ``translate`` serves texts that hold other
    cased letters, which must stay as they are.
    """
    others = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]")
    return F.when(others, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def _windows(items: Column, width: int, of: Callable[[Column], Column]) -> Column:
    """Windows of a list that is a lambda variable, so that naming it again costs nothing."""
    return F.transform(F.sequence(F.lit(1), F.size(items) - (width - 1)), lambda i: of(F.slice(items, i, width)))


def _none(items: Column, of: Callable[[Column], Column]) -> Column:
    """An empty list of what ``of`` makes."""
    return F.transform(F.slice(items, 1, 0), lambda w: of(F.array(w)))


def windows(items: Column, width: int, of: Callable[[Column], Column]) -> Column:
    """``of`` each run of ``width`` neighbouring items; empty if there are fewer."""
    return let(items, lambda x: F.when(F.size(x) >= width, _windows(x, width, of)).otherwise(_none(x, of)))


def shingles(items: Column, of: Callable[[Column], Column], width: int = SHINGLE, distinct: bool = True) -> Column:
    """The (distinct) shingles of a word list: its windows of ``width`` words.

    A list of fewer words is one shingle as a whole; an empty list has none.
    """

    def made(x: Column) -> Column:
        short = F.when(F.size(x) > 0, F.array(of(x))).otherwise(_none(x, of))
        return F.when(F.size(x) >= width, _windows(x, width, of)).otherwise(short)

    return F.array_distinct(let(items, made)) if distinct else let(items, made)


def marked(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be among those of ``wanted``: a map-side filter by hashed bits, ahead of an exact join.

    The filter has FILTER bits, whatever the input; other keys that share a bit pass too.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER))
    bits = wanted.select(bit.alias("_bit")).groupBy(F.expr("bitmap_bucket_number(_bit)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_bit))").alias("_bits"))
    probe = df.withColumn("_bit", bit).withColumn("_bucket", F.expr("bitmap_bucket_number(_bit)")).withColumn("_at", F.expr("bitmap_bit_position(_bit)"))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.getbit(byte, F.col("_at").cast("int") % 8) == 1
    # FILTER / 2**15 rows of 4 KB at most.
    return probe.join(F.broadcast(bits), "_bucket").filter(hit).select(*df.columns)
