"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Native: SQL functions only. A pattern's spans come from ``split`` and
``regexp_extract_all``, which cut the text into gaps and hits that alternate;
running lengths give the offsets, in code points.

Lists of spans are built in blocks of ``BLOCK``, so that a very long text with
very many spans costs in proportion to its length and to their number.

Defined results: a null or empty text has no spans; repeated rows each give
their row; an empty table gives an empty result; ``redact`` keeps all columns,
``scan`` all but those named ``base`` or ``spans``, which its own replace.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.batches import fresh, without
from loomstone.llm.text import let
from loomstone.session import load

#: The patterns that the base rules name. Runs of one character
#: class are maximal, so a least length inside the pattern drops just the
#: matches that a later test of length would drop.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]
LEAST_VALUE = 6

#: Spans that are appended to a list one by one, before the list joins those of other blocks.
BLOCK = 128

#: Candidate strings for the entropy test, and the characters they may hold.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: (class, pattern, bits): the first class that a candidate matches gives the
#: entropy that some window of it must reach.
CLASSES = [
    ("hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("letters", r"^[A-Za-z]+$", 4.1),
    ("alphanumeric", r"^[A-Za-z0-9]+$", 3.6),
    ("symbols", r"", 3.8),
]
#: Candidates that are no secrets: numbers, UUIDs, paths and identifiers made
#: of letters, rulers, and strings marked as examples.
ALLOWED = (
    r"^[0-9_+=/-]+$|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
    r"|^/?[A-Za-z]+([/_-]+[A-Za-z]+)+/?$|^(.)\3+$|(?i:example|placeholder|dummy)"
)


_NONE = "cast(array() as array<struct<s:int,k:int,e:int>>)"


def _fold(items: Column, first: Column, step, found: str) -> Column:
    """The list ``found`` that ``step`` builds over ``items``.

    ``first`` is a struct whose field ``at`` is carried on from item to item;
    ``step`` takes (at, found, item) and gives both anew. Lists grow within
    blocks, and whole blocks are put together at the end.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def inner(at: Column, block: Column) -> Column:
        def one(state: Column, item: Column) -> Column:
            now, grown = step(state["at"], state["found"], item)
            return F.struct(now.alias("at"), grown.alias("found"))

        return F.aggregate(block, F.struct(at.alias("at"), F.expr(found).alias("found")), one)

    def outer(state: Column, block: Column) -> Column:
        # let: the block is gone through once for both fields.
        return let(inner(state["at"], block), lambda x: F.struct(x["at"].alias("at"), F.array_append(state["lists"], x["found"]).alias("lists")))

    start = F.struct(first.alias("at"), F.slice(F.array(F.expr(found)), 1, 0).alias("lists"))
    whole = F.flatten(F.aggregate(blocks, start, outer, lambda x: x["lists"]))
    return F.when(F.size(items) > 0, whole).otherwise(F.expr(found))


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (start, kind, end) of all matches of ``pattern``; ``keep`` tests a match."""

    def step(at: Column, found: Column, cut: Column) -> tuple[Column, Column]:
        start = at + F.length(cut["gap"])
        end = start + F.length(cut["hit"])
        grown = F.array_append(found, F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e")))
        return end, grown if keep is None else F.when(keep(cut["hit"]), grown).otherwise(found)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # One gap more than hits: the last has no hit after it.
    cuts = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(pattern), let(cuts, lambda c: _fold(c, F.lit(0), step, _NONE))).otherwise(F.expr(_NONE))


def peak_entropy(candidate: Column) -> Column:
    """The largest Shannon entropy, in bits, of a window of the candidate.

    One pass: the count of the entering character goes up, that of the leaving
    one down, and the sum of c*log2(c) over the counts changes by those two
    terms alone.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])

    def run(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.element_at(codes, i), F.when(i > WINDOW, F.element_at(codes, F.when(i > WINDOW, i - WINDOW).otherwise(1))).otherwise(F.lit(0))
            counts = F.transform(state["counts"], lambda c, j: c + (j + 1 == enters).cast("int") - (j + 1 == leaves).cast("int"))
            gone = F.when(leaves > 0, F.element_at(state["counts"], F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
            less = F.when(leaves > 0, F.element_at(terms, gone + 1) - F.element_at(terms, F.greatest(gone, F.lit(1)))).otherwise(F.lit(0.0))
            now = F.element_at(state["counts"], enters) - (leaves == enters).cast("int")
            total = state["total"] - less + F.element_at(terms, now + 2) - F.element_at(terms, now + 1)
            bits = F.when(i >= WINDOW, F.lit(math.log2(WINDOW)) - total / WINDOW).otherwise(F.lit(0.0))
            return F.struct(counts.alias("counts"), total.alias("total"), F.greatest(state["best"], bits).alias("best"))

        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda s: s["best"])

    return let(F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c)), run)


def is_secret(candidate: Column) -> Column:
    """True where the entropy of a candidate reaches its class's mark and no allow-list entry holds."""
    mark = None
    for _, pattern, bits in CLASSES[:-1]:
        mark = (mark if mark is not None else F).when(candidate.rlike(pattern), F.lit(bits))
    mark = mark.otherwise(F.lit(CLASSES[-1][2]))
    # 1e-9: the running sum may be off by rounding.
    return ~candidate.rlike(ALLOWED) & (peak_entropy(candidate) >= mark - 1e-9)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, sorted by start, then kind."""
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 1)) >= LEAST_VALUE
    assign = F.when(named, _spans(text, ASSIGN, 0, long_value)).otherwise(F.expr(_NONE))
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(F.expr(_NONE))
    return F.array_sort(F.concat(assign, access, _spans(text, HEX, 2)))


def with_extra(base: Column, extra: Column) -> Column:
    """Base spans, and those of ``extra`` that no base span contains, sorted."""

    def step(top: Column, found: Column, x: Column) -> tuple[Column, Column]:
        # By start: a base span contains x if the furthest end so far reaches x's.
        ours = x["k"] < KINDS.index("entropy")
        grown = F.when(ours | (top < x["e"]), F.array_append(found, x)).otherwise(found)
        return F.when(ours, F.greatest(top, x["e"])).otherwise(top), grown

    return F.when(F.size(extra) > 0, let(F.array_sort(F.concat(base, extra)), lambda both: _fold(both, F.lit(-1), step, _NONE))).otherwise(base)


def _scanned(df: DataFrame, text_col: str, base: str, spans: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(base, base_spans(text)).withColumn(spans, with_extra(F.col(base), _spans(text, CANDIDATE, 3, is_secret)))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``base`` and ``spans``: arrays of (s, k, e), sorted by start, then kind.

    ``base`` has the spans of the three fixed patterns; ``spans`` adds those
    candidates of high entropy that no base span contains.
    """
    return _scanned(df.select(*without(df.columns, ["base", "spans"])), text_col, "base", "spans")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span replaced by ``mask``; overlapping spans become one mask.

    A block of spans cuts its pieces from its own stretch of the text, as
    finding a place in a string takes time in proportion to how far in it is.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)))

    def pieces(at: Column, block: Column) -> Column:
        far = F.greatest(at, F.array_max(F.transform(block, lambda x: x["e"])))

        def cut(own: Column) -> Column:
            def step(state: Column, x: Column) -> Column:
                gap = F.concat(F.substring(own, state["at"] - at + 1, F.greatest(x["s"] - state["at"], F.lit(0))), F.lit(mask))
                grown = F.when(x["s"] >= state["at"], F.array_append(state["out"], gap)).otherwise(state["out"])
                return F.struct(F.greatest(state["at"], x["e"]).alias("at"), grown.alias("out"))

            zero = F.struct(at.alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
            return F.aggregate(block, zero, step, lambda x: F.struct(x["at"].alias("at"), F.array_join(x["out"], "").alias("out")))

        return let(F.substring(text, at + 1, far - at), cut)

    def outer(state: Column, block: Column) -> Column:
        return let(pieces(state["at"], block), lambda x: F.struct(x["at"].alias("at"), F.array_append(state["out"], x["out"]).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(blocks, start, outer, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.length(text))))


def redact(df: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mask``; columns as before.

    Overlapping spans become one mask. A text without spans stays as it is.
    ``n_chars``, where there is one, follows the new text.
    """
    base, spans = fresh(df.columns, "_base"), fresh(df.columns, "_spans")
    hit = F.size(spans) > 0
    found = _scanned(df, "text", base, spans).withColumn("text", F.when(hit, masked(F.col("text"), F.col(spans), mask)).otherwise(F.col("text")))
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*df.columns)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: base counts, base digest and all spans of each document."""
    found = scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
