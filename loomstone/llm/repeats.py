"""Removal of repeated passages by bucket-pointer refinement.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier.
Each start p of such a string is put into buckets: of its first q-gram, then of
twice as many bytes by the pair of bucket identifiers at p and q bytes later,
and so on up to ``GRAM`` bytes, 64 bytes and ``WIDTH``; each step reuses the
identifiers of the one before. Identifiers are 64-bit digests of the pair, so
that a task refines its own texts without a global ranking; sorting within a
bucket then decides which start comes first.

All starts are too many to shuffle. Starts choose the smallest identifier of a
``GRAM``-byte bucket within their string, and neighbouring starts with the same
choice make a run, which is described by its choice, and by the identifiers of
its first and last string. Equal strings make equal choices, so it is enough to
compare runs of one choice: runs that are equal throughout are told apart by
their place, and only where runs of one choice differ are the single starts
compared. Before the first shuffle a task keeps the first of its equal runs
alone: a passage that a third of all documents share takes a row for each task.
A choice with many different runs in a task is spread by the runs' own
identifiers, and its single starts by theirs; there, too, a task keeps the
first of equal ones.

Strings are told apart by two 64-bit identifiers together.

Defined results: a null text counts as empty; documents of fewer than
``WIDTH`` bytes stay whole; repeated rows of one id are compared in the order
of their texts' digests, and rows with a null id come first; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import Scratch, load

WIDTH, GRAM = 100, 32
#: Starts that a run has at most: its first and last string then hold all its bytes. More than a choice can reach over only come from periodic text.
RUN = WIDTH
#: Bytes of text treated at a time, and of batches whose equal runs are found before a shuffle.
STEP = 1 << 21
#: Different runs of one choice in a batch above which it is spread.
SPREAD = 64
#: A row is a run (or single start) of n starts; with n below 0, a span of -n bytes known to go; with n = 0, word that a choice is spread.
_RUNS = "g long, s long, doc long, copy int, lo int, n int, edge boolean, spread boolean"


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _later(ids: np.ndarray, by: int) -> np.ndarray:
    """Identifiers refined by those ``by`` bytes later; the last ones have none and are cut off."""
    return mix(ids[:-by] * np.uint64(0x9E3779B97F4A7C15) + ids[by:])


def buckets(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of GRAM and of WIDTH bytes, for each start that has so many."""
    ids = mix(b.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < GRAM:
        ids = _later(ids, size)
        size *= 2
    grams, size = ids, GRAM
    while 2 * size <= WIDTH:
        ids = _later(ids, size)
        size *= 2
    return grams, _later(ids, WIDTH - size) if size < WIDTH else ids


def _least(x: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """The least of each window of ``width`` neighbours, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out = op(out[:-size], out[size:])
        size *= 2
    return op(out[: len(x) - width + 1], out[width - size : width - size + len(x) - width + 1])


def runs(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts in a buffer of texts that end at ``ends``: place, length, choice, identifier, and if starts in it may be equal."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(b) < WIDTH:
        return none
    grams, wide = buckets(b)
    reach = WIDTH - GRAM + 1
    choice = _least(grams, reach)
    at = np.arange(len(wide))
    own = ends[np.searchsorted(ends, at, "right").clip(max=len(ends) - 1)]
    valid = at + WIDTH <= own
    fresh = valid & np.concatenate([[True], (choice[1:] != choice[:-1]) | ~valid[:-1]])
    first = np.flatnonzero(fresh)
    if not len(first):
        return none
    stop = np.flatnonzero(valid & np.concatenate([~valid[1:] | fresh[1:], [True]])) + 1
    size = stop - first
    # Longer runs (of periodic text) are cut.
    parts = -(-size // RUN)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = np.repeat(first, parts) + k * RUN
    n = np.minimum(RUN, np.repeat(stop, parts) - lo)
    s = mix(wide[lo] + mix(wide[lo + n - 1] + n.astype(np.uint64)))
    # Two chosen q-grams that are equal and follow each other: starts before them may be equal.
    most = _least(np.concatenate([np.zeros(reach - 1, np.uint64), choice, np.zeros(reach - 1, np.uint64)]), reach, np.maximum)[: len(grams)]
    chosen = np.flatnonzero(most == grams)
    twice = np.zeros(len(grams) + 1, np.int64)
    again = chosen[1:][grams[chosen[1:]] == grams[chosen[:-1]]]
    twice[again + 1] = 1
    twice = np.cumsum(twice)
    edge = (twice[(lo + n + reach - 1).clip(max=len(grams))] - twice[lo] > 0) | np.repeat(parts > 1, parts)
    return lo, n, choice[lo], s, edge


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], int]]:
    """Pieces of batches of about STEP bytes: ids, copies, texts and the place of the first text within its document.

    A longer text comes in pieces that overlap by WIDTH - 1 bytes, so that each
    start lies in one piece.
    """
    for batch in batches:
        ids, copies = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("copy").to_numpy(zero_copy_only=False)
        texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        lo, size = 0, 0
        for i, t in enumerate(texts):
            if len(t) > STEP:
                if lo < i:
                    yield ids[lo:i], copies[lo:i], texts[lo:i], 0
                for at in range(0, max(len(t) - WIDTH + 1, 1), STEP):
                    yield ids[i : i + 1], copies[i : i + 1], [t[at : at + STEP + WIDTH - 1]], at
                lo, size = i + 1, 0
                continue
            size += len(t)
            if size >= STEP:
                yield ids[lo : i + 1], copies[lo : i + 1], texts[lo : i + 1], 0
                lo, size = i + 1, 0
        if lo < len(texts):
            yield ids[lo:], copies[lo:], texts[lo:], 0


def _firsts(g: np.ndarray, s: np.ndarray, doc: np.ndarray, copy: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (g, s, place), and for each row in it whether it is the first of its (g, s)."""
    order = np.lexsort((lo, copy, doc, s, g))
    g, s = g[order], s[order]
    return order, np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])]) if len(g) else np.empty(0, bool)


def _different(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For rows sorted by g: how many rows with ``first`` their g has."""
    if not len(g):
        return np.empty(0, np.int64)
    fresh = np.concatenate([[True], g[1:] != g[:-1]])
    group = np.cumsum(fresh) - 1
    return np.bincount(group, weights=first)[group].astype(np.int64)


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_SCHEMA = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("copy", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("edge", pa.bool_()), ("spread", pa.bool_())])
_SPANS = pa.schema([("doc", pa.int64()), ("copy", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("kind", pa.int32()), ("g", pa.int64())])
_SPAN_DDL = "doc long, copy int, lo int, n int, kind int, g long"


def _stacked(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts)]


def _rows(runs: tuple, gone: tuple, told: tuple | None = None) -> pa.RecordBatch:
    """Rows of _RUNS: runs, spans that go, and word of spread choices."""
    zero = np.zeros(len(gone[0]), np.int64)
    parts = [tuple(x.view(np.int64) if x.dtype == np.uint64 else x for x in runs), (mix(gone[0].view(np.uint64)).view(np.int64), zero, gone[0], gone[1], gone[2], gone[2] - gone[3], zero > 0, zero > 0)]
    if told is not None:
        none = np.zeros(len(told[0]), np.int64)
        parts.append((told[0].view(np.int64), none, told[1], told[2], none, none, none == 0, none > 0))
    return _batch(dict(zip(_SCHEMA.names, _stacked(parts))), _SCHEMA)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of all texts; of equal ones in a task's batch, those after the first are spans that go."""

    def settled(parts: list[tuple]) -> pa.RecordBatch:
        doc, copy, lo, n, g, s, edge = _stacked(parts)
        order, first = _firsts(g, s, doc, copy, lo)
        doc, copy, lo, n, g, s, edge = (x[order] for x in (doc, copy, lo, n, g, s, edge))
        many = _different(g, first) > SPREAD
        gone = _merge(doc[~first], copy[~first], lo[~first], (lo + n)[~first] + WIDTH - 1)
        # A spread choice is known to have different runs; a row without starts tells those runs of it that other batches don't spread.
        told = first & many & np.concatenate([[True], g[1:] != g[:-1]])
        return _rows((g[first], s[first], doc[first], copy[first], lo[first], n[first], edge[first] | many[first], many[first]), gone, (g[told], doc[told], copy[told]))

    parts, size = [], 0
    for ids, copies, texts, base in _texts(batches):
        ends = np.cumsum([len(t) for t in texts])
        lo, n, g, s, edge = runs(np.frombuffer(b"".join(texts), np.uint8), ends)
        k = np.searchsorted(ends, lo, "right")
        parts.append((ids[k], copies[k], lo - (ends - [len(t) for t in texts])[k] + base, n, g, s, edge))
        size += ends[-1]
        if size >= 16 * STEP:
            yield settled(parts)
            parts, size = [], 0
    if parts:
        yield settled(parts)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], pa.RecordBatch] | None:
    """The rows of a task: columns of its runs, and the spans already known."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "copy", "lo", "n", "g", "s", "edge", "spread")] for b in batches]
    if not parts:
        return None
    columns = _stacked(parts)
    known = columns[3] < 0
    doc, copy, lo, n = (x[known] for x in columns[:4])
    zero = np.zeros(len(doc), np.int64)
    return [x[~known] for x in columns], _batch({"doc": doc, "copy": copy, "lo": lo, "n": -n, "kind": zero, "g": zero}, _SPANS)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within all runs of the choices that came here: kind 0 spans go, kind 1 runs need their starts compared, kind 2 as well, of choices with many runs.

    Kind 1 or 2 is the same for all runs of a choice, whichever tasks they came
    to: if a batch spread the choice, its runs say so themselves, and those that
    no batch spread are all here with the word of it; if none did, all its runs
    are here and are counted.
    """
    got = _gathered(batches)
    if got is None:
        return
    yield got[1]
    doc, copy, lo, n, g, s, edge, spread = got[0]
    if not len(g):
        return
    g, s = g.view(np.uint64), s.view(np.uint64)
    order, first = _firsts(g, s, doc, copy, lo)
    doc, copy, lo, n, g, edge, s, spread = (x[order] for x in (doc, copy, lo, n, g, edge, s, spread))
    fresh = np.concatenate([[True], g[1:] != g[:-1]])
    group = np.cumsum(fresh) - 1
    told = np.bincount(group, weights=(n == 0) | spread) > 0
    different = _different(g, first & (n > 0))
    needs = (different > 1) | told[group] | edge
    kind = np.where(~first, 0, np.where((different > SPREAD) | told[group], 2, 1))
    kept = (n > 0) & (~first | needs)
    yield _batch({"doc": doc[kept], "copy": copy[kept], "lo": lo[kept], "n": np.where(kind[kept] == 0, n[kept] + WIDTH - 1, n[kept]), "kind": kind[kept], "g": g[kept].view(np.int64)}, _SPANS)


def _merge(doc: np.ndarray, copy: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of a document that touch or overlap, as one."""
    if not len(doc):
        return doc, copy, lo, hi
    order = np.lexsort((lo, copy, doc))
    doc, copy, lo, hi = doc[order], copy[order], lo[order], hi[order]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])])
    # Running end within a document: ends are lifted by the document's number, so that a running maximum restarts.
    lift = (np.cumsum(other) - 1) * np.int64(1 << 33)
    top = np.maximum.accumulate(hi + lift) - lift
    fresh = other | np.concatenate([[True], lo[1:] > top[:-1]])
    first = np.flatnonzero(fresh)
    return doc[first], copy[first], lo[first], top[np.concatenate([first[1:], [len(doc)]]) - 1]


#: Starts of a run as one row: ``w`` has the 8-byte identifier of each; of a spread choice, a row for each start, dealt by its identifier ``s``.
_STARTS = "g long, s long, doc long, copy int, lo int, n int, spread boolean, w binary"
_START_SCHEMA = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("doc", pa.int64()), ("copy", pa.int32()), ("lo", pa.int32()), ("n", pa.int32()), ("spread", pa.bool_()), ("w", pa.binary())])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single starts of the runs (array ``runs`` of each text). Of a spread choice, equal ones after a batch's first are spans that go."""

    def settled(whole: list[tuple], parts: list[tuple]) -> pa.RecordBatch:
        rows = [(g, 0, doc, copy, lo, n, False, w) for g, doc, copy, lo, n, w in whole]
        if parts:
            g, w, doc, copy, lo = _stacked(parts)
            order, first = _firsts(g, w, doc, copy, lo)
            g, w, doc, copy, lo = (x[order] for x in (g, w, doc, copy, lo))
            gone = _merge(doc[~first], copy[~first], lo[~first], lo[~first] + WIDTH)
            rows += [(0, d, d, c, a, a - z, True, None) for d, c, a, z in zip(*(x.tolist() for x in gone))]
            rows += [(*x, 1, True, y.tobytes()) for *x, y in zip(g[first].view(np.int64).tolist(), w[first].view(np.int64).tolist(), doc[first].tolist(), copy[first].tolist(), lo[first].tolist(), w[first])]
        return _batch(dict(zip(_START_SCHEMA.names, zip(*rows))) if rows else {n: [] for n in _START_SCHEMA.names}, _START_SCHEMA)

    whole, parts, size = [], [], 0
    for batch in batches:
        docs, copies = batch.column("doc").to_pylist(), batch.column("copy").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for doc, copy, text, own in zip(docs, copies, texts, batch.column("runs").to_pylist()):
            b = np.frombuffer(text, np.uint8)
            own = sorted((r["lo"], r["n"], r["g"], r["kind"]) for r in own)
            at = 0
            while at < len(own):
                # Runs near each other are refined together, and a long text in steps.
                end = at + 1
                while end < len(own) and own[end][0] - own[end - 1][0] < 4 * WIDTH and own[end][0] - own[at][0] < STEP:
                    end += 1
                base = own[at][0]
                _, wide = buckets(b[base : own[end - 1][0] + own[end - 1][1] + WIDTH - 1])
                for lo, n, g, kind in own[at:end]:
                    w = wide[lo - base : lo - base + n]
                    if kind == 1:
                        whole.append((g, doc, copy, lo, n, w.tobytes()))
                    else:
                        full = lambda x, t: np.full(n, x, t)  # noqa: B023, E731
                        parts.append((full(g, np.int64).view(np.uint64), w, full(doc, np.int64), full(copy, np.int32), lo + np.arange(n)))
                    size += n
                at = end
            if size >= STEP:
                yield settled(whole, parts)
                whole, parts, size = [], [], 0
    if whole or parts:
        yield settled(whole, parts)


def _equal_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal starts that came here, all but the first go: their spans, with those already known."""
    parts, ids = [], []
    for batch in batches:
        parts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "copy", "lo", "n", "g")])
        ids += [x for x in batch.column("w").to_pylist() if x is not None]
    if not parts:
        return
    doc, copy, lo, n, g = _stacked(parts)
    known = n < 0
    zero = np.zeros(int(known.sum()), np.int64)
    yield _batch({"doc": doc[known], "copy": copy[known], "lo": lo[known], "n": -n[known], "kind": zero, "g": zero}, _SPANS)
    doc, copy, lo, n, g = (x[~known] for x in (doc, copy, lo, n, g))
    if not len(g):
        return
    w = np.frombuffer(b"".join(ids), np.uint64)
    k = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    g, doc, copy, lo = np.repeat(g, n).view(np.uint64), np.repeat(doc, n), np.repeat(copy, n), np.repeat(lo, n) + k
    order, first = _firsts(g, w, doc, copy, lo)
    gone = order[~first]
    doc, copy, lo, hi = _merge(doc[gone], copy[gone], lo[gone].astype(np.int64), lo[gone].astype(np.int64) + WIDTH)
    yield _batch({"doc": doc, "copy": copy, "lo": lo, "n": hi - lo, "kind": np.zeros(len(doc), np.int32), "g": np.zeros(len(doc), np.int64)}, _SPANS)


def _dealt(rows: DataFrame) -> DataFrame:
    """Runs of one choice to one task; those of a spread choice by their identifiers too."""
    return rows.repartition(F.when(F.col("spread"), F.xxhash64("g", "s")).otherwise(F.col("g")))


def repeated_spans(df: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, copy, spans): the spans (lo, n) of each document's bytes that go; they may overlap.

    ``df`` has doc, copy and text; (doc, copy) gives the order of texts.
    """
    found = scratch.write(_dealt(df.mapInArrow(_first_pass, _RUNS)).mapInArrow(_resolve, _SPAN_DDL), "found")
    edges = found.filter("kind > 0").groupBy("doc", "copy").agg(F.collect_list(F.struct("lo", "n", "g", "kind")).alias("runs"))
    last = scratch.write(_dealt(df.join(edges, ["doc", "copy"]).mapInArrow(_starts, _STARTS)).mapInArrow(_equal_starts, _SPAN_DDL), "last")
    spans = found.filter("kind = 0").unionByName(last)
    return spans.groupBy("doc", "copy").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256) for every row; ``kept`` is the bytes that stay."""
    scratch = Scratch(df.sparkSession, "repeats")
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), ident.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Ids that occur once need no number; repeated ones are told apart in the order of their texts.
    twice = base.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    if twice.isEmpty():
        base = base.withColumn("copy", F.lit(0))
    else:
        base = scratch.write(base.withColumn("copy", (F.row_number().over(Window.partitionBy("doc").orderBy(F.sha2("text", 256))) - 1).cast("int")), "base")
    spans = repeated_spans(base.select("doc", "copy", "text"), scratch)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, own in zip(texts, batch.column("spans").to_pylist()):
                at, kept, removed, count = 0, [], 0, 0
                end = -1
                for lo, n in sorted((x["lo"], x["n"]) for x in own or ()):
                    hi = lo + n
                    if lo > end:
                        kept.append(text[max(end, 0) : lo])
                        count += 1
                        removed += hi - lo
                        end = hi
                    elif hi > end:
                        removed += hi - end
                        end = hi
                kept.append(text[max(end, 0) :])
                rest = b"".join(kept)
                out.append((rest, len(text), removed, count, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*out)) or [[]] * 5
            arrays = [batch.column("doc_id"), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep:
                arrays.append(pa.array(cols[0], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")
    return base.join(spans, ["doc", "copy"], "left").select("doc_id", "text", "spans").mapInArrow(cut, kind)


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    """Contract query: bytes, removed bytes and runs, and the digest of what stays of each document."""
    return remove_repeats(load(spark, sf_dir, "documents"), keep=False)
