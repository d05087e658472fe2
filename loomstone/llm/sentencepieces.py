"""SentencePiece encoding and decoding, with a max-plus scan for giant texts.

Texts up to ``GIANT`` characters are encoded by the library, map-side. A giant
text is split into chunks. The model is a BPE one, so a path of pieces is the
encoding exactly if each neighbouring pair is stable: encoding the two alone,
without a prefix, gives the pair back. That makes encoding a shortest-path
problem with weights 0 (stable) and minus infinity. The states at a cut are
the pieces that reach up to it or across it; a chunk yields the transfer
matrix between the states at its two cuts, matrices combine by the
associative max-plus product, and once the states are known every chunk is
backtraced by itself. No piece runs from another character into a blank, so a
cut before a blank has one state only, and the library encodes a chunk between
two such cuts; the search for a cut looks for one first.

Chunks between two such cuts need no matrix, and only the others are given
one. A chunk's decoding is compared with its own piece of the text. The chunks
of a text then come in order to a worker that joins them: it holds a digest,
and the text's ids only if they are asked for, but never the text.

Defined results: a null text is encoded as an empty one, into no pieces;
repeated rows each give a row; other columns are kept, but for those with the
name of a result column, which it replaces; an empty table gives an empty
result. A very long text costs in proportion to its length, in chunks that any
task may take. Decoding gives the text back unless it holds U+2581, which the
model reads as a blank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomstone.llm.batches import fresh, give_back, slices, without
from loomstone.session import load

#: Characters above which a text is split, characters of a chunk, and how far from its place a cut may look for a blank.
GIANT, CHUNK, SEARCH = 32_768, 16_384, 2_048
#: Characters that a chunk sees before its cut and, twice as many, beyond; no piece may be longer.
MARGIN = 128
#: Chunks of a block, into which a text is cut first.
BLOCK = 64
#: Pairs of pieces that a worker remembers as stable or not.
PAIRS = 50_000
BLANK = "▁"
#: A piece that decoding leaves alone, before the ids of a chunk that isn't the first.
LEAD = "a"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """The library's model and its rule for stable pairs."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        usable = lambda i: not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))
        self.ids = {p: i for i, p in enumerate(pieces) if usable(i)}
        self.score = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece runs into a blank: cuts before blanks would not be safe")
        if self.longest > MARGIN:
            raise ValueError("a piece is longer than the margin that a chunk sees")
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def bpe(self, s: str) -> list[str]:
        """Greedy merges, best score first, leftmost first among equals; for short strings."""
        parts = list(s)
        while True:
            best = max(((self.score[m], -i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def stable(self, a: str, b: str) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = self.bpe(a + b) == [a, b]
        return self.pairs[a, b]

    def spans(self, s: str, end: int) -> list[int]:
        """Starts of the pieces of ``s`` that end at ``end``."""
        return [a for a in range(max(0, end - self.longest), end) if a == end - 1 or self.reachable(s[a:end])]

    def reachable(self, p: str) -> bool:
        """True for a piece that merges make of its own characters."""
        if p not in self.ids:
            return False
        if p not in self.whole:
            self.whole[p] = self.bpe(p) == [p]
        return self.whole[p]

    def to_ids(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]


def _model(path: str) -> Model:
    import sentencepiece

    kept = sentencepiece.__dict__.setdefault("_loomstone", {})
    if path not in kept:
        kept[path] = Model(path)
    return kept[path]


def _escaped(text: str) -> str:
    return text.replace(" ", BLANK)


def cut_at(s: str, at: int) -> tuple[int, bool]:
    """The cut for place ``at`` of an escaped text: before the first blank that follows another character, or there."""
    i = at
    while (i := s.find(BLANK, i)) != -1 and i < at + SEARCH:
        if i > 0 and s[i - 1] != BLANK:
            return i, True
        i += 1
    return at, False


def states(model: Model, s: str, cut: int, hard: bool) -> list[tuple[int, int]]:
    """Pieces (start, end) that reach up to or across a cut; for a hard cut, one state stands for all."""
    if hard:
        return [(cut, cut)]
    return [(a, b) for b in range(cut, min(len(s), cut + model.longest - 1) + 1) for a in model.spans(s, b) if a < cut]


def _walk(model: Model, s: str, start: list[tuple[int, int]], goal: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """For each piece between the states: a bit set of the start states that reach it by stable pairs."""
    reach = {x: 1 << k for k, x in enumerate(start)}
    ends: dict[int, list[tuple[int, int]]] = {}
    for x in start:
        ends.setdefault(x[1], []).append(x)
    first, last = min(b for _, b in start), max(b for _, b in goal)
    for b in range(first + 1, last + 1):
        for a in model.spans(s, b):
            if a < first or (a, b) in reach:
                continue
            mask = 0
            for x in ends.get(a, ()):
                if x[0] == x[1] or model.stable(s[x[0] : x[1]], s[a:b]):
                    mask |= reach[x]
            if mask:
                reach[a, b] = mask
                ends.setdefault(b, []).append((a, b))
    return reach


def _goals(reach: dict, goal: list[tuple[int, int]]) -> list[int]:
    """Bit sets at the goal states; a point state (p, p) stands for all pieces that end there."""
    return [reach[g] if g in reach else (sum_or(m for x, m in reach.items() if x[1] == g[1]) if g[0] == g[1] else 0) for g in goal]


def sum_or(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


def transfer(model: Model, s: str, start: list[tuple[int, int]], goal: list[tuple[int, int]]) -> np.ndarray:
    """Max-plus matrix from start to goal states: 0 where stable pairs lead over, else minus infinity."""
    found = _goals(_walk(model, s, start, goal), goal)
    return np.array([[0.0 if m >> k & 1 else -np.inf for m in found] for k in range(len(start))])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def choose(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut, from the products up to it and from it on; matrices[0] has one row, the last one column."""
    ahead = [np.zeros((1, 1))]
    for m in matrices:
        ahead.append(product(ahead[-1], m))
    back = [np.zeros((1, 1))]
    for m in reversed(matrices):
        back.append(product(m, back[-1]))
    return [int((f[0] + b[:, 0]).argmax()) for f, b in zip(ahead, reversed(back))]


def backtrace(model: Model, s: str, start: tuple[int, int], goal: tuple[int, int]) -> list[int]:
    """Ids of the pieces after ``start`` up to ``goal``, which it includes."""
    reach = _walk(model, s, [start], [goal])
    ends: dict[int, list[tuple[int, int]]] = {}
    for x in reach:
        ends.setdefault(x[1], []).append(x)
    at = goal if goal in reach else None
    path: list[tuple[int, int]] = []
    if at is None:
        # A point state: of the pieces that end there, one leads back to the start.
        at = ends[goal[1]][0] if goal[1] != start[1] else start
    while at != start:
        path.append(at)
        at = next(x for x in ends[at[0]] if x == start or model.stable(s[x[0] : x[1]], s[at[0] : at[1]]))
    return [i for a, b in reversed(path) for i in model.to_ids(s[a:b])]


def _chunk(model: Model, text: str, base: int, k: int, last: bool) -> tuple[str, tuple[int, bool], tuple[int, bool]]:
    """Escaped text of a chunk with its surroundings, and its two cuts, in places of that text.

    The first chunk has the blank that the model puts before a text, and so its
    places are one further on.
    """
    s = (BLANK if k == 0 else "") + _escaped(text)
    shift = (1 if k == 0 else 0) - base
    head = (0, True) if k == 0 else cut_at(s, k * CHUNK + shift)
    tail = (len(s), True) if last else cut_at(s, (k + 1) * CHUNK + shift)
    return s, head, tail


def _encode_hard(model: Model, s: str, head: int, tail: int) -> list[int]:
    """A chunk between two hard cuts; the blank that it begins with is the one that the library adds."""
    rest = s[head + 1 : tail]
    return model.sp.encode(rest, num_threads=1) if rest else ([model.ids[BLANK]] if tail > head else [])


def _surface(model: Model, ids: list[int], first: bool) -> str:
    """What the ids of a chunk stand for; only before the first chunk of a text does decoding drop the blank that encoding put there."""
    return model.sp.decode(ids) if first else model.sp.decode([model.ids[LEAD], *ids])[len(LEAD) :]


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))


def _chunks(rows: DataFrame) -> DataFrame:
    """(key, k, n, base, text): chunk k of the n chunks of each different text of ``rows`` (key, text), with the place of its first character.

    A text is cut into blocks and these into chunks, since each cut counts
    characters from the start of what it is cut from. Equal chunks of equal
    texts become one row, in each task before the shuffle.
    """
    n = F.ceil(F.length("text") / CHUNK).cast("int").alias("n")
    blocks = rows.select("key", "text", n).select("key", "n", "text", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK).cast("int") - 1)).alias("j"))
    start = F.greatest(F.col("j") * (BLOCK * CHUNK) - MARGIN, F.lit(0))
    blocks = blocks.select("key", "n", "j", start.alias("start"), F.substring("text", start + 1, F.lit(BLOCK * CHUNK + SEARCH + 4 * MARGIN)).alias("text"))
    ks = F.sequence(F.col("j") * BLOCK, F.least(F.col("j") * BLOCK + BLOCK, F.col("n")) - 1)
    base = F.greatest(F.col("k") * CHUNK - MARGIN, F.lit(0))
    cut = F.substring("text", base - F.col("start") + 1, F.lit(CHUNK + SEARCH + 3 * MARGIN)).alias("text")
    chunks = blocks.select("key", "n", "start", "text", F.explode(ks).alias("k")).select("key", "k", "n", cut)
    return chunks.groupBy("key", "k").agg(F.any_value("n").alias("n"), F.any_value("text").alias("text")).select("key", "k", "n", base.alias("base"), "text")


def _giants(rows: DataFrame, path: str, keep_ids: bool) -> DataFrame:
    """(key, ids, n_tokens, ids_sha256, round_trip) of giant texts given as (key, text); without ids if they aren't kept."""
    chunks = _chunks(rows)

    def chunk_rows(batch: pa.RecordBatch):
        """The model's chunk and its row of each row of a slice."""
        model = _model(path)
        for r in batch.to_pylist():
            yield model, r, *_chunk(model, r["text"], r["base"], r["k"], r["k"] == r["n"] - 1)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of chunks that have more than one state at a cut; between two hard cuts there is nothing to choose."""
        for batch in slices(batches, "text"):
            out = [
                (r["key"], r["k"], transfer(model, s, states(model, s, *head), states(model, s, *tail)).ravel().tolist())
                for model, r, s, head, tail in chunk_rows(batch)
                if not (head[1] and tail[1])
            ]
            keys, ks, ms = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ks, pa.int32()), pa.array(ms, pa.list_(pa.float64()))], ["key", "k", "m"])

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k")
        ms, width = [], 1
        for m in frame["m"]:
            ms.append(np.asarray(m).reshape(width, -1))
            width = ms[-1].shape[1]
        at = choose(ms)
        return pd.DataFrame({"key": frame["key"], "k": frame["k"], "head": at[:-1], "tail": at[1:]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out, same = [], []
            for model, r, s, head, tail in chunk_rows(batch):
                if head[1] and tail[1]:
                    ids, lo, hi = _encode_hard(model, s, head[0], tail[0]), head[0], tail[0]
                else:
                    start, goal = states(model, s, *head)[r["head"]], states(model, s, *tail)[r["tail"]]
                    ids, lo, hi = backtrace(model, s, start, goal), start[1], goal[1]
                shift = 1 if r["k"] == 0 else 0
                same.append(_surface(model, ids, r["k"] == 0) == r["text"][max(lo - shift, 0) : hi - shift])
                out.append(np.array(ids, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), _id_lists(out), pa.array(same, pa.bool_())], ["key", "k", "ids", "same"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents from their chunks in order, one at a time; of the ids only the digest is held unless they are kept."""
        key, n, same, digest, held = None, 0, True, hashlib.sha256(), []

        def document() -> pa.RecordBatch:
            arrays = [pa.array([n], pa.int64()), pa.array([digest.hexdigest()], pa.string()), pa.array([same], pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), *([_id_lists([np.concatenate(held)])] if keep_ids else []), *arrays], ["key", *(["ids"] if keep_ids else []), "n_tokens", "ids_sha256", "round_trip"])

        for batch in batches:
            keys, ids, good = batch.column("key").to_pylist(), batch.column("ids"), batch.column("same").to_pylist()
            for i, k in enumerate(keys):
                if k != key:
                    if key is not None:
                        yield document()
                    key, n, same, digest, held = k, 0, True, hashlib.sha256(), []
                own = ids[i].values.to_numpy().astype("<i4", copy=False)
                n, same = n + len(own), same and good[i]
                digest.update(own.tobytes())
                if keep_ids:
                    held.append(own)
        if key is not None:
            yield document()
        give_back()

    chosen = chunks.mapInArrow(matrices, "key string, k int, m array<double>").groupBy("key").applyInPandas(combine, "key string, k int, head int, tail int")
    traced = chunks.join(chosen, ["key", "k"], "left").mapInArrow(trace, "key string, k int, ids array<int>, same boolean")
    return traced.repartition("key").sortWithinPartitions("key", "k").mapInArrow(joined, "key string, " + ("ids array<int>, " if keep_ids else "") + "n_tokens long, ids_sha256 string, round_trip boolean")


def encode(df: DataFrame, path: str | None = None, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``df`` without its text, with ids, n_tokens, ids_sha256 and round_trip.

    ``ids_sha256`` is the digest of the ids as little-endian 32-bit integers;
    ``round_trip`` tells whether decoding gives the text back.
    """
    path = path or default_path()
    made = {"ids": ArrayType(IntegerType()), "n_tokens": "long", "ids_sha256": "string", "round_trip": "boolean"}
    if not keep_ids:
        del made["ids"]
    others = without([c for c in df.columns if c != text_col], list(made))
    own_key = fresh(df.columns, "_key")
    df = df.select(*others, text_col)
    schema = df.select(*others).schema
    for name, kind in made.items():
        schema = schema.add(name, kind)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in slices(batches, text_col):
            ids, n, digests, same = [], [], [], []
            for text in batch.column(text_col):
                text = text.as_py() or ""
                own = model.sp.encode(text, num_threads=1)
                same.append(model.sp.decode(own) == text)
                own = np.array(own, "<i4")
                n.append(len(own))
                digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                ids.append(own if keep_ids else None)
            arrays = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *([_id_lists(ids)] if keep_ids else []), *arrays], [*others, *made])

    giant = F.length(F.coalesce(F.col(text_col), F.lit(""))) > GIANT
    small = df.filter(~giant).mapInArrow(whole, schema)
    key = F.concat_ws(":", F.sha2(F.col(text_col), 256), F.length(text_col))
    large = df.filter(giant)
    coded = _giants(large.select(key.alias("key"), F.col(text_col).alias("text")), path, keep_ids).withColumnRenamed("key", own_key)
    # Texts aren't needed beside their ids: what is joined to them is the other columns.
    return small.unionByName(large.select(*others, key.alias(own_key)).join(coded, own_key).select(*others, *made))


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``text``: what the ids stand for; null ids give null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        model = _model(path)
        return ids.map(lambda x: None if x is None else model.sp.decode([int(i) for i in x]))

    return df.withColumn("text", text_of(ids_col))


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Tokens, their digest and the round trip of each document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, keep_ids=False)
