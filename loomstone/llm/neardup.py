"""MinHash near-duplicates by an LSH forest.

Documents with the same words are one class, and its smallest id stands for
it. A representative's shingle set has a signature of ``HASHES`` minhashes.
Each of ``TREES`` trees sorts the signatures by another order of these hashes,
as labels; neighbours with the longest common prefix are candidates. A prefix
of ``DEPTH`` hashes is where they begin to count: a region of that prefix with
up to ``REGION`` members gives all its pairs, a larger one its label
neighbours. Links found so far make components.

Regions too large for all pairs are then looked at again, whatever their size:
each member outside the main component meets all members. Members are dealt
into parts of about ``BLOCK``, those outside into chunks of as many, and each
part stands beside each chunk in a group of its own; nothing is divided by
further hashes, so that no pair of a region is lost. A region of m members with
o of them outside makes m * o comparisons, and m * o / BLOCK rows of each kind:
unlinked texts of one pattern are quadratic by nature, with bounded groups. Pairs are looked
at by their whole signatures, and then by the ``SKETCH`` smallest shingle hashes,
which are the whole set of most texts: near misses end there, and only pairs
that may be links are confirmed. Groups of copies never give all their pairs.

Two sets at a similarity of 0.75 miss each other in all 32 trees with a chance
of 5 in a million. Pairs beyond
the first few of a document, and those of large regions, are ruled out by an
estimate ``ERRORS`` standard errors below 0.75: the signature drops a pair at
0.75 with a chance of 1 in 100 million, the sketch of a longer text with less.
Every link is confirmed on the full sets of shingles.

Defined results: a null text has no words; a text without words has no
shingles and no links; repeated rows each give a row; rows with a null id take
no part, have no component and are kept; other columns are kept where the
operator returns documents; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.batches import give_back, slices
from loomstone.llm.text import SHINGLE, marked
from loomstone.operators.components import connected_components
from loomstone.session import Scratch, load

HASHES, TREES, DEPTH = 128, 32, 4
#: Members up to which a region gives all pairs, and label neighbours on each side beyond.
REGION, NEAR = 8, 2
#: Candidates of a document that are confirmed first: those met in most trees, and some by hash, which tie clusters together.
FIRST, MIXED = 2, 4
#: Members of a part of a large region, and members outside its main component in a chunk, about.
BLOCK = 2048
#: Standard errors below 0.75 at which an estimate rules a pair out.
ERRORS = 6
#: Share of equal minhashes below which a pair isn't confirmed.
LEAST_SHARE = 0.75 - ERRORS * (0.75 * 0.25 / HASHES) ** 0.5
#: Shingle hashes, 32 bits of each, by which members of large regions are compared more closely.
SKETCH = 768
#: Similarity in hundredths.
LINKED = 75
#: Shingles of two sketches that may be equal in 32 bits by chance: more of them have a chance of 1 in 10 ** 15.
FEIGNED = 3
#: Bytes of text hashed at a time.
STEP = 1 << 20


class Hasher:
    """64-bit hashes of words, shingles and minhashes, on whole arrays."""

    def __init__(self):
        rng = np.random.default_rng(20240607)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.of_place, self.of_hash = odd(1)[0], odd(SHINGLE), odd(HASHES)
        self.power = self.inverse = np.ones(1, np.uint64)

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, STEP * 2)
            back = np.uint64(pow(int(self.base), -1, 1 << 64))
            grow = lambda r: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, r, np.uint64)]))
            self.power, self.inverse = grow(self.base), grow(back)

    def shingles(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each lower-case text."""
        joined = b"\n".join(texts)
        b = np.frombuffer(joined, np.uint8)
        if not len(b):
            return [np.empty(0, np.uint64) for _ in texts]
        self.powers(len(b) + 1)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b.astype(np.uint64) * self.power[: len(b)], dtype=np.uint64)])
        word = self.mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * self.base)
        first = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        full = sum(word[k : len(word) - SHINGLE + 1 + k] * self.of_place[k] for k in range(SHINGLE)) if len(word) >= SHINGLE else word[:0]
        full = self.mix(full)
        out = []
        for lo, hi in zip(first, first[1:]):
            n = hi - lo
            if n >= SHINGLE:
                out.append(np.unique(full[lo : hi - SHINGLE + 1]))
            elif n:
                out.append(self.mix((word[lo:hi] * self.of_place[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
            else:
                out.append(word[:0])
        return out

    def signature(self, h: np.ndarray) -> np.ndarray:
        low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(h), 2048):
            low = np.minimum(low, (h[None, i : i + 2048] * self.of_hash[:, None]).min(axis=1))
        return (self.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _sliced(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about STEP bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def signatures(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, sig) for rows of (doc_id, text); sig is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, "text"):
            texts = [t.lower() for t in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            n, same, sigs = [], [], []
            for lo, hi in _sliced(texts):
                for h in hasher.shingles(texts[lo:hi]):
                    n.append(len(h))
                    sigs.append(hasher.signature(h).tobytes() if len(h) else None)
            for t in texts:
                same.append(hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest())
            c = np.frombuffer(b"".join(same), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "c1", "c2", "sig"],
            )

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, sig binary")


def forest(reps: DataFrame) -> DataFrame:
    """(tree, hi, lo, rep): a label for each tree, its prefix of DEPTH hashes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
            deep = np.roll(sig, -DEPTH, axis=1)
            hi, lo = np.ascontiguousarray(sig).view("<i8"), np.ascontiguousarray(deep).view("<i8")
            tree = np.tile(np.arange(TREES, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(hi.ravel()), pa.array(lo.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), TREES))], ["tree", "hi", "lo", "rep"])

    return reps.mapInArrow(run, "tree int, hi long, lo long, rep long")


def neighbours(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, n): candidates a < b from sorted label rows, and in how many trees they met; (tree, hi, lo, rep): members of large regions.

    A task has a range of the rows, which may begin or end within a region. The
    members of such a region that a task has are put together by region.
    """
    names = ["a", "b", "n", "tree", "hi", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A range of the sorted rows: ranges hold about equally many, whatever the regions.
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "hi", "lo", "rep")] for b in batches]
        if not parts:
            return
        tree, hi, lo, rep = (np.concatenate(x) for x in zip(*parts))
        fresh = np.concatenate([[True], (tree[1:] != tree[:-1]) | (hi[1:] != hi[:-1])])
        first = np.flatnonzero(fresh)
        region = np.cumsum(fresh) - 1
        size = np.diff(np.concatenate([first, [len(rep)]]))[region]
        pairs = []
        for d in range(1, REGION):
            same = (region[d:] == region[:-d]) & ((size[d:] <= REGION) | (d <= NEAR))
            if not same.any():
                break
            pairs.append(np.stack([rep[:-d][same], rep[d:][same]], axis=1))
        big = (size > REGION) & ~fresh
        pairs.append(np.stack([rep[first[region[big]]], rep[big]], axis=1))
        found, n = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0, return_counts=True)
        for i in range(0, len(found), 1 << 16):
            x = found[i : i + (1 << 16)]
            none = pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(n[i : i + len(x)].astype(np.int64)), *none], names)
        member = np.flatnonzero((region == 0) | (region == region[-1]) | (size > REGION))
        for i in range(0, len(member), 1 << 16):
            x = member[i : i + (1 << 16)]
            own = pa.array(rep[x])
            yield pa.RecordBatch.from_arrays([own, own, pa.array(np.zeros(len(x), np.int64)), pa.array(tree[x]), pa.array(hi[x]), pa.array(lo[x])], names)
        give_back()

    met = scratch.write(rows.mapInArrow(run, "a long, b long, n long, tree int, hi long, lo long"), "met")
    members = met.filter("tree is not null").select("tree", "hi", "lo", F.col("a").alias("rep"))
    sizes = members.groupBy("tree", "hi").agg(F.count(F.lit(1)).alias("m"))
    # A region cut between tasks that has few members in all gives all its pairs.
    cut = members.join(sizes.filter(F.col("m") <= REGION), ["tree", "hi"]).groupBy("tree", "hi").agg(F.collect_list("rep").alias("own"))
    across = cut.select("own", F.explode("own").alias("a")).select("a", F.explode("own").alias("b"), F.lit(1).cast("long").alias("n")).filter("a < b")
    pairs = met.filter("tree is null").select("a", "b", "n").unionByName(across).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs, members.join(sizes.filter(F.col("m") > REGION).select("tree", "hi"), ["tree", "hi"]).select("tree", "hi", "lo", "rep")


def _shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose signatures agree in ``LEAST_SHARE`` of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(_shares(x, y) >= LEAST_SHARE))

    left, right = (reps.select(F.col("rep").alias(c), F.col("sig").alias(f"s{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def sketches(texts: DataFrame) -> DataFrame:
    """(rep, n, sketch): size of each text's shingle set, and its SKETCH smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, "text"):
            texts = [t.lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sets = [h for lo, hi in _sliced(texts) for h in hasher.shingles(texts[lo:hi])]
            made = [(h[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([len(h) for h in sets], pa.int64()), pa.array(made, pa.binary())], ["rep", "n", "sketch"])

    return texts.select(F.col("doc_id").alias("rep"), "text").mapInArrow(run, "rep long, n long, sketch binary")


def close(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
    """Whether two sketches leave the similarity possible; sure where both hold the whole set."""
    if 100 * min(nx, ny) < LINKED * max(nx, ny):
        return False
    if nx <= SKETCH and ny <= SKETCH:
        both = len(np.intersect1d(x, y, assume_unique=False))
        return 100 * both >= LINKED * (nx + ny - both)
    least = np.union1d(x, y)[:SKETCH]
    share = np.isin(least, x).astype(bool) & np.isin(least, y)
    return share.mean() >= LINKED / 100 - ERRORS * (0.75 * 0.25 / len(least)) ** 0.5


def groups(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, hi, sub, deep, part, chunk, rep, component, own, asked): members of large regions that hold several components, in groups.

    A region's members are dealt into parts of about BLOCK, and those outside
    its main component into chunks of about as many. A group is a part (``own``)
    beside a chunk (``asked``), so that every pair that may be a link is in a
    group, one end of it asked and the other one own. ``sub`` and ``deep`` are 0:
    no region is divided by further hashes.
    """
    keys = ["tree", "hi"]
    counts = members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    of = counts.groupBy(*keys).agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("kinds"))
    # A group of one component has nothing to compare, however large.
    of = scratch.write(of.filter("kinds > 1").select(*keys, "m", "main", (F.col("m") - F.col("most")).alias("others")), "groups")
    known = members.join(of, keys)
    dealt = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "tree", "rep"), F.ceil(F.col(n) / BLOCK)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK).cast("int") - 1))
    own = known.withColumn("part", dealt("part", "m")).withColumn("chunk", every("others")).withColumns({"own": F.lit(True), "asked": F.lit(False)})
    asked = known.filter(F.col("component") != F.col("main")).withColumn("chunk", dealt("chunk", "others")).withColumn("part", every("m")).withColumns({"own": F.lit(False), "asked": F.lit(True)})
    both = own.unionByName(asked).withColumns({"sub": F.lit(0).cast("long"), "deep": F.lit(0)})
    # One of the others may be dealt into the part that it is asked of.
    return both.groupBy("tree", "hi", "sub", "deep", "part", "chunk", "rep", "component").agg(F.max("own").alias("own"), F.max("asked").alias("asked"))


def _compare(table: pa.Table) -> pa.Table:
    """Pairs of different components in one group that may be links: one end is asked, the other one own.

    A pair whose sketches are whole sets and similar beyond what some equal
    hashes could feign is a sure link. It joins two components here too, and no
    further pair between these is looked for, so that a group of copies gives
    about as many pairs as it has members. Other pairs are all given.
    """
    rep, comp, size, tree = (table.column(c).to_numpy() for c in ("rep", "component", "n", "tree"))
    kinds, of = np.unique(comp, return_inverse=True)
    out = [np.zeros((0, 2), np.int64)]
    if len(kinds) > 1:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        labels = np.ascontiguousarray(sig).view("<i8")
        sketch = [np.frombuffer(x, "<u4") for x in table.column("sketch").to_pylist()]
        start = np.cumsum([0, *(len(x) for x in sketch)])
        values, flat = np.unique(np.concatenate(sketch), return_inverse=True)
        flat = flat.astype(np.int32)
        own, asked = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("own", "asked"))
        held, joined = np.zeros(len(values), bool), of.copy()
        for i in np.flatnonzero(asked):
            # A pair whose ends are both asked and own is looked at once, and a pair that meets in several trees in the first one.
            other = (joined != joined[i]) & own & (~(asked & own[i]) | (np.arange(len(rep)) < i)) & (100 * np.minimum(size, size[i]) >= LINKED * np.maximum(size, size[i]))
            hit = np.flatnonzero(other)
            hit = hit[_shares(sig[i], sig[hit]) >= LEAST_SHARE]
            hit = hit[(labels[hit, : tree[i]] != labels[i, : tree[i]]).all(axis=1)]
            if not len(hit):
                continue
            held[flat[start[i] : start[i + 1]]] = True
            sums = np.concatenate([[0], np.cumsum(held[flat], dtype=np.int32)])
            both = (sums[start[hit + 1]] - sums[start[hit]]).astype(np.int64)
            held[flat[start[i] : start[i + 1]]] = False
            whole, union = (size[hit] <= SKETCH) & (size[i] <= SKETCH), size[hit] + size[i] - both
            sure = whole & (100 * (both - FEIGNED) >= LINKED * (union + FEIGNED))
            _, first = np.unique(joined[hit[sure]], return_index=True)
            near = hit[sure][first]
            unsure = ~sure & ~np.isin(joined[hit], joined[near])
            fine = np.array([100 * b >= LINKED * u if w else close(sketch[i], size[i], sketch[j], size[j]) for j, w, b, u in zip(hit[unsure], whole[unsure], both[unsure], union[unsure])], bool)
            ends = np.concatenate([near, hit[unsure][fine]])
            out.append(np.sort(np.stack([np.full(len(ends), rep[i]), rep[ends]], axis=1), axis=1))
            joined[np.isin(joined, joined[near])] = joined[i]
    pairs = np.concatenate(out)
    give_back()
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def large_regions(members: DataFrame, reps: DataFrame, comps: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Likely pairs of different components within regions that didn't give all pairs."""
    known = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    dealt = scratch.write(groups(scratch.write(known, "members"), scratch), "dealt")
    own = dealt.select("rep").distinct()
    closer = scratch.write(sketches(texts.join(own.withColumnRenamed("rep", "doc_id"), "doc_id")).join(reps, "rep"), "closer")
    keys = ["tree", "hi", "sub", "deep", "part", "chunk"]
    return dealt.join(closer, "rep").groupBy(*keys).applyInArrow(lambda table: _compare(table), "a long, b long").distinct()


def _set(text: bytes) -> set[bytes]:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in slices(batches, "ta", "tb"):
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("ta").cast(pa.binary()).to_pylist(), batch.column("tb").cast(pa.binary()).to_pylist()):
                if a != last:
                    last, own = a, _set(x)
                other = _set(y)
                both = len(own & other)
                keep.append(100 * both >= LINKED * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs that no component holds both ends of."""
    left, right = (comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def near_duplicates(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    base = scratch.write(signatures(df), "base")
    known = base.filter("doc_id is not null and sig is not null")
    classes = scratch.write(known.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    reps = scratch.write(classes.groupBy("rep").agg(F.min("sig").alias("sig")), "reps")
    pairs, members = neighbours(forest(reps).repartitionByRange("tree", "hi", "lo", "rep").sortWithinPartitions("tree", "hi", "lo", "rep"), scratch)
    pairs = scratch.write(pairs, "pairs")

    both = pairs.select("a", "b", "n", F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("a", "b", "n", "b", "a"))
    # A rank limit is applied before the shuffle, so a document with many candidates is no hot key.
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("n"), "y"))
    some = F.row_number().over(Window.partitionBy("x").orderBy(F.xxhash64("a", "b"), "y"))
    first = both.withColumn("r", best).filter(F.col("r") <= FIRST).unionByName(both.withColumn("r", some).filter(F.col("r") <= MIXED))
    first = scratch.write(first.select("a", "b").distinct(), "first")
    # Only documents with candidates are read again.
    ends = scratch.write(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ends")
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = scratch.write(marked(texts, ends, "doc_id").join(ends, "doc_id"), "texts")
    links = scratch.write(confirm(first, texts), "links1")
    comps = connected_components(links, scratch)
    rest = _across(pairs.select("a", "b"), comps).join(first, ["a", "b"], "left_anti")
    more = scratch.write(confirm(likely(rest, reps), texts), "links2")
    links = links.unionByName(more)
    comps = connected_components(links, scratch)
    wide = scratch.write(large_regions(members, reps, comps, texts, scratch).join(first, ["a", "b"], "left_anti"), "wide")
    if not wide.isEmpty():
        comps = connected_components(links.unionByName(scratch.write(confirm(wide, texts), "links3")), scratch)

    linked = classes.select("c1", "c2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    alone = base.filter("doc_id is null or sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = known.join(linked, ["c1", "c2"]).select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(df: DataFrame) -> DataFrame:
    """``df`` with one document of each component, that of the smallest id; columns as before.

    Of repeated rows with that id all stay.
    """
    gone = near_duplicates(df.select("doc_id", "text")).filter("not kept").select("doc_id").distinct()
    return df.join(gone, "doc_id", "left_anti").select(*df.columns)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Contract query: the component of each document, and whether it stays."""
    return near_duplicates(load(spark, sf_dir, "documents"))
