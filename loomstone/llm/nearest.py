"""Exact top-k search by inner product, as a Voronoi join.

Vectors become integers, component by component. Pivots, distinct vectors of a
hash sample, divide all rows into cells, each row in that of its nearest pivot.
A summary of each cell holds the members nearest to its pivot: the scores of a
query with these give a score that its k-th best reaches at least. The queries
of a cell have a summary too: the least such score, the greatest norm, and for
each pivot the greatest inner product with it. By Cauchy's inequality a row at
distance d from its pivot p scores at most max(q . p) + max |q| * d with them,
so only rows far enough from their pivots to reach the least score are sent to
the queries. Cells near each other share a pack of queries; a pack's rows are
dealt into blocks, and a cell with very many queries into splits, so that no
task depends on how many rows lie in one cell. Each task gives its best k for a
query; of these the best k of all blocks are the result, which is exact.

Defined results: a vector that is null or has a null, infinite or undefined
component takes no part; vectors of unequal length count as filled up with
zeros, and an empty one scores 0; scaled components and scores beyond 64 bits
are the nearest 64-bit integer; a null id is no query but a candidate, after
the others among ties; rows of one id are rows of their own, each its own query
and the others' candidate; an empty table gives an empty result; other columns
are ignored. All vectors are filled up to the longest in memory, and blocks
have fewer rows then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.session import Scratch, load

#: Pivots at most; fewer where the summaries' vectors would take more than SUMMARY bytes.
PIVOTS, SUMMARY = 256, 32 << 20
#: Queries of a pack, and components of a block of rows and of a table of scores, about.
QUERIES, BLOCK, CELLS = 2048, 1 << 23, 1 << 22
#: Share by which bounds are loosened, for what floating point rounds off.
SLACK = 1e-9
_EXACT, _LONG = float(1 << 53), (1 << 63) - 1


def scaled(vector: Column, factor: float) -> Column:
    """floor(factor * x) of each component x, as 64-bit integers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of integers as rows of ``dim`` numbers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``; beyond 64 bits the nearest 64-bit integer."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    if most(a) * most(b) * max(a.shape[1], 1) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)  # every sum is exact
    return np.clip(a.astype(object) @ b.astype(object).T, -_LONG - 1, _LONG).astype(np.int64)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one row, of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def _local(queries: pa.Table, rows: pa.Table, k: int, dim: int) -> pa.Table:
    """(query, query_id, vec_id, score): the best k of a block for each query, but for those that cannot be among its best."""
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not queries.num_rows or not rows.num_rows:
        return schema.empty_table()
    rows = rows.sort_by([("vec_id", "ascending")])  # nulls last, so that places follow the order among ties
    rid, qid = rows.column("rid").to_numpy(), queries.column("rid").to_numpy()
    q, x = _matrix(queries.column("v"), dim), _matrix(rows.column("v"), dim)
    least = queries.column("least").to_numpy()
    step = max(1, CELLS // len(q))
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qid]
    for lo in range(0, len(x), step):
        scores = _scores(q, x[lo : lo + step])
        for i in range(len(q)):
            at = np.flatnonzero((scores[i] >= least[i]) & (rid[lo : lo + step] != qid[i]))
            at = at[_best(scores[i][at], k)]
            kept[i].append((at + lo, scores[i][at]))
    query, place, score = [], [], []
    for i, parts in enumerate(kept):
        at, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, ~s))[:k]  # ~s falls as s rises, and stays within 64 bits
        query.append(np.full(len(order), i))
        place.append(at[order])
        score.append(s[order])
    query, place = np.concatenate(query), pa.array(np.concatenate(place).astype(np.int64))
    return pa.Table.from_arrays([pa.array(qid[query]), queries.column("vec_id").take(pa.array(query)), rows.column("vec_id").take(place), pa.array(np.concatenate(score))], schema=schema)


def _pivots(rows: DataFrame, n: int, dim: int, k: int) -> np.ndarray:
    """Distinct vectors of a hash sample, about the square root of ``n`` and PIVOTS at most."""
    most = max(1, min(PIVOTS, math.isqrt(n), SUMMARY // (8 * max(dim, 1) * (k + 1))))
    h = F.pmod(F.xxhash64(F.lit("pivot"), "v"), F.lit(1 << 40))
    # So many that there are enough distinct ones but where rows repeat; the limit bounds what the driver gets.
    sample = rows.filter(h < int(min(1.0, 4 * most / max(n, 1)) * (1 << 40))).select(h.alias("h"), "v").distinct().orderBy("h", "v").limit(most)
    found = [r["v"] for r in sample.collect()]
    out = np.zeros((max(len(found), 1), dim))
    for i, v in enumerate(found):
        out[i, : len(v)] = v
    return out


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest of those left."""
    left, out = set(range(1, len(pivots))), [0]
    while left:
        out.append(min(left, key=lambda j: (float(np.square(pivots[j] - pivots[out[-1]]).sum()), j)))
        left.remove(out[-1])
    return out


def top_inner(df: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``df`` with the highest scores for each row that ``queries`` marks, itself excluded."""
    spark = df.sparkSession
    scratch = Scratch(spark, "nearest")
    valid = df.filter(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), factor).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    n, dim = valid.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    pivots = _pivots(valid, n, dim, k)
    half = np.square(pivots).sum(axis=1) / 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // (dim + len(pivots)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = _matrix(part.column("v"), dim).astype(np.float64)
                cell = (x @ pivots.T - half).argmax(axis=1)
                far = np.sqrt(np.square(x - pivots[cell]).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], [*part.schema.names, "cell", "far"])

    # The row id is written with the rows, so that it stays.
    numbered = valid.withColumn("rid", F.monotonically_increasing_id())
    placed = scratch.write(numbered.mapInArrow(place, "vec_id long, v array<long>, is_query boolean, rid long, cell int, far double"), "placed")

    # Of each cell the k + 1 rows nearest to its pivot: PIVOTS * (k + 1) rows at most, of SUMMARY bytes.
    nearest = Window.partitionBy("cell").orderBy("far", "rid")
    near = placed.select("cell", "far", "rid", "v").withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k + 1).select("rid", "v").collect()
    known = np.zeros((len(near), dim), np.int64)
    for i, r in enumerate(near):
        known[i, : len(r["v"])] = r["v"]
    known_rid = np.array([r["rid"] for r in near], np.int64)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // (dim + len(known) + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                q, rid = _matrix(part.column("v"), dim), part.column("rid").to_numpy()
                scores = _scores(q, known)
                least = np.full(len(q), -np.inf)
                for i in range(len(q)):
                    others = scores[i][known_rid != rid[i]]
                    if len(others) >= k:
                        least[i] = np.partition(others, len(others) - k)[len(others) - k]
                least -= np.where(np.isfinite(least), np.abs(least) * SLACK, 0)
                norm = np.sqrt(np.square(q.astype(np.float64)).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least), pa.array(norm)], [*part.schema.names, "least", "norm"])

    asked = scratch.write(placed.filter("is_query").select("rid", "vec_id", "v", "cell").mapInArrow(bound, "rid long, vec_id long, v array<long>, cell int, least double, norm double"), "asked")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each cell of queries the greatest inner product with each pivot."""
        most: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            products = _matrix(batch.column("v"), dim).astype(np.float64) @ pivots.T
            for c in np.unique(cells):
                own = products[cells == c].max(axis=0)
                most[c] = np.maximum(most[c], own) if c in most else own
        for c, own in most.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["cell", "pivot", "most"])

    # PIVOTS rows, and PIVOTS * PIVOTS rows, at most.
    summary = {r["cell"]: r for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), F.max("norm").alias("norm")).collect()}
    reached = {(r["cell"], r["pivot"]): r["most"] for r in asked.select("cell", "v").mapInArrow(reach, "cell int, pivot int, most double").groupBy("cell", "pivot").agg(F.max("most").alias("most")).collect()}

    packs: list[list[int]] = []
    held = QUERIES
    for c in _chain(pivots):
        if c in summary:
            if held + summary[c]["n"] > QUERIES:
                packs.append([])
                held = 0
            packs[-1].append(c)
            held += summary[c]["n"]

    def farthest(c: int, j: int) -> float:
        """How far from pivot j a row must lie to reach the best of a query of cell c."""
        s, most = summary[c], reached[c, j]
        missing = s["least"] - most - SLACK * abs(most)
        return missing / s["norm"] if s["norm"] else -math.inf if missing <= 0 else math.inf

    needs = [(j, p, float(min(farthest(c, j) for c in cells))) for p, cells in enumerate(packs) for j in range(len(pivots))]
    needed = spark.createDataFrame(needs, "cell int, pack int, need double")
    enough = F.col("far") * (1 + SLACK) + SLACK >= F.col("need")
    wanted = {r["pack"]: r["n"] for r in placed.select("cell", "far").join(F.broadcast(needed), "cell").filter(enough).groupBy("pack").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows_a_block = max(1, BLOCK // max(dim, 1))
    splits = {p: -(-sum(summary[c]["n"] for c in cells) // QUERIES) for p, cells in enumerate(packs)}
    blocks = {p: max(1, -(-wanted.get(p, 0) // rows_a_block)) for p in splits}
    of_pack = spark.createDataFrame([(c, p, splits[p], blocks[p]) for p, cells in enumerate(packs) for c in cells], "cell int, pack int, splits int, blocks int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("rid"), F.col(c)).cast("int")
    sent = placed.join(F.broadcast(needed), "cell").filter(enough).join(F.broadcast(of_pack.select("pack", "splits", "blocks").distinct()), "pack")
    sent = sent.select("pack", every("splits").alias("split"), dealt("blocks").alias("block"), "rid", "vec_id", "v")
    posed = asked.join(F.broadcast(of_pack), "cell").select(F.col("pack").alias("p"), dealt("splits").alias("s"), every("blocks").alias("b"), "rid", "vec_id", "v", "least")
    local = posed.groupBy("p", "s", "b").cogroup(sent.groupBy("pack", "split", "block")).applyInArrow(lambda q, x: _local(q, x, k, dim), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """Contract query: the ten best of all embeddings for each row whose id is divisible by 100."""
    return top_inner(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v x ON q.r <> x.r WHERE q.vec_id % 100 = 0),
     k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10"""
