"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its words and runs of marks, and buckets of
a few shape statistics. One weight per hash, shared by all grades, gives a
score; ordered thresholds cut it, so that P(grade <= k) = logistic(t_k - score).
From these come the expected grade and the tail probability of the top grade,
by which documents are selected.

Grades come from the labels: 0 for toxic rows, 1 for others of low quality, 2
for the rest. The fit is a proximal gradient descent with an L1 penalty on the
driver, over a bounded sample of labelled rows: those with the smallest hashes
of their id, ``MAX_TRAIN_ROWS`` at most. It is deterministic.

Defined results: a null text counts as empty; repeated rows each give a row; a
document labelled twice counts with its worse label; a label row without a
quality, a verdict on toxicity or an id takes no part in the fit; without
labelled rows all are kept; other columns are kept, but for those with the name
of a result column, which it replaces (``keep_good`` adds none); an empty table
gives an empty result; a very long text costs in proportion to its length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.batches import slices, without
from loomstone.session import load

BITS = 18
MAX_TRAIN_ROWS = 8_000
GRADES = 3
#: A document is kept if the probability of the top grade reaches this.
LEAST_TAIL = 0.5
ROUNDS, PENALTY = 300, 0.0006
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: str) -> np.ndarray:
    """Sorted distinct hashed features of a text."""
    raw = text.split()
    tokens = _TOKEN.findall(text.lower())
    kinds = set(tokens)
    n = max(len(raw), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = sum(1 for t in tokens if not t[0].isalnum() and t not in {".", ",", "'", "-", ";", ":", "!", "?"})
    again = sum(1 for a, b in zip(raw, raw[1:]) if a == b)
    shape = {
        "words": min(len(raw).bit_length(), 6),
        "marks": min(int(20 * marks / n), 10),
        "again": min(int(10 * again / n), 5),
        "distinct": int(10 * len(set(raw)) / n) if len(raw) >= 50 else 11,
        "lines": int(10 * len(set(lines)) / max(len(lines), 1)) if len(lines) >= 4 else 11,
        "stops": min(int(10 * sum(1 for t in tokens if t in ".,;:!?") / n), 5),
    }
    names = [*kinds, *(f" {k}={v}" for k, v in shape.items())]
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(x.encode("utf-8", "replace")) & mask for x in names), np.int32, len(names)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for k = 0 .. GRADES - 2, a column each."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))

    def predict(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and tail probability of the top grade."""
        below = self.below(score)
        return (1 - below).sum(axis=1), 1 - below[:, -1]


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Weights and thresholds for rows of hashed features."""
    size = 1 << BITS
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    # Hashes of fewer than five rows carry no weight.
    useful = np.bincount(flat, minlength=size) >= 5
    owner = np.repeat(np.arange(len(rows)), sizes)[useful[flat]]
    flat = flat[useful[flat]]
    w, seen = np.zeros(size), np.full(size, 1e-8)
    share = np.array([(grades <= k).mean() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    t_seen = np.full(GRADES - 1, 1e-8)
    rate = 0.3
    for _ in range(ROUNDS):
        score = np.bincount(owner, weights=w[flat], minlength=len(rows))
        # With F the logistic, a row of grade g has likelihood F(t_g - s) - F(t_(g-1) - s).
        cum = np.concatenate([np.zeros((len(rows), 1)), 1 / (1 + np.exp(np.clip(score[:, None] - t[None, :], -500, 500))), np.ones((len(rows), 1))], axis=1)
        dens = cum * (1 - cum)
        i = np.arange(len(rows))
        p = (cum[i, grades + 1] - cum[i, grades]).clip(1e-9)
        by_score = (dens[i, grades + 1] - dens[i, grades]) / p / len(rows)
        grad = np.bincount(flat, weights=by_score[owner], minlength=size)
        by_t = np.array([(-(dens[:, k + 1] / p)[grades == k].sum() + (dens[:, k + 1] / p)[grades == k + 1].sum()) / len(rows) for k in range(GRADES - 1)])
        seen += grad**2
        t_seen += by_t**2
        step = rate / np.sqrt(seen)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * PENALTY, 0)
        t = np.maximum.accumulate(t - rate / np.sqrt(t_seen) * by_t)
    return Model(w, t)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """A model from ``max_rows`` labelled documents at most; None if there are none."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    marked = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    sample = marked.orderBy(F.xxhash64(F.lit("classifier"), "doc_id"), "doc_id").limit(max_rows)
    # max_rows rows of 16 bytes: bounded, whatever the input.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t or "").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "grade", "f"])

    rows = labelled.mapInArrow(hashed, "doc_id long, grade int, f binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["f"])))
    return fit([np.frombuffer(r["f"], np.int32) for r in rows], np.array([r["grade"] for r in rows]))


def _scorer(df: DataFrame, model: Model | None, text_col: str):
    """A function from a slice of a batch to the expected grades and tail probabilities of its texts."""
    # The weights are 2 MB, whatever the input.
    shared = df.sparkSession.sparkContext.broadcast(model and (model.weights, model.thresholds))

    def scored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if shared.value is None:
            return np.full(batch.num_rows, GRADES - 1.0), np.ones(batch.num_rows)
        own = Model(*shared.value)
        return own.predict(np.array([own.weights[features(t or "")].sum() for t in batch.column(text_col).to_pylist()]))

    return scored


def classify(df: DataFrame, model: Model | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with expected_grade, p_top and kept."""
    made = ["expected_grade", "p_top", "kept"]
    others = without([c for c in df.columns if keep_text or c != text_col], made)
    scored = _scorer(df, model, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            grade, tail = scored(batch)
            new = [pa.array(grade, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= LEAST_TAIL, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *new], [*others, *made])

    schema = df.select(*others).schema.add("expected_grade", "double").add("p_top", "double").add("kept", "boolean")
    return df.mapInArrow(score, schema)


def keep_good(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that ``classify`` would mark as kept; columns as before, whatever their names."""
    scored = _scorer(df, model, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array(scored(batch)[1] >= LEAST_TAIL, pa.bool_()))

    return df.mapInArrow(keep, df.schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and verdict for each document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, load(spark, sf_dir, "labels")), keep_text=False)
