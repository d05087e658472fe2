"""The pipeline against its stages by plainer means, on a small table."""

import re

import corpus_pipeline
from loomstone.llm import classifier
from loomstone.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def test_stages_and_queries_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    assert {re.match(r"op\d+", q)[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)} and set(ORACLES) <= set(QUERIES)


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id: r.text for r in classifier.classify(docs, model).filter("kept").collect()}
    sets = {i: _shingles(t) for i, t in kept.items()}
    label = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    items = [_shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = {i for i in sets if label[i] == i and not any(len(sets[i] & x) >= 0.75 * len(x) for x in items if x)}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in found} == expected and all(r.n_tokens == len(r.ids) for r in found)
