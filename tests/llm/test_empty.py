"""Every registered query, and the pipeline, over empty tables and over rows of nulls."""

import pytest

import corpus_pipeline
from loomstone.llm.registry import QUERIES

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
#: Rows of a result over one row of nulls a table: none where a null can't be asked, two where a conversation is added.
ROWS = {"op8_chat_format": 2, "op12_exact_top_k": 0, "op13_spelling_variants": 0}


@pytest.fixture(scope="module", params=["empty", "nulls"])
def tables(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    for name, schema in TABLES.items():
        rows = [] if request.param == "empty" else [(None,) * len(schema.split(", "))]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return request.param, str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    kind, folder = tables
    n = len(QUERIES[name](spark, folder).collect())
    assert n == ((1 if name == "op8_chat_format" else 0) if kind == "empty" else ROWS.get(name, n if name == "op4_decontaminate" else 1))


def test_pipeline(spark, tables):
    kind, folder = tables
    assert len(corpus_pipeline.run(spark, folder).collect()) <= (0 if kind == "empty" else 1)
