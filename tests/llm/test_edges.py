"""The pipeline and the token operators on empty tables, nulls and clashing columns."""

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobloom.llm import packing, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """Tables of which documents have nulls in every column, and none."""
    found = {}
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = {"nulls": [(1, text, None, None, None), (2, None, "en", "a", 1), (3, "", "en", "a", 0), (None, text + " more", "en", None, 5), (4, text, "en", "a", 5), (4, text, "en", "a", 5)], "empty": []}
    for name, some in rows.items():
        path = tmp_path_factory.mktemp(name)
        spark.createDataFrame(some, DOCS).write.parquet(f"file://{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
        found[name] = f"file://{path}"
    return found


def test_pipeline_on_nulls_and_nothing(spark, base):
    assert corpus_pipeline.run(spark, base["empty"]).count() == 0
    pieces = corpus_pipeline.run(spark, base["nulls"])
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} <= {1, 4, None} and pieces.count() > 0


def test_clashing_columns_of_token_operators(spark, base, tmp_path):
    docs = spark.read.parquet(f"{base['nulls']}/documents.parquet").withColumns({c: F.lit("z") for c in ("ids", "part", "at", "start", "length", "n_tokens", "sequence_id", "offset", "_m", "_p")})
    path = tokens.write_token_ids(docs, f"file://{tmp_path}/{uuid.uuid4().hex}", "byte_bpe_50k.json", 2)
    assert tokens.token_digests(spark, path).count() == 6
    packed = packing.pack_documents(docs, "word_bpe_49k.json", 2)
    assert packed.select("doc_id").distinct().count() == 5 and "z" not in {str(v) for r in packed.limit(5).collect() for v in r}
