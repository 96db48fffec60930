"""The corpus pipeline: quality rules, toxicity, near copies, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; labels come from sf_dir. All
stages but the last return docs' own columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import shared_dir
from jobloom.llm.jaccard import jaccard_components
from jobloom.llm.mixing import mix_documents
from jobloom.llm.packing import pack_documents
from jobloom.llm.quality import apply_quality_rules
from jobloom.llm.toxicity import score_toxicity, train_scorer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled thresholds."""
    verdict = apply_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # rows of one id and one text share a verdict; other texts of an id are judged apart
    kept = verdict.filter("kept").select("doc_id", "text_hash").distinct()
    same = F.xxhash64(docs["text"], docs["lang"]).eqNullSafe(kept["text_hash"]) & docs["doc_id"].eqNullSafe(kept["doc_id"])
    return docs.join(kept, same, "left_semi")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-channel scorer, learnt from the labelled ones among them, doesn't call toxic."""
    scorer = train_scorer(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, scorer).filter("predicted = 0").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8: the least id."""
    groups = jaccard_components(docs, n=5, num=80, den=100)
    kept = groups.filter("component_id IS NULL OR doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the capped water-filling mix takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows."""
    return pack_documents(docs, "word_bpe_49k.json", 2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table, each one's result written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs


#: The learnt scorer and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
