"""The training-data pipeline: documents to packed sequences.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``; the last returns
the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillcast.llm import op3_quality_classifier, op5_packing, op6_toxicity, op7_ngram_jaccard, op9_mixing
from tillcast.llm.common import first_columns, release, stage, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models do not call toxic."""
    return op6_toxicity.clean(docs, op6_toxicity.learn(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers call good."""
    labels = first_columns(table(spark, sf_dir, "labels"), id="doc_id", mark="quality")
    views, model = op3_quality_classifier.learn(docs, labels)
    release(views)
    return op3_quality_classifier.good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id."""
    return op7_ngram_jaccard.deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return op9_mixing.mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens."""
    return op5_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources", mixing), ("best-fit packing", packing)]

#: Models and packing are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
