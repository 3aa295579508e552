"""The pipeline's stages against what each should keep, and its queries over the test tables."""

import os
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:4]:
        out = step(spark, docs, SF)
        assert out.columns == before.columns, name
        rows = Counter(tuple(r) for r in out.collect())
        given = Counter(tuple(r) for r in docs.collect())
        if name == "mixing sources":
            assert set(rows) <= set(given) and max(rows.values()) <= 2
        else:
            assert not rows - given
        docs = spark.createDataFrame([r for r, n in rows.items() for _ in range(n)], before.schema)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicate_stage_leaves_one_of_each_class(spark):
    import corpus_pipeline
    from tillcast.llm.op7_ngram_jaccard import classes
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    left = corpus_pipeline.near_duplicates(spark, docs, SF)
    again = classes(left)
    assert again.where("n_links > 0").count() == 0
    assert {r.doc_id for r in left.collect()} == {r.class_id for r in classes(docs).select("class_id").distinct().collect()}


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF).count() == 0


def test_run_gives_the_packed_rows(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert not out.duplicated(["sequence_id", "offset"]).any()


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)] + ["pipeline"])
def test_queries_are_registered(name):
    import __spark_entry__
    assert sum(q.startswith(name) for q in __spark_entry__.queries()) == 1
