"""The pipeline's stages and their decisions."""

import corpus_pipeline
from pyspark.sql import functions as F

from gridpanel.llm.registry import table
from gridpanel.session import written
from tests.conftest import SF


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        kept[name] = docs.count()
        assert docs.columns == table(spark, SF, "documents").columns
        assert docs.join(before, docs.columns, "left_anti").isEmpty()
    assert docs.count() > 0 and kept["ngram_jaccard"] <= kept["exact_dedup"] < kept["toxicity"] <= 200
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where(~F.col("round_trip")).isEmpty() and last.count() == docs.count()


def test_no_copies_are_left(spark):
    docs = table(spark, SF, "documents")
    once = corpus_pipeline.drop_copies(spark, docs, SF)
    assert once.count() == once.select("text").distinct().count() == docs.select("text").distinct().count()


def test_odd_documents(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y z", "en", None, 5), (4, "word " * 50_000, "en", "b", 250_000)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.where(~F.col("round_trip")).isEmpty() and docs.where("doc_id = 4").count() >= 1
    empty = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
