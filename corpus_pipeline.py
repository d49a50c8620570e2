"""A text corpus from raw documents to token ids, stage by stage.

Each stage takes the rows its predecessor kept: toxic documents go, of equal texts one stays, of
near copies one stays, the mixture decides which documents train how often and when, and the
last stage turns them into token ids and back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm import bpe, dedup, jaccard, mixture, toxicity
from gridpanel.llm.langid import held_out
from gridpanel.llm.queries import TOXIC_FROM, WORD_RULE
from gridpanel.llm.registry import table
from gridpanel.session import ship_package, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the limit; labels teach outside the held-out rows only."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    net = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, net, out="_toxicity").where(F.col("_toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    ship_package(spark)
    return dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    ship_package(spark)
    return jaccard.one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target asks for."""
    ship_package(spark)
    return mixture.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian 32-bit) of every document, and whether they decode to its text."""
    ship_package(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    told = bpe.bpe_codec(docs.select("doc_id", "lang", "source", "text"), path, WORD_RULE)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return told.select("doc_id", "lang", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixture", mix_sources),
    ("bpe", encode),
]

#: The first stage scores with a fitted network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
