"""Corpus pipeline: documents to packed training sequences, one operator after the other.

Toxic documents go, one document of every group of near duplicates stays, documents that hold a secret go, sources are
mixed to their target weights, and the mix is packed. Every stage works on all rows its predecessor kept and takes the
columns of ``documents`` with any others; all but the last return them. Null texts pass the first three stages, the mix
takes no document without words, and an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.functions.session import ship_package
from gaugeline.llm import mixing, near_dups, packing, secret_scan, toxicity
from gaugeline.llm.common import read, store
from gaugeline.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below a toxicity of one half."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of smallest id."""
    ship_package(spark)
    return near_dups.keep_one(docs, near_dups.near_duplicates(docs))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a finding that the forest confirms."""
    return secret_scan.drop_leaking(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated, cut or left out as the mix takes them."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", drop_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The field, the signatures, the forest and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each stage's rows are written before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
