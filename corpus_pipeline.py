"""A training-corpus pipeline: five stages, each an operator of ``loomgrid.llm``, on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import langid, linededup, mixing, packing, simhash
from loomgrid.llm.common import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without one, or of no clear one, go."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; those of such lines alone stay, for the next stage to decide."""
    return linededup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents repeat or shrink as their blocks are taken."""
    return mixing.expand(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]

#: Language ID, fingerprints and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(name, stage(spark, docs, sf_dir))
    return docs
