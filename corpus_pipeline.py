"""A training corpus from raw documents: five stages, each written and read again by the next.

Each stage takes the documents that the one before kept.  Tables that a stage stores on its way go
when its result is written, and a stage's result goes when the next one is.  A task that is lost is
run again from the stage's input, which is a written table.

Defined results, for every stage: an empty table gives an empty one; null texts, ids and sources are
values of their own as each stage says; rows that repeat another are rows of their own, but where
duplicates go; texts of any length are processed whole; columns beside doc_id, text, source and
n_chars are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opalgrid.llm import decontaminate, mixing, pii, quality, simhash
from opalgrid.llm._store import fresh_path, remove, scope, write


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule or their host's verdict rejects go.

    Null and empty texts have too few words and go; a null source is a host of its own."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Near means a Jaccard similarity of 0.8 or more of the sets of five-word shingles, among texts
    whose fingerprints lie within a radius that such pairs rarely exceed; every such link counts.  A null doc_id is larger
    than any other; ties (one doc_id, unlike texts) go to the smallest hash of the text; of rows that
    agree in both any one stays."""
    return simhash.keep_one(docs, simhash.NEAR_SHINGLE, simhash.NEAR_RADIUS, similarity=simhash.NEAR_SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.  Null and empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows the text.  A null text stays null."""
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; mix_copy counts from 0 (mix_copy_2 where the input
    has that column, and so on).  Empty texts are never taken; a null source is a source of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SimHash fingerprints and keyed surrogates cannot be written in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scope(spark):
            write(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
