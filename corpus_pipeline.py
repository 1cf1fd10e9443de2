"""A corpus pipeline over the training-data operators: each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common, decontaminate, packing, simhash, suffixes, toxicity
from marlstone.llm.queries import vocabulary


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars, where there, follows the text."""
    if {"n_chars", "text"} <= set(docs.columns):
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score 0.5 or more; fitted on the labels of ``sf_dir``."""
    return toxicity.without_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document, that with the smallest doc_id, of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 200 bytes that occur twice out of the texts; no document goes."""
    return _columns(suffixes.without_repeats(docs), docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a window of a benchmark item of ``sf_dir``."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=0)


STAGES = [("toxicity", toxic), ("simhash", near_copies), ("suffixes", repeated_strings), ("decontamination", uncontaminated), ("packing", packed)]

#: Tokenizing, the classifier and suffix sorting have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{name}")
    return docs
