"""A corpus made ready in five stages, each on all that the one before has kept.

Quality rules drop documents, near duplicates leave one of each group, documents
with benchmark passages go, secrets are blotted out, and the rest is encoded and
decoded. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import decontamination, quality, secrets, sentencepiece_bpe, simhash
from proofline.llm.common import stored, table
from proofline.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and lie in their language's band of perplexity."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark; `n_chars` follows the text."""
    found = secrets.scan(docs)
    changed = F.size("secrets") > 0
    blotted = found.withColumn("text", F.when(changed, secrets.redacted(F.col("text"), F.col("secrets"))).otherwise(F.col("text")))
    return blotted.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of ids, and hashes of the ids and of the text decoded from them."""
    return sentencepiece_bpe.digests(docs, sentencepiece_bpe.load_model(tokenizer_file("piece_bpe_32k.model")))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("sentencepiece", sentencepiece),
]

#: Neither the perplexity nor the encoding can be said in SQL; `tests/llm` holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
