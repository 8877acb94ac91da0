"""The registered query of each text operator: its whole table, production parameters, whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofline.llm import (
    clusters,
    decontamination,
    html_text,
    packing,
    quality,
    ranking,
    repeats,
    secrets,
    sentencepiece_bpe,
    sharding,
    simhash,
    warc,
    word_bpe,
)
from proofline.llm.common import table

#: Where the vocabulary files are; set it to use another folder.
TOKENIZER_FOLDER: str | None = None


def tokenizer_file(name: str) -> str:
    if TOKENIZER_FOLDER:
        return f"{TOKENIZER_FOLDER}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"), shards=40)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = packing.ranks_of(tokenizer_file("byte_bpe_50k.tiktoken"))
    return packing.pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, end=50256)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), sentencepiece_bpe.load_model(tokenizer_file("piece_bpe_32k.model")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"), word_bpe.load_model(tokenizer_file("word_bpe_49k.json")))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(table(spark, sf_dir, "embeddings"))


_QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_html_text": op2_html_text,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_suffix_array": op7_suffix_array,
    "op8_warc": op8_warc,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_word_bpe": op12_word_bpe,
    "op13_clusters": op13_clusters,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return {"op8_warc": warc.ORACLE, "op11_ranked_search": ranking.ORACLE, "op13_clusters": clusters.ORACLE}
