"""One query for each operator, over whole tables, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import bpe, chat, decontam, exact_dedup, fim, hard_negatives, langid, license_scan, near_dup, quality, token_store, toxicity, warc
from keyfold.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    """The published vocabulary file, as the installed package names it."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").withColumn("path", license_scan.file_path()))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), vocabulary())


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.shifted(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_near_dup, op3_chat_format, op4_toxicity, op5_exact_dedup, op6_quality, op7_bpe, op8_token_store, op9_decontamination, op10_language_id, op11_fill_in_middle, op12_warc_revisits, op13_hard_negatives)
}
ORACLES: dict[str, str] = {"op3_chat_format": chat.ORACLE_SQL, "op5_exact_dedup": exact_dedup.ORACLE_SQL, "op9_decontamination": decontam.ORACLE_SQL, "op11_fill_in_middle": fim.ORACLE_SQL, "op12_warc_revisits": warc.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
