"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bit_planes, decontaminate, fingerprints, hard_negatives, line_dedup, log_bilinear, near_dedup, shards, substring_dedup, token_files, toxicity, transducer, url_filter
from plumbline.llm.tables import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(read(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, manifest = token_files.write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digest(token_files.read_token_files(spark, folder, manifest))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(read(spark, sf_dir, "pages"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.shuffle_into_shards(read(spark, sf_dir, "documents")))


def op7_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return transducer.encoded_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ("doc_id",))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


def op12_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.lm_scores(read(spark, sf_dir, "documents"))


def op13_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes.cluster_vectors(read(spark, sf_dir, "embeddings"))


OPERATORS = (
    op1_substring_dedup, op2_toxicity, op3_near_dedup, op4_token_files, op5_url_filter,
    op6_shards, op7_transducer, op8_line_dedup, op9_decontaminate, op10_fingerprints,
    op11_hard_negatives, op12_log_bilinear, op13_bit_planes,
)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": line_dedup.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_bit_planes": bit_planes.ORACLE}
