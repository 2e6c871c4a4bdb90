"""The registered query of each operator: production parameters, whole tables, whole texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination, licenses, line_rules, merkle, near_duplicates, packing, pages, private_data, quality, retrieval_packing, secrets,
    substrings, whitening,
)
from .tables import documents, labels

#: The vocabulary files that packing counts tokens by.
TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), packing.Capacity(tokens=2048))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(documents(spark, sf_dir))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir), percent=85)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir), threshold=0.3)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.known(spark))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(documents(spark, sf_dir), window=35)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.findings(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=4)


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), closing=2, window=4096)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return merkle.proofs(docs, merkle.COLUMNS, group="lang", order="doc_id", changed=merkle.tampered(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_best_fit_packing, op3_secret_scan, op4_html_extraction, op5_near_duplicates,
        op6_quality_classifier, op7_quality_rules, op8_license_scan, op9_substring_dedup, op10_personal_data,
        op11_embedding_whitening, op12_retrieval_packing, op13_merkle_manifest,
    )
}
#: The other operators rest on trained scores, tokenizers or exact sets; tests hold them against brute force.
ORACLES = {"op8_license_scan": licenses.oracle(), "op13_merkle_manifest": merkle.oracle()}
