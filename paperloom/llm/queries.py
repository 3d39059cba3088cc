"""The queries that apply each operator to its whole table, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import chat, clustering, decontamination, language, manifest, mixing, ngram_jaccard, quality_rules, secrets, sql, substring_dedup, token_counts, toxicity, warc
from paperloom.llm.common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


QUERIES = {"op6_chat_formatting": op6_chat_formatting, "op2_toxicity": op2_toxicity, "op3_suffix_dedup": op3_suffix_dedup, "op1_ngram_jaccard": op1_ngram_jaccard, "op4_secret_scans": op4_secret_scans, "op5_decontamination": op5_decontamination, "op7_quality_rules": op7_quality_rules, "op8_mixing": op8_mixing, "op9_language_id": op9_language_id, "op10_token_counts": op10_token_counts,
           "op11_merkle_manifest": op11_merkle_manifest, "op12_centroid_clustering": op12_centroid_clustering, "op13_warc": op13_warc}

SQL: dict[str, str] = {"op11_merkle_manifest": sql.MERKLE_MANIFEST, "op12_centroid_clustering": sql.CENTROID_CLUSTERING, "op13_warc": sql.WARC}
