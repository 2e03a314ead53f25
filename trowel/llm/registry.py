"""Queries over the driver's tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.html_extract import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.quality import host_rules

    return host_rules(_table(spark, sf_dir, "documents"), domain="source").drop("shrunk_rate")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.ngram_join import link_components

    return link_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.mixing import EPOCHS, RATIO, SEED, WEIGHTS, mix_report

    return mix_report(_table(spark, sf_dir, "documents"), RATIO, EPOCHS, SEED, WEIGHTS)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.line_dedup import dedup_report

    return dedup_report(_table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.substring_dedup import remove_repeated_windows

    return remove_repeated_windows(_table(spark, sf_dir, "documents"), width=20)


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trowel.llm.piece_codec import encode_texts

    return encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.embed_dedup import dedup_vectors

    return dedup_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.secrets_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.lang_id import language_report

    return language_report(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.periodic_runs import runs_report

    return runs_report(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trowel.llm.lexical_search import search_report

    return search_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_quality_rules": op2_quality_rules,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_mixing": op4_mixing,
        "op5_line_dedup": op5_line_dedup,
        "op6_license_scans": op6_license_scans,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_sentencepiece_codec": op8_sentencepiece_codec,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_secret_scans": op10_secret_scans,
        "op11_language_id": op11_language_id,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    from trowel.llm import lexical_search, line_dedup, mixing, periodic_runs, quality

    return {
        "op2_quality_rules": quality.SQL,
        "op4_mixing": mixing.SQL,
        "op5_line_dedup": line_dedup.SQL,
        "op12_periodic_runs": periodic_runs.SQL,
        "op13_lexical_search": lexical_search.SQL,
    }
