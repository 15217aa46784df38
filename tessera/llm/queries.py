"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crf_secrets, decontam, langmask, mixing, ppm, prefix_hash, rlz_dedup, trie_join, url_rules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ppm_score": lambda s, d: ppm.query(s, table(s, d, "documents")),
        "op2_crf_secrets": lambda s, d: crf_secrets.query(s, table(s, d, "documents")),
        "op3_prefix_hash": lambda s, d: prefix_hash.query(s, table(s, d, "documents")),
        "op4_rlz_dedup": lambda s, d: rlz_dedup.query(s, table(s, d, "documents")),
        "op5_language_masks": lambda s, d: langmask.query(s, table(s, d, "documents")),
        "op6_mix_sources": lambda s, d: mixing.query(table(s, d, "documents")),
        "op7_trie_jaccard": lambda s, d: trie_join.query(s, table(s, d, "documents")),
        "op8_url_rules": lambda s, d: url_rules.query(s, table(s, d, "pages")),
        "op9_simhash_decontam": lambda s, d: decontam.query(s, table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_warc": lambda s, d: warc.query(s, table(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_rlz_dedup": rlz_dedup.SQL,
        "op6_mix_sources": mixing.SQL,
        "op7_trie_jaccard": trie_join.SQL,
        "op8_url_rules": url_rules.SQL,
        "op9_simhash_decontam": decontam.SQL,
        "op10_warc": warc.SQL,
    }
