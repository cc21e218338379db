"""The queries of this subpackage: name to (spark, sf_dir) -> DataFrame, and SQL
where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, bwt_dedup, chaining, license_scan, mixing, packing, quality_rules, secret_scan, simhash, va_file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "_mix.*")


def op2_suffix_dedup(spark, sf_dir):
    return bwt_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


def op3_lm_score(spark, sf_dir):
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_va_topk(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return va_file.top_k(emb, emb.where("vec_id % 100 = 0"))


def op6_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_chains(spark, sf_dir):
    return chaining.substring_classes(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_suffix_dedup, op3_lm_score, op4_quality_rules, op5_va_topk, op6_license_scan,
        op7_secret_scan, op8_simhash, op9_substring_chains, op10_best_fit_packing,
    )
}
ORACLES: dict[str, str] = {"op5_va_topk": va_file.oracle_sql(), "op6_license_scan": license_scan.oracle_sql()}
