"""The workload: which tables play the parts of reference and candidate records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: id, ctry, name (first six words), addr (next
    eight), s1 (reference side: sources 0 to 9)."""
    d = table(spark, sf_dir, "documents")
    clean = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")
    w = F.filter(F.split(clean, " "), lambda t: t != "")
    return d.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("ctry"), F.array_join(F.slice(w, 1, 6), " ").alias("name"), F.array_join(F.slice(w, 7, 8), " ").alias("addr"),
        (F.substring("source", 4, 9).cast("int") < 10).alias("s1"), F.md5("text").alias("digest"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = records(spark, sf_dir)
    return r.where("s1").withColumnRenamed("id", "s1_id"), r.where("not s1").withColumnRenamed("id", "cand_id")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal texts: a lower bound of the true links."""
    a, b = sides(spark, sf_dir)
    return a.select("s1_id", "digest").join(b.select("cand_id", "digest"), "digest").select("s1_id", "cand_id")


#: The same records in SQL, for oracles.
RECORDS_SQL = """w AS (SELECT doc_id AS id, lang AS ctry, source, md5(text) AS digest,
  list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda t: t <> '') AS ws FROM documents),
 rec AS (SELECT id, ctry, array_to_string(ws[1:6], ' ') AS name, array_to_string(ws[7:14], ' ') AS addr, CAST(substr(source, 4) AS INT) < 10 AS s1, digest FROM w),
 a AS (SELECT id AS s1_id, * EXCLUDE (id) FROM rec WHERE s1), b AS (SELECT id AS cand_id, * EXCLUDE (id) FROM rec WHERE NOT s1)"""
