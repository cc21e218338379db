"""From documents to packed training sequences: quality rules, near-duplicates,
secrets, mixing, packing.  Each stage is written as Parquet and read again.

Cases: a null text fails the quality rules; a null doc_id is kept (in a group of
near-duplicates only where no row has an id); repeated rows are near-duplicates
of one another; an empty table gives an empty result; other columns are carried
along under any name up to packing, which returns its pieces alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm import common, mixing, packing, quality_rules, secret_scan, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a
    similarity of 0.8 or more."""
    return simhash.drop_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixing schedule."""
    return mixing.in_order(mixing.mix(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences, which are numbered in
    the order of the mixture: file by file, row by row of what mix() wrote."""
    place = common.fresh(docs, "_place")
    file = F.coalesce(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return packing.pack(docs.withColumn(place, F.shiftleft(file, 24) + F.col("_metadata.row_index")), order=place)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secret scan", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Token ids, SimHash trees and certified cutoffs have no SQL form; the tests
#: hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
