"""Scans and sinks of records, id lists and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RECORD = StructType([StructField(c, StringType(), False) for c in ("entity_id", "business_name", "business_address", "country")])


def read_tsv(spark: SparkSession, path: str, schema: StructType = RECORD) -> DataFrame:
    """Tab-separated text: no quoting, no null markers, values trimmed, '' for
    what is missing."""
    raw = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "\u0000").option("enforceSchema", True).csv(path)
    filled = raw.na.fill("")
    return filled.select(*[F.trim(c).alias(c) for c in filled.columns])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def id_list(c: Column) -> Column:
    """'a, b,,c' to [a, b, c]."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def pairs_of(df: DataFrame, key: str, ids: str) -> DataFrame:
    """One row per (key, id), repeats within a list once."""
    return df.select(key, F.explode(F.array_distinct(id_list(F.col(ids)))).alias("id"))


def union_split(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def id_lists(pairs: DataFrame, owners: DataFrame, key: str, item: str, column: str) -> DataFrame:
    """Every owner once with its sorted distinct items, '' if it has none."""
    lists = pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ",").alias(column))
    return owners.select(key).distinct().join(lists, key, "left").select(key, F.coalesce(column, F.lit("")).alias(column))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def cached_stage(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at path, built first if it was never finished."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_report(df: DataFrame) -> str:
    """A small report frame as one JSON text."""
    return json.dumps([json.loads(x) for x in df.toJSON().take(10_000)])


def shape_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and repeated keys."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum((F.col("n") > 1).cast("long")).alias("n_repeated"))


def first_column_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids in the first column of a tab-separated file, without its header
    and blank lines."""
    lines = text_lines(spark, path).where("line > 0").where(F.trim("value") != "")
    return lines.select(F.trim(F.split("value", "\t")[0]).alias("id"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line) of one text file, or of the parts of one: line is 0 for the
    first line and above it for the others.  Parts follow by name; scans deal them
    by size, so the first part is read by itself."""
    file = "_metadata.file_path"
    first = spark.read.format("binaryFile").load(path).where("length > 0").agg(F.min(file)).first()[0]
    lines = spark.read.text(path)
    head = lines.where(F.col(file) == F.lit(first)).withColumn("line", F.monotonically_increasing_id())
    if first is None:
        return head
    return head.unionByName(lines.where(F.col(file) != F.lit(first)).withColumn("line", F.monotonically_increasing_id() + 1))


def write_lines(header: str, lines: DataFrame, path: str) -> None:
    """A header and the value column as one text file's parts: the header is the
    first line of the first part."""
    spark = lines.sparkSession
    first = spark.createDataFrame([(0, header)], "o int, value string")
    ordered = first.unionByName(lines.select(F.lit(1).alias("o"), "value")).repartitionByRange("o", "value").sortWithinPartitions("o", "value")
    ordered.select("value").write.text(path)
