"""Rewrites learnt from pairs: romanised words, and names of areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def modes(counts: DataFrame, keys: list[str], value: str, least: int, purity: float) -> DataFrame:
    """(keys, value, n, share): the most frequent value of each key (ties to the
    lesser), if it occurs least times and makes up purity of its key."""
    per = Window.partitionBy(*keys)
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(per), "_r": F.row_number().over(per.orderBy(F.desc("n"), value))})
    return ranked.where((F.col("_r") == 1) & (F.col("n") >= least) & (F.col("share") >= purity)).drop("_r")


def word_rewrites(pairs: DataFrame, least: int = 3, purity: float = 0.6) -> DataFrame:
    """(word, to, n, share) from labelled pairs (ours, theirs: token arrays) of
    names in another script: lists of one length are laid side by side."""
    aligned = pairs.where((F.size("ours") == F.size("theirs")) & (F.size("ours") > 0)).select(F.explode(F.arrays_zip("theirs", "ours")).alias("z"))
    differ = aligned.select(F.col("z.theirs").alias("word"), F.col("z.ours").alias("to")).where("word <> to and not word rlike '^[0-9]+$'")
    return modes(differ.groupBy("word", "to").agg(F.count("*").alias("n")), ["word"], "to", least, purity)


def area_aliases(pairs: DataFrame, sure: float = 0.9, least: int = 50, purity: float = 0.8) -> DataFrame:
    """(ctry, theirs, ours, n, share): how records spell the areas of references.
    pairs: s1_id, cand_id, ctry, rk, ours, theirs (areas, '' if none).  Each
    record's best pair counts, if its rank score reaches sure."""
    best = Window.partitionBy("cand_id").orderBy(F.desc("rk"), "s1_id")
    top = pairs.where(F.col("rk") >= sure).withColumn("_r", F.row_number().over(best)).where("_r = 1 and ours <> '' and theirs <> ''")
    return modes(top.groupBy("ctry", "theirs", "ours").agg(F.count("*").alias("n")), ["ctry", "theirs"], "ours", least, purity)
