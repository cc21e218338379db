"""Ranks, gaps and margins within groups; ownership."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_rank(df: DataFrame, group: str, value: str, tie: str, name: str) -> DataFrame:
    """rank (from 1), gap to the group's best, and group size."""
    whole = Window.partitionBy(group)
    return df.withColumns({
        f"{name}_rank": F.row_number().over(whole.orderBy(F.desc(value), tie)),
        f"{name}_gap": F.max(value).over(whole) - F.col(value),
        f"{name}_size": F.count("*").over(whole),
    })


def second_best(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.nth_value(value, 2).over(w), F.lit(0)))


def margin(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Value minus the best of the group's other rows."""
    out = second_best(df, group, value, "_second").withColumn("_top", F.max(value).over(Window.partitionBy(group)))
    return out.withColumn(name, F.col(value) - F.when(F.col(value) == F.col("_top"), F.col("_second")).otherwise(F.col("_top"))).drop("_second", "_top")


def rank_features(aligned: DataFrame, views: list[str]) -> DataFrame:
    """Per view: score, rank and gap on both sides; n_views; list sizes."""
    out = aligned
    for v in views:
        for side, other in (("s1_id", "cand_id"), ("cand_id", "s1_id")):
            out = group_rank(out, side, f"v_{v}", other, f"{v}_{side[:2]}")
    out = out.withColumn("n_views", sum((F.col(f"v_{v}") > 0).cast("int") for v in views))
    first = views[0]
    out = out.withColumns({"n1": F.col(f"{first}_s1_size"), "n2": F.col(f"{first}_ca_size")})
    return out.drop(*[f"{v}_{s}_size" for v in views for s in ("s1", "ca")])


def twins(df: DataFrame, group: str, value: str, near: float, name: str) -> DataFrame:
    """How many other rows of the group are within near of its best."""
    w = Window.partitionBy(group)
    close = F.col(value) >= F.max(value).over(w) - near
    marked = df.withColumn("_close", close.cast("int"))
    return marked.withColumn(name, F.sum("_close").over(w) - F.col("_close")).drop("_close")


def one_owner(df: DataFrame, p: str = "p", tie: str | None = "rk", slack: float = 0.0) -> DataFrame:
    """One row per candidate (best p, then tie, then s1_id); with tie None, all
    rows within slack of the candidate's best."""
    if tie is None:
        return df.withColumn("_m", F.max(p).over(Window.partitionBy("cand_id"))).where(F.col(p) >= F.col("_m") - slack).drop("_m")
    w = Window.partitionBy("cand_id").orderBy(F.desc(p), F.desc(tie), "s1_id")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def counts_up_to(per: DataFrame, c: str, steps: int = 512) -> DataFrame:
    """per (one row per value of c, with _n) with _to: the sum of _n over values
    up to its own.  Sums run within steps of about equally many values and over
    the steps, so the values need not meet in one task."""
    keyed = per.withColumn("_d", F.col(c).cast("double"))
    cuts = keyed.approxQuantile("_d", [i / steps for i in range(1, steps)], 0.25 / steps)
    # any cuts give the same sums
    splits = [-math.inf, *(sorted({x for x in cuts if math.isfinite(x)}) or [0.0]), math.inf]
    stepped = Bucketizer(splits=splits, inputCol="_d", outputCol="_step", handleInvalid="keep").transform(keyed)
    before = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as steps
    base = stepped.groupBy("_step").agg(F.sum("_n").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    within = F.sum("_n").over(Window.partitionBy("_step").orderBy(c))
    return stepped.withColumn("_to", within).join(base.select("_step", "_base"), "_step").withColumn("_to", F.col("_to") + F.col("_base")).drop("_d", "_step", "_base")


def rank_average(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Mean of two scores' percentile ranks; ties share the middle rank.  Ranks
    come from counts per value, so no row set meets in one task.  Rows that lack
    a score have no rank and are left out."""
    out = df
    for c in (a, b):
        ordered = counts_up_to(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")), c)
        out = out.join(ordered.select(c, (F.col("_to") - (F.col("_n") - 1) / 2).alias(f"_r_{c}")), c)
    return out.withColumn(name, (F.col(f"_r_{a}") + F.col(f"_r_{b}")) / 2).drop(f"_r_{a}", f"_r_{b}")


def second_stage_context(pairs: DataFrame, others: DataFrame | None = None, sure: float = 0.5) -> DataFrame:
    """Where p stands among the pairs of its reference and of its candidate.
    others (cand_id, p): pairs with further references; they compete on the
    candidate's side and get no rows."""
    w1, w2 = Window.partitionBy("s1_id"), Window.partitionBy("cand_id")
    every = pairs.withColumn("_own", F.lit(True))
    if others is not None:
        every = every.unionByName(others.select("cand_id", "p").withColumn("_own", F.lit(False)), allowMissingColumns=True)
    conf = (F.col("p") >= sure).cast("long")
    every = every.withColumns({
        "p1_rank_c": F.rank().over(w2.orderBy(F.desc("p"))),
        "p1_gap_c": F.max("p").over(w2) - F.col("p"),
        "n_conf_c": F.sum(conf).over(w2) - conf,
    }).where("_own").drop("_own")
    return every.withColumns({
        "p1_rank_s1": F.rank().over(w1.orderBy(F.desc("p"))),
        "p1_gap_s1": F.max("p").over(w1) - F.col("p"),
        "p1_sum_s1": F.sum("p").over(w1),
        "n_conf_s1": F.sum(conf).over(w1) - conf,
    })


def sibling_aggregates(pairs: DataFrame, siblings: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """pairs with the greatest and mean of siblings' values; nulls are skipped,
    -1 where there is none."""
    made = [f(v).alias(f"sib_{v}_{n}") for v in values for n, f in (("max", F.max), ("mean", F.avg))]
    names = [f"sib_{v}_{n}" for v in values for n in ("max", "mean")]
    return pairs.join(siblings.groupBy(*keys).agg(*made), keys, "left").na.fill(-1, names)
