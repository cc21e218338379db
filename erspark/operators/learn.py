"""Folds, populations, density shift, and the pair models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_hash(c: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) of an id, whatever the partitioning."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1_000_000)) / 1e6


def fold(c: Column, k: int = 5, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(k)).cast("int")


def population(c: Column, ranker: float = 0.3, audit: float = 0.1, seed: int = 11) -> Column:
    u = share_hash(c, seed)
    return F.when(u < ranker, "ranker").when(u < ranker + audit, "audit").otherwise("pool")


def decoy_ratio(train: DataFrame, test: DataFrame) -> DataFrame:
    """q = decoys per owner in test over that in train, less one, by country.
    Both: ctry, decoys, owners."""
    r = lambda df, n: df.select("ctry", (F.col("decoys") / F.col("owners")).alias(n))
    return r(train, "a").join(r(test, "b"), "ctry").select("ctry", F.greatest(F.col("b") / F.col("a") - 1, F.lit(0.0)).alias("q"))


def add_clones(pairs: DataFrame, q: Column, seed: int = 5) -> DataFrame:
    """Pairs of unowned records, cloned with chance q: is_clone and base_id say
    which; a clone is a record of its own."""
    base = pairs.withColumn("base_id", F.col("cand_id")).withColumn("is_clone", F.lit(False))
    clones = base.where(F.col("decoy") & (share_hash(F.col("cand_id"), seed) < q))
    kind = pairs.schema["cand_id"].dataType.simpleString()
    fake = F.concat(F.col("cand_id").cast("string"), F.lit("~c")) if kind == "string" else -F.col("cand_id") - 1
    return base.unionByName(clones.withColumn("cand_id", fake).withColumn("is_clone", F.lit(True)))


def decoy_weight(q: Column) -> Column:
    return F.when(F.col("decoy") & (F.col("y") == 0), 1 + q).otherwise(1.0)


def fit_gbt(df: DataFrame, features: list[str], rounds: int = 20, depth: int = 5, weight: str | None = None):
    """A boosted-tree pair model over an explicit feature list."""
    made = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)
    gbt = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=rounds, maxDepth=depth, seed=1)
    return (gbt.setWeightCol(weight) if weight else gbt).fit(made)


def predict(model, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    made = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)
    out = model.transform(made).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def calibrate(df: DataFrame, p: str, weight: str | None = None):
    iso = IsotonicRegression(featuresCol=p, labelCol="y")
    return (iso.setWeightCol(weight) if weight else iso).fit(df)


def calibrated(model, df: DataFrame, p: str, low: float = 1e-4) -> DataFrame:
    out = model.transform(df.drop(p + "_raw").withColumn(p + "_raw", F.col(p)))
    return out.withColumn(p, F.greatest(F.least(F.col("prediction"), F.lit(1 - low)), F.lit(low))).drop("prediction", p + "_raw")


def out_of_fold(df: DataFrame, features: list[str], key: str, k: int = 3, **kw) -> DataFrame:
    """Predictions p, each from a model that saw no row of its key's fold."""
    folded = df.withColumn("_fold", fold(F.col(key), k))
    parts = [predict(fit_gbt(folded.where(F.col("_fold") != i), features, **kw), folded.where(F.col("_fold") == i), features) for i in range(k)]
    return reduce(DataFrame.unionByName, parts).drop("_fold")


def add_labels(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    return pairs.join(gold.withColumn("y", F.lit(1)), ["s1_id", "cand_id"], "left").na.fill(0, ["y"])


def auc_log_loss(df: DataFrame, p: str = "p", y: str = "y", steps: int = 4096) -> DataFrame:
    """One row: auc (ties count half) and log-loss of p in [0, 1].  Both come
    from counts per score, summed within steps of the score and over the steps."""
    per = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg")).withColumn("step", F.floor(F.col("p") * steps))
    before = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.groupBy("step").agg(F.sum("neg").alias("neg")).withColumn("base", before(Window.orderBy("step"))).drop("neg")
    q = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    below = F.col("base") + before(Window.partitionBy("step").orderBy("p"))
    out = per.join(base, "step").select(
        "pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("won"), (-(F.col("pos") * F.log(q) + F.col("neg") * F.log(1 - q))).alias("loss")
    )
    return out.agg((F.sum("won") / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"), (F.sum("loss") / F.sum(F.col("pos") + F.col("neg"))).alias("log_loss"))


def without_owners(pairs: DataFrame, share: float = 0.19, seed: int = 3) -> DataFrame:
    """pairs without a share of the references, chosen by their ids."""
    return pairs.where(share_hash(F.col("s1_id"), seed) >= share)


def jittered(df: DataFrame, features: list[str], share: float = 0.01, seed: int = 4) -> DataFrame:
    """Features with normal noise of that share of their standard deviation."""
    sd = df.agg(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_sd_{c}") for c in features])
    noisy = {c: F.col(c) + F.randn(seed + i) * share * F.col(f"_sd_{c}") for i, c in enumerate(features)}
    return df.crossJoin(F.broadcast(sd)).withColumns(noisy).select(*df.columns)


def leave_one_out(df: DataFrame, features: list[str], by: str, values: list, **kw) -> DataFrame:
    """Predictions for each group from a model of all others (few groups)."""
    return reduce(DataFrame.unionByName, [predict(fit_gbt(df.where(F.col(by) != v), features, **kw), df.where(F.col(by) == v), features) for v in values])


def cross_calibrated(df: DataFrame, p: str, key: str, k: int = 2) -> DataFrame:
    """p of each fold calibrated on the other folds."""
    folded = df.withColumn("_fold", fold(F.col(key), k, 2))
    parts = [calibrated(calibrate(folded.where(F.col("_fold") != i), p), folded.where(F.col("_fold") == i), p) for i in range(k)]
    return reduce(DataFrame.unionByName, parts).drop("_fold")


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by gain, greatest first."""
    return sorted(zip(features, map(float, model.featureImportances), strict=True), key=lambda x: (-x[1], x[0]))


def feature_columns(df: DataFrame, not_features: set[str]) -> list[str]:
    return [c for c in df.columns if c not in not_features]


def sample_exactly(df: DataFrame, c: str, n: int, seed: int = 2) -> DataFrame:
    """n rows without replacement, by a hash of c (ties by c): the same rows
    whatever the partitioning.  n is the feature; a share is share_hash() < x."""
    return df.orderBy(F.xxhash64(c, F.lit(seed)), c).limit(n)


def inner_holdout(c: Column, parts: int = 10, seed: int = 6) -> Column:
    """Whether an id belongs to the inner hold-out, one id in parts."""
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(parts)) == 0


def populations(references: DataFrame, ranker: DataFrame, audit: int, validation: float = 0.25 / 0.7, pool_all: bool = False) -> DataFrame:
    """references (s1_id) with population: ranker (given), validation (a share of
    the rest), audit (so many of what is left) or pool.  pool_all: all but the
    audit rows are pool, for shortlists that no model cut by its own labels."""
    rest = references.join(ranker.select("s1_id"), "s1_id", "left_anti")
    chosen = sample_exactly(rest.where(share_hash(F.col("s1_id"), 12) >= validation), "s1_id", audit).select("s1_id", F.lit("audit").alias("_a"))
    first = ranker.select("s1_id").distinct().withColumn("_r", F.lit("ranker"))
    held = F.when(share_hash(F.col("s1_id"), 12) < validation, "validation").otherwise("pool")
    kind = F.coalesce("_a", F.lit("pool")) if pool_all else F.coalesce("_a", "_r", held)
    return references.join(chosen, "s1_id", "left").join(first, "s1_id", "left").withColumn("population", kind).drop("_a", "_r")


def recap(pairs: DataFrame, n_s1: int = 20, n_cand: int = 1) -> DataFrame:
    """Pairs among the n_s1 best rank scores of their reference, or the n_cand
    best (above zero) of their record, or found by the exact-key view."""
    a, b = Window.partitionBy("s1_id").orderBy(F.desc("rk"), "cand_id"), Window.partitionBy("cand_id").orderBy(F.desc("rk"), "s1_id")
    ranked = pairs.withColumns({"_x": F.row_number().over(a), "_y": F.row_number().over(b)})
    return ranked.where((F.col("_x") <= n_s1) | ((F.col("_y") <= n_cand) & (F.col("rk") > 0)) | (F.col("v_key") == 1)).drop("_x", "_y")


def denser(pairs: DataFrame, ratio: DataFrame, context, n_s1: int = 20, n_cand: int = 1, seed: int = 5) -> DataFrame:
    """A validation frame of the test's density: unowned records cloned with the
    chance q of their country (ratio: ctry, q), lists cut again, context worked
    out anew by context(frame)."""
    q = pairs.join(F.broadcast(ratio) if ratio.limit(1001).count() <= 1000 else ratio, "ctry", "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    return context(recap(add_clones(q, F.col("q"), seed).drop("q"), n_s1, n_cand))


def cap_by_model(pairs: DataFrame, model, features: list[str], n_s1: int, n_cand: int) -> DataFrame:
    """pairs with the model's rank score rk, cut to the best of either side."""
    from .blocking import either_top

    return either_top(predict(model, pairs, features, "rk"), "rk", n_s1, n_cand)


class Folds:
    """A stage of one model and one isotonic calibration for each fold of a key.
    A row of the training keys is answered by the model that did not see its
    fold; any other row by the mean over all folds."""

    def __init__(self, df: DataFrame, features: list[str], key: str, k: int = 3, weight: str | None = None, seed: int = 1, **kw):
        self.features, self.key, self.k, self.seed, self.parts = features, key, k, seed, []
        for i in range(k):
            mine = fold(F.col(key), k, seed) == i
            model = fit_gbt(df.where(~mine), features, weight=weight, **kw)
            iso = calibrate(predict(model, df.where(mine), features), "p", weight)
            self.parts.append((model, iso))

    def answer(self, df: DataFrame, i: int) -> DataFrame:
        model, iso = self.parts[i]
        return calibrated(iso, predict(model, df, self.features), "p")

    def own(self, df: DataFrame) -> DataFrame:
        """p of training rows, each from the model of its own fold."""
        return reduce(DataFrame.unionByName, [self.answer(df.where(fold(F.col(self.key), self.k, self.seed) == i), i) for i in range(self.k)])

    def mean(self, df: DataFrame) -> DataFrame:
        """p of other rows: the mean of the calibrated answers of all folds."""
        out = df
        for i in range(self.k):
            out = self.answer(out, i).withColumnRenamed("p", f"_p{i}")
        return out.withColumn("p", sum(F.col(f"_p{i}") for i in range(self.k)) / self.k).drop(*[f"_p{i}" for i in range(self.k)])


def with_external_scores(pairs: DataFrame, scores: DataFrame, key: str = "base_id", name: str = "ce") -> DataFrame:
    """pairs with a further scorer's value; null where it gave none (the trees
    read that as missing)."""
    return pairs.join(scores.select("s1_id", key, name), ["s1_id", key], "left")


def enriched(pairs: DataFrame, gold: DataFrame, owned: DataFrame, weights: DataFrame, k: int = 3) -> DataFrame:
    """pairs (s1_id, cand_id, ctry) with base_id, y, decoy (its record has no
    owner), wq (1 + the country's q, the mean q where there is none) and fold."""
    base = pairs.withColumn("base_id", F.regexp_replace(F.col("cand_id").cast("string"), "~c$", "").cast(pairs.schema["cand_id"].dataType))
    y = gold.select("s1_id", F.col("cand_id").alias("base_id")).distinct().withColumn("y", F.lit(1))
    has = owned.select(F.col("cand_id").alias("base_id")).distinct().withColumn("_o", F.lit(True))
    mean = weights.agg(F.coalesce(F.avg("q"), F.lit(0.0)).alias("_q"))  # one row
    out = base.join(y, ["s1_id", "base_id"], "left").na.fill(0, ["y"]).join(has, "base_id", "left").join(weights.select("ctry", "q"), "ctry", "left").crossJoin(F.broadcast(mean))
    out = out.withColumns({"decoy": F.col("_o").isNull(), "wq": 1 + F.coalesce("q", "_q"), "fold": fold(F.col("s1_id"), k)}).drop("_o", "q", "_q")
    return out.withColumn("w", decoy_weight(F.col("wq") - 1))
