"""From calibrated probabilities to one match set per entity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocking import top_rows
from .ranking import one_owner


def another(dist: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distributions of a number of successes (one a row) after one more trial."""
    out = np.zeros((dist.shape[0], dist.shape[1] + 1))
    out[:, :-1] = dist * (1 - p)[:, None]
    out[:, 1:] += dist * p[:, None]
    return out


def expected_f_rows(p: np.ndarray, outside: float = 0.0, beta: float = 0.5) -> np.ndarray:
    """Expected F of taking the first k of each row of p (descending), k = 0..n.
    outside: chance that one further true match is not listed."""
    (m, n), b2 = p.shape, beta * beta
    hits = [np.ones((m, 1))]  # among the first k
    misses = [another(np.ones((m, 1)), np.full(m, outside))]  # among the rest, from the end
    for k in range(n):
        hits.append(another(hits[-1], p[:, k]))
        misses.append(another(misses[-1], p[:, n - 1 - k]))
    misses.reverse()
    out = np.zeros((m, n + 1))
    out[:, 0] = misses[0][:, 0]
    for k in range(1, n + 1):
        tp, fn = np.arange(k + 1)[:, None], np.arange(n - k + 2)[None, :]
        gain = np.where(tp > 0, (1 + b2) * tp / ((1 + b2) * tp + b2 * fn + (k - tp)), 0.0)
        out[:, k] = ((hits[k] @ gain) * misses[k]).sum(axis=1)
    return out


def expected_f(p: list[float], outside: float = 0.0, beta: float = 0.5) -> np.ndarray:
    return expected_f_rows(np.asarray(p, float).reshape(1, -1), outside, beta)[0]


def best_sizes(lists: pd.Series, outside: float) -> pd.Series:
    """For each list of descending probabilities the k of the greatest expected
    F, the smallest of ties.  Lists of one length are worked out together."""
    lengths, out = lists.map(len).to_numpy(), np.zeros(len(lists), np.int32)
    for n in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == n)
        f = expected_f_rows(np.stack(lists.iloc[own].to_list()).astype(float), outside)
        out[own] = np.argmax(np.round(f, 12), axis=1)
    return pd.Series(out)


def decode(pairs: DataFrame, s1: DataFrame, min_p: float = 1e-3, most: int = 25, outside: float = 0.0, tie: str | None = "rk", slack: float = 0.0) -> DataFrame:
    """(s1_id, ids): the set that maximises expected F0.5, for every s1 row.
    most bounds a group; ties of the maximum take the smaller set."""
    owned = one_owner(pairs, "p", tie, slack).where(F.col("p") >= min_p)
    listed = top_rows(owned, "s1_id", "p", most, "cand_id").select("s1_id", "cand_id", "p")
    kind = pairs.schema["cand_id"].dataType.simpleString()

    size = F.pandas_udf(lambda ps: best_sizes(ps, outside), "int")
    # at most `most` rows a group, best first
    first = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), F.col("cand_id").alias("id"))))
    ranked = listed.groupBy("s1_id").agg(first.alias("x")).withColumn("k", size(F.transform("x", lambda r: -r.o)))
    sets = ranked.select("s1_id", F.array_sort(F.transform(F.expr("slice(x, 1, k)"), lambda r: r.id)).alias("ids"))
    return s1.select("s1_id").distinct().join(sets, "s1_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast(f"array<{kind}>")))


def threshold_decode(pairs: DataFrame, s1: DataFrame, cut: float) -> DataFrame:
    sets = pairs.where(F.col("p") >= cut).groupBy("s1_id").agg(F.array_sort(F.collect_set("cand_id")).alias("ids"))
    return s1.select("s1_id").distinct().join(sets, "s1_id", "left").withColumn("ids", F.coalesce("ids", F.expr(f"cast(array() as {sets.schema['ids'].dataType.simpleString()})")))
