"""Quality rules with risk-controlled cutoffs.

Every rule is a statistic of the whole text and a direction.  Its cutoff is
chosen per stratum from labelled holdout rows so that, with confidence
1 - delta over all strata and rules together, at most a share alpha of good
documents is rejected:

* candidate cutoffs form a fixed ladder, from the most lenient to the strictest;
* a cutoff is certified if the exact binomial test refutes "the false rejection
  rate is above alpha / rules": P(Bin(n, alpha / rules) <= k) <= delta / tests,
  k of n good labelled documents being rejected (the Clopper-Pearson bound);
* fixed-sequence testing walks the ladder and stops at the first failure, so a
  ladder costs one test; Bonferroni divides delta by strata x rules;
* a certified cutoff is used only as far as it still rejects further documents
  labelled bad.  A stratum without enough labels gets no cutoff and keeps all.

Cases: a null text has no words (and fails the base rule); a null stratum is a
stratum of its own; repeated rows are judged each, but a labelled text is one
trial however often it is there; labels whose
document does not exist, and null labels, are unused; empty tables give empty
results; other columns are carried along untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, small

SYMBOLS = b"#*$%&|<>"
SPACES = (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: (rule, SQL of the statistic, ladder from lenient to strict); rejected if the
#: statistic is above the cutoff.  Ladders are fixed, they do not depend on data.
RULES = (
    ("symbols", "n_symbols / greatest(n_words, 1L)", tuple(round(1.0 * 0.85**i, 6) for i in range(24))),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1L)", tuple(round(0.95 - 0.03 * i, 6) for i in range(30))),
    ("repeats", "n_repeat_words / greatest(n_words, 1L)", tuple(round(0.50 - 0.02 * i, 6) for i in range(24))),
    ("long_words", "word_chars / greatest(n_words, 1L)", tuple(round(40 * 0.92**i, 6) for i in range(24))),
    ("short_words", "-word_chars / greatest(n_words, 1L)", tuple(round(-1.0 - 0.1 * i, 6) for i in range(30))),
)


def text_stats(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """The STATS of one whole text."""
    w = raw.split()
    chars = len(raw.decode("utf-8", "replace")) - sum(raw.count(c) for c in SPACES)
    symbols = sum(raw.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if len(w) > 3:
        tri = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(tri)) < len(tri):
            often, end = Counter(tri), 0
            for i, t in enumerate(tri):
                if often[t] > 1:
                    repeat += i + 3 - max(i, end)
                    end = i + 3
    return len(w), chars, symbols, len(lines) - len(set(lines)), repeat, len(lines)


def add_stats(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs as _d0, _d1, ... and STATS as _s_...: whatever
    docs calls its columns, none meets a name used here."""
    from pyspark.sql.types import LongType, StructField, StructType

    def work(texts, *cols):
        return [*cols, *zip(*map(text_stats, texts), strict=True)] if texts else [*cols, *[[]] * len(STATS)]

    schema = StructType([StructField(f"_d{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + [StructField(f"_s_{c}", LongType()) for c in STATS])
    return map_texts(docs, keep, schema, work, text)


def base_failed() -> F.Column:
    return (F.col("_s_n_words") < 50) | (100 * F.col("_s_n_repeat_words") > 50 * F.col("_s_n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact up to rounding."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1, dtype=float)
    lg = np.vectorize(math.lgamma)
    logs = math.lgamma(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def walk(good: list[int], bad: list[int], n: int, rate: float, level: float) -> int:
    """Index of the cutoff to use on a ladder, or -1.  good[i], bad[i]: labelled
    rows that cutoff i rejects."""
    best, caught = -1, 0
    for i, (k, b) in enumerate(zip(good, bad, strict=True)):
        if not n or k > n * rate or binomial_cdf(k, n, rate) > level:
            break
        if b > caught:
            best, caught = i, b
    return best


def choose_cutoffs(stats: DataFrame, labels: DataFrame, id_col: str, stratum: str, alpha: float, delta: float) -> DataFrame:
    """(_stratum, one column _c_<rule> for each rule): null where no cutoff is
    certified.  Only counts by stratum, rule and ladder step are gathered."""
    known = labels.where("quality is not null").select(F.col("doc_id").alias("_l_id"), (F.col("quality") == 1).alias("_good"))
    # a labelled text that is there several times is one trial
    rows = stats.join(known, F.col(id_col) == F.col("_l_id")).where(~base_failed()).select(id_col, stratum, "_good", *[f"_s_{c}" for c in STATS]).distinct()
    steps = []
    for i, (_, sql, ladder) in enumerate(RULES):
        expr = re.sub(r"\b(" + "|".join(STATS) + r")\b", r"_s_\1", sql)
        # cutoffs of the ladder that reject the row: a prefix from its strict end
        hit = F.expr(f"aggregate(array({','.join(f'{c}D' for c in ladder)}), 0, (n, c) -> n + if(({expr}) > c, 1, 0))")
        steps.append(F.struct(F.lit(i).alias("rule"), hit.alias("hit")))
    counts = (
        rows.select(F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("\0")).alias("_stratum"), "_good", F.explode(F.array(*steps)).alias("s"))
        .groupBy("_stratum", "s.rule", "s.hit")
        .agg(F.sum(F.col("_good").cast("long")).alias("good"), F.sum((~F.col("_good")).cast("long")).alias("bad"))
    )
    tests = counts.select("_stratum").distinct().agg((F.count("*") * len(RULES)).alias("_tests"))
    names = [r[0] for r in RULES]

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"_stratum": [key[0]]}
        for i, (name, _, ladder) in enumerate(RULES):
            own = pdf[pdf.rule == i]
            # a row with hit h is rejected by the last h cutoffs of the ladder
            good = [int(own.good[own.hit >= len(ladder) - j].sum()) for j in range(len(ladder))]
            bad = [int(own.bad[own.hit >= len(ladder) - j].sum()) for j in range(len(ladder))]
            at = walk(good, bad, int(own.good.sum()), alpha / len(RULES), delta / int(pdf._tests.iloc[0]))
            out[f"_c_{name}"] = [ladder[at] if at >= 0 else None]
        return pd.DataFrame(out).astype({f"_c_{n}": float for n in names})

    schema = "_stratum string, " + ", ".join(f"_c_{n} double" for n in names)
    # rows of a group: rules x ladder steps, whatever the size of the stratum
    return counts.crossJoin(F.broadcast(tests)).groupBy("_stratum").applyInPandas(decide, schema)


def verdict(stats: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """stats with base_failed and kept."""
    keyed = stats.withColumn("_stratum", F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("\0")))
    out = keyed.join(small(cutoffs, 50_000), "_stratum", "left")
    good = F.lit(True)
    for name, sql, _ in RULES:
        expr = F.expr(re.sub(r"\b(" + "|".join(STATS) + r")\b", r"_s_\1", sql))
        good &= F.coalesce(expr <= F.col(f"_c_{name}"), F.lit(True))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & good)


def quality_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, text: str = "text") -> DataFrame:
    """One row per document: id, statistics, base_failed and kept."""
    stats = materialize(add_stats(docs, [id_col, stratum], text), "stats")
    cutoffs = materialize(choose_cutoffs(stats, labels, "_d0", "_d1", alpha, delta), "cutoffs")
    return verdict(stats, cutoffs, "_d1").select(
        F.col("_d0").alias(id_col), *[F.col(f"_s_{c}").alias(c) for c in STATS[:5]], "base_failed", "kept"
    )


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns.  Cutoffs come from a
    first pass that keeps numbers only; texts pass a second time and are never
    shuffled."""
    cutoffs = materialize(choose_cutoffs(add_stats(docs, [id_col, stratum], text), labels, "_d0", "_d1", alpha, delta), "cutoffs")
    stats = add_stats(docs, docs.columns, text)
    kept = verdict(stats, cutoffs, f"_d{docs.columns.index(stratum)}").where("kept")
    return kept.select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(docs.columns)])
