"""Candidate generation: exact keys and TF-IDF top-k joins with bounded cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limited_keys(df: DataFrame, keys: list[str], most: int = 30) -> DataFrame:
    """Rows whose key is non-empty and shared by at most so many rows."""
    filled = df.where(" and ".join(f"`{k}` <> ''" for k in keys))
    sizes = filled.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).drop("_n")
    return filled.join(sizes, keys)


def spread_join(a: DataFrame, b: DataFrame, keys: list[str], rows_a: Column | None = None, rows_b: Column | None = None, most: int = 1 << 21) -> DataFrame:
    """Inner join on keys whose pairs are many: a key of more than so many pairs
    is dealt over several tasks, a's rows by hash, b's to each.  rows_a, rows_b:
    for how many rows a row stands (1)."""
    one = F.lit(1)
    size = lambda df, rows, n: df.groupBy(*keys).agg(F.sum(one if rows is None else rows).alias(n))
    parts = F.least(F.ceil(F.col("_m") * F.col("_n") / most), F.lit(1 << 16)).cast("int")
    hot = size(a, rows_a, "_m").join(size(b, rows_b, "_n"), keys).select(*keys, parts.alias("_parts")).where("_parts > 1")
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by number: pairs are many where rows are few, which the planner would gather in one task
    x = a.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*a.columns), F.coalesce("_parts", one)).cast("int")).drop("_parts").repartition(tasks, *keys, "_part")
    y = b.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", one) - 1))).drop("_parts").repartition(tasks, *keys, "_part")
    return x.join(y, [*keys, "_part"]).drop("_part")


def key_pairs(s1: DataFrame, cands: DataFrame, keys: list[str], most: int = 30) -> DataFrame:
    """Exact-key view: distinct (s1_id, cand_id)."""
    return limited_keys(s1, keys, most).join(cands, keys).select("s1_id", "cand_id").distinct()


def with_flag(pairs: DataFrame, more: DataFrame, flag: str, zero: list[str]) -> DataFrame:
    """Full outer join of pairs with more; flag marks more's, absent scores are 0."""
    return pairs.join(more.withColumn(flag, F.lit(1.0)), ["s1_id", "cand_id"], "full").na.fill(0.0, [*zero, flag])


def align_views(views: dict[str, DataFrame]) -> DataFrame:
    """One row per pair, one score column per view (0 where absent): a union and
    one aggregation in place of a chain of full outer joins."""
    long = None
    for name, df in views.items():
        one = df.select("s1_id", "cand_id", F.lit(name).alias("v"), F.col("score").cast("double").alias("score"))
        long = one if long is None else long.unionByName(one)
    return long.groupBy("s1_id", "cand_id").agg(*[F.coalesce(F.max(F.when(F.col("v") == n, F.col("score"))), F.lit(0.0)).alias(f"v_{n}") for n in views])


def token_counts(df: DataFrame, id_col: str, tokens: Column, group: str = "ctry") -> DataFrame:
    return df.select(F.col(id_col).alias("id"), group, F.explode(tokens).alias("tok")).groupBy("id", group, "tok").agg(F.count("*").alias("tf"))


def token_stats(a: DataFrame, b: DataFrame, group: str = "ctry") -> DataFrame:
    """(group, tok, df_a, df_b, idf, cost) fitted on both sides."""
    side = lambda d, n: d.groupBy(group, "tok").agg(F.count("*").alias(n))
    both = a.select("id", group).unionByName(b.select("id", group))
    sizes = both.distinct().groupBy(group).agg(F.count("*").alias("n"))
    out = side(a, "df_a").join(side(b, "df_b"), [group, "tok"], "full").na.fill(0, ["df_a", "df_b"]).join(F.broadcast(sizes), group)
    idf = F.ln((1 + F.col("n")) / (1 + F.col("df_a") + F.col("df_b"))) + 1
    return out.select(group, "tok", "df_a", "df_b", idf.alias("idf"), (F.col("df_a") * F.col("df_b")).alias("cost"))


def affordable(stats: DataFrame, budget: float, group: str = "ctry", ladder: float = 1.25) -> DataFrame:
    """Tokens whose join fits the budget: the costliest go first.  Costs are
    binned on a ladder and bins are dropped whole, so planning reads a histogram
    of bounded size, whatever the vocabulary."""
    import math

    binned = stats.withColumn("_bin", F.floor(F.ln(F.greatest(F.col("cost"), F.lit(1))) / math.log(ladder)))
    sums = binned.groupBy(group, "_bin").agg(F.sum("cost").alias("_c"))
    below = Window.partitionBy(group).orderBy("_bin")
    fits = sums.withColumn("_s", F.sum("_c").over(below)).where(F.col("_s") <= budget).select(group, "_bin")
    return binned.join(F.broadcast(fits), [group, "_bin"]).drop("_bin")


def weights(counts: DataFrame, stats: DataFrame, group: str = "ctry") -> DataFrame:
    """(id, group, tok, w): (1 + ln tf) * idf, of length one per id."""
    raw = counts.join(stats.select(group, "tok", "idf"), [group, "tok"]).withColumn("_w", (1 + F.ln("tf")) * F.col("idf"))
    norm = Window.partitionBy("id")
    return raw.select("id", group, "tok", (F.col("_w") / F.sqrt(F.sum(F.col("_w") ** 2).over(norm))).alias("w"))


def cosine_pairs(wa: DataFrame, wb: DataFrame, group: str = "ctry", min_sim: float = 0.05) -> DataFrame:
    b = wb.withColumnsRenamed({"id": "cand_id", "w": "wb"})
    out = wa.withColumnsRenamed({"id": "s1_id"}).join(b, [group, "tok"]).groupBy("s1_id", "cand_id").agg(F.sum(F.col("w") * F.col("wb")).alias("score"))
    return out.where(F.col("score") >= min_sim)


def top_rows(df: DataFrame, by: str, score: str, k: int, *ties: str) -> DataFrame:
    """k best rows of each group; the limit reaches below the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *ties)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def either_top(df: DataFrame, score: str, n_s1: int, n_cand: int) -> DataFrame:
    """Rows among the n_s1 best of their s1_id or the n_cand best of their
    cand_id, as a union of two limited branches."""
    a = top_rows(df, "s1_id", score, n_s1, "cand_id")
    return a.unionByName(top_rows(df, "cand_id", score, n_cand, "s1_id")).distinct()


def tfidf_view(s1: DataFrame, cands: DataFrame, tokens_a: Column, tokens_b: Column, k_fwd: int, k_rev: int, budget: float = 5e6, min_sim: float = 0.05, keep=None) -> DataFrame:
    """(s1_id, cand_id, score) of one blocking view, both directions.  keep: as
    block() has it."""
    written, keep = keep is not None, keep or (lambda df: df)
    a, b = keep(token_counts(s1, "s1_id", tokens_a)), keep(token_counts(cands, "cand_id", tokens_b))
    stats = keep(affordable(keep(token_stats(a, b)), budget))
    pairs = cosine_pairs(weights(a, stats), weights(b, stats), min_sim=min_sim)
    if written:
        # sums depend on the order of written rows in their last digits, ties must not
        pairs = pairs.withColumn("score", F.round("score", 12))
    return either_top(pairs, "score", k_fwd, k_rev)


def blocking_report(pairs: DataFrame, gold: DataFrame, s1: DataFrame) -> DataFrame:
    """Distinct pairs, pair recall, share of s1 fully covered, candidates per s1."""
    p = pairs.select("s1_id", "cand_id").distinct()
    hit = gold.join(p.withColumn("_in", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    whole = hit.groupBy("s1_id").agg(F.min("_in").alias("all_in"), F.sum("_in").alias("n_in"), F.count("*").alias("n"))
    recall = whole.agg((F.sum("n_in") / F.sum("n")).alias("recall"), F.avg("all_in").alias("coverage"))
    size = p.agg(F.count("*").alias("n_pairs"))
    return recall.crossJoin(size).crossJoin(s1.select(F.countDistinct("s1_id").alias("n_s1"))).select("n_pairs", "recall", "coverage", (F.col("n_pairs") / F.col("n_s1")).alias("per_s1"))


#: View name to (columns whose words or 5-grams it compares, words or grams,
#: candidates for each record, references for each candidate).
VIEWS = {"word": (("name", "addr"), "words", 20, 10), "name5": (("name",), "grams", 10, 5), "addr5": (("addr",), "grams", 10, 5)}


def open_buckets(df: DataFrame, countries: DataFrame, unknown: str = "unk") -> DataFrame:
    """df with rows of unknown country in the bucket of every country (ctry is
    the bucket).  countries must be few: each unknown row is repeated for each."""
    few = countries.select("ctry").distinct()
    if few.limit(1001).count() > 1000:
        raise ValueError("more than 1000 countries: rows of unknown country would be repeated too often")
    known = df.where(F.col("ctry") != unknown)
    return known.unionByName(df.where(F.col("ctry") == unknown).drop("ctry").crossJoin(F.broadcast(few)).select(*df.columns))


def block(s1: DataFrame, cands: DataFrame, tokens: dict, views: dict = VIEWS, budget: float = 5e6, keep=None) -> DataFrame:
    """All views over all countries in one plan, aligned.  tokens: "words" and
    "grams" to a function from a text column to its tokens.  keep: writes a frame
    and reads it again; then every view's token counts, statistics and best pairs
    are planned and worked out on their own."""
    made = {}
    for name, (cols, kind, fwd, rev) in views.items():
        t = tokens[kind](F.concat_ws(" ", *cols))
        view = tfidf_view(s1, cands, t, t, fwd, rev, budget, keep=keep)
        made[name] = keep(view) if keep else view
    return align_views(made)


def token_products(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row per pair of a token of a and a token of b of a row; both lists
    are short (names)."""
    return df.withColumn("t", F.explode(a)).withColumn("u", F.explode(b)).drop(a, b)


def admin_vocabulary(parts: DataFrame, s1_parts: DataFrame, least_state: int = 20, least_other: int = 100) -> DataFrame:
    """(ctry, term, kind): what stands for areas in addresses.  parts: ctry,
    comps (array) of candidates; s1_parts: the same of references.  state:
    frequent reference components that mostly end the address; noise: frequent
    candidate words that no reference has; alias: frequent candidate components
    that no reference has."""
    size = lambda df: df.groupBy("ctry").agg(F.count("*").alias("rows"))
    comps = lambda df: df.select("ctry", F.posexplode("comps").alias("at", "term"), F.size("comps").alias("of"))
    words = lambda df: comps(df).select("ctry", F.explode(F.split("term", " ")).alias("term")).where("term <> ''")
    ours = comps(s1_parts).groupBy("ctry", "term").agg(F.count("*").alias("n"), F.sum((F.col("at") == F.col("of") - 1).cast("long")).alias("last"))
    state = ours.join(size(s1_parts), "ctry").where(f"n >= greatest({least_state}, 5e-4 * rows) and last >= 0.5 * n")
    noise = words(parts).groupBy("ctry", "term").agg(F.count("*").alias("n")).where(f"n >= {least_other} and not term rlike '^[0-9]+$'").join(words(s1_parts), ["ctry", "term"], "left_anti")
    alias = comps(parts).groupBy("ctry", "term").agg(F.count("*").alias("n")).join(size(parts), "ctry").where(f"n >= greatest({least_other}, 5e-4 * rows)")
    alias = alias.where(~F.col("term").rlike("[0-9]")).join(ours, ["ctry", "term"], "left_anti")
    kind = lambda df, k: df.select("ctry", "term", F.lit(k).alias("kind"))
    return kind(state, "state").unionByName(kind(noise, "noise")).unionByName(kind(alias, "alias"))


def shared_token_pairs(a: DataFrame, b: DataFrame, least_length: int, most: int) -> DataFrame:
    """Distinct (s1_id, cand_id) that share a token (a: s1_id, tokens; b: cand_id,
    tokens) longer than least_length and held by at most so many records."""
    x, y = a.select("s1_id", F.explode(F.array_distinct("tokens")).alias("tok")), b.select("cand_id", F.explode(F.array_distinct("tokens")).alias("tok"))
    long = F.length("tok") > least_length
    rare = x.select("tok").unionByName(y.select("tok")).where(long).groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("tok")
    return x.join(rare, "tok").join(y, "tok").select("s1_id", "cand_id").distinct()


def rarest_tokens(df: DataFrame, id_col: str, tokens: str, keep: int = 2, least_length: int = 3, most: int = 200) -> DataFrame:
    """(id, tok, df): each record's rarest tokens, of those that are long enough
    and not too common."""
    t = df.select(id_col, F.explode(F.array_distinct(tokens)).alias("tok")).where(F.length("tok") > least_length)
    counts = t.groupBy("tok").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    w = Window.partitionBy(id_col).orderBy("df", "tok")
    return t.join(counts, "tok").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select(id_col, "tok", "df")


def sibling_counts(df: DataFrame, group: str, item: str, sure: Column) -> DataFrame:
    """(group, item, siblings): how many other items of the group are sure; items
    without one are left out."""
    others = df.where(sure).select(group, F.col(item).alias("_other"))
    return df.select(group, item).join(others, group).where(F.col(item) != F.col("_other")).groupBy(group, item).agg(F.count("*").alias("siblings"))


def competitors(pairs: DataFrame, mine: DataFrame, owner: str, item: str) -> DataFrame:
    """Pairs of other owners on the items of mine."""
    return pairs.join(mine.select(item), item, "left_semi").join(mine.select(owner), owner, "left_anti")
