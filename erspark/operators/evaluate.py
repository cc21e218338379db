"""Scores of match sets, breakdowns, and checks of outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..sources import id_list


def f_beta(found: Column, true: Column, beta: float = 0.5) -> Column:
    """F of two sets: 1 if both are empty, 0 if one is or nothing is shared."""
    tp, b2 = F.size(F.array_intersect(found, true)), beta * beta
    score = (1 + b2) * tp / (b2 * F.size(true) + F.size(found))
    return F.when((F.size(found) == 0) & (F.size(true) == 0), 1.0).when(tp == 0, 0.0).otherwise(score)


def scored(found: DataFrame, true: DataFrame) -> DataFrame:
    """(s1_id, ids, true_ids, f) for every row of true."""
    t = true.withColumnRenamed("ids", "true_ids")
    out = t.join(found, "s1_id", "left")
    return out.withColumn("ids", F.coalesce("ids", F.array_except("true_ids", "true_ids"))).withColumn("f", f_beta(F.col("ids"), F.col("true_ids")))


def breakdown(rows: DataFrame, by: str = "ctry") -> DataFrame:
    """By group and kind: n, mean F, points lost and their share of all lost."""
    kind = F.when(F.size("true_ids") == 0, "singleton").otherwise("matched")
    per = rows.groupBy(by, kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("f").alias("mean_f"), F.sum(1 - F.col("f")).alias("lost"))
    all_lost = rows.agg(F.sum(1 - F.col("f")).alias("_all"))
    return per.crossJoin(F.broadcast(all_lost)).withColumn("share", F.when(F.col("_all") > 0, F.col("lost") / F.col("_all")).otherwise(0.0)).drop("_all")


def check_lists(lines: DataFrame, owners: DataFrame, known: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(rule, severity, offender) of an id-list output.  lines: value, one text
    line of the file each, header first removed; owners: s1_id; known: id;
    candidates: s1_id, id."""
    cut = lines.select("value", F.split("value", "\t", -1).alias("f"))
    bad = cut.where(F.size("f") != 2).select(F.lit("malformed").alias("rule"), F.lit("error").alias("severity"), F.col("value").alias("offender"))
    rows = cut.where(F.size("f") == 2).select(F.trim(F.get("f", F.lit(0))).alias("s1_id"), id_list(F.get("f", F.lit(1))).alias("ids"))
    say = lambda df, rule, severity, who: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(who).cast("string").alias("offender"))
    ids = rows.select("s1_id", F.explode("ids").alias("id"))
    per = rows.groupBy("s1_id").agg(F.count("*").alias("n"))
    found = [
        bad,
        say(per.where("n > 1"), "duplicate row", "error", "s1_id"),
        say(owners.join(rows, "s1_id", "left_anti"), "missing", "error", "s1_id"),
        say(per.join(owners, "s1_id", "left_anti"), "extra", "error", "s1_id"),
        say(ids.groupBy("s1_id", "id").agg(F.count("*").alias("n")).where("n > 1"), "repeated id", "error", "id"),
        say(ids.where(F.col("id").startswith("S1-")), "reference id", "error", "id"),
        say(ids.where(~F.col("id").rlike("^S[123]-")), "unknown prefix", "error", "id"),
        say(ids.where(F.col("id").rlike("^S[23]-")).join(known, "id", "left_anti"), "unknown id", "error", "id"),
    ]
    if candidates is not None:
        found.append(say(ids.join(candidates, ["s1_id", "id"], "left_anti"), "not a candidate", "warning", "id"))
    return reduce(DataFrame.unionByName, found).distinct()


def ceiling(reachable: Column, true: Column, beta: float = 0.5) -> Column:
    """F of a perfect decision over a shortlist: reachable of true matches."""
    b2 = beta * beta
    return F.when(true == 0, 1.0).when(reachable == 0, 0.0).otherwise((1 + b2) * reachable / (reachable + b2 * true))


def uncertain(pairs: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """The pairs that a second scorer should see."""
    return pairs.where((F.col("p") > low) & (F.col("p") < high))


def error_tags(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(s1_id, id, tag) of every error.  rows: scored(); listed: s1_id, ids of
    the shortlist."""
    r = rows.join(listed.select("s1_id", F.col("ids").alias("_listed")), "s1_id", "left")
    fp = F.when(F.size("true_ids") == 0, "FP_singleton").otherwise("FP_matched")
    wrong = r.select("s1_id", F.explode(F.array_except("ids", "true_ids")).alias("id"), fp.alias("tag"))
    missed = r.select("s1_id", "_listed", F.explode(F.array_except("true_ids", "ids")).alias("id"))
    low = F.when(F.coalesce(F.array_contains("_listed", F.col("id")), F.lit(False)), "FN_low_p").otherwise("FN_not_blocked")
    return wrong.unionByName(missed.select("s1_id", "id", low.alias("tag")))


def attribution(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(kind, gain): what mean F would gain if one kind of error were mended
    alone."""
    r = rows.join(listed.select("s1_id", F.col("ids").alias("_listed")), "s1_id", "left").withColumn("_listed", F.coalesce("_listed", F.array_except("ids", "ids")))
    right, missed = F.array_intersect("ids", "true_ids"), F.array_except("true_ids", "ids")
    gain = lambda ids: f_beta(ids, F.col("true_ids")) - F.col("f")
    single = F.size("true_ids") == 0
    parts = {
        "singleton_FP": F.when(single, gain(right)).otherwise(0.0),
        "matched_FP": F.when(single, 0.0).otherwise(gain(right)),
        "FN_listed": gain(F.array_union("ids", F.array_intersect(missed, F.col("_listed")))),
        "FN_not_listed": gain(F.array_union("ids", F.array_except(missed, F.col("_listed")))),
    }
    one = r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("gain")) for k, v in parts.items()])).alias("x")).select("x.*")
    return one.groupBy("kind").agg(F.avg("gain").alias("gain"))


def checked_write(lists: DataFrame, path: str, owners: DataFrame, known: DataFrame) -> DataFrame:
    """Write (s1_id, ids text) as id-list lines, read them back, check them;
    raises if a rule of severity error is broken."""
    lists.select(F.concat_ws("\t", "s1_id", "ids").alias("value")).write.text(path)
    lines = lists.sparkSession.read.text(path)
    first = check_lists(lines, owners, known).where("severity = 'error'").limit(5).collect()
    if first:
        raise ValueError("output refused: " + "; ".join(f"{r.rule} {r.offender}" for r in first))
    return lines


def check_file(spark, path: str, header: tuple[str, str], owners: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """check_lists() of one written file, and what is wrong with the file itself:
    no lines, bytes that are not UTF-8, commas in place of tabs, another header.
    A file that cannot be read further gives that finding alone.  Blank lines are
    skipped; known None leaves out the look-up of ids."""
    lines = sources.text_lines(spark, path)
    say = lambda rule, who: spark.createDataFrame([(rule, "error", who)], "rule string, severity string, offender string")
    first = lines.where("line = 0").first()
    if first is None:
        return say("empty file", path)
    bad = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    if bad:
        return say("not utf-8", path)
    if "\t" not in first.value and "," in first.value:
        return say("comma-separated", first.value)
    if tuple(c.strip().lower() for c in first.value.split("\t")) != header:
        return say("header", first.value)
    body = lines.where("line > 0").where(F.trim("value") != "").select("value")
    every = check_lists(body, owners, known if known is not None else spark.createDataFrame([], "id string"), candidates)
    return every if known is not None else every.where("rule <> 'unknown id'")


def write_and_check(path: str, found: DataFrame, candidates: DataFrame, owners: DataFrame, known: DataFrame) -> DataFrame:
    """Write both outputs (found, candidates: s1_id, ids array), read them back and
    check them, and that no record has two owners.  Raises if an error is left;
    returns (file, n_rows, n_ids, n_empty, digest): digest does not depend on the
    order of lines."""
    spark, out, broken = found.sparkSession, [], []
    listed = candidates.select("s1_id", F.explode("ids").alias("id"))
    for name, column, lists, of in (("matching_results", "matched_entity_ids", found, listed), ("candidate_pairs", "candidate_entity_ids", candidates, None)):
        rows = owners.select("s1_id").join(lists, "s1_id", "left").select(F.concat_ws("\t", "s1_id", F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",")).alias("value"))
        file = f"{path}/{name}"
        sources.write_lines(f"source1_entity_id\t{column}", rows, file)
        broken += [f"{name}: {r.rule} {r.offender}" for r in check_file(spark, file, ("source1_entity_id", column), owners, known, of).limit(5).collect()]
        ids = id_list(F.get(F.split("value", "\t"), F.lit(1)))
        lines = sources.text_lines(spark, file).where("line > 0")
        out.append(lines.agg(F.lit(name).alias("file"), F.count("*").alias("n_rows"), F.sum(F.size(ids)).alias("n_ids"), F.sum((F.size(ids) == 0).cast("long")).alias("n_empty"), F.hex(F.bit_xor(F.xxhash64("value"))).alias("digest")))
    twice = found.select("s1_id", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    broken += [f"two owners {r.id}" for r in twice]
    if broken:
        raise ValueError("output refused: " + "; ".join(broken))
    return reduce(DataFrame.unionByName, out)


def quantile_bins(df: DataFrame, value: str, n: int, out: str = "bin") -> DataFrame:
    """df with the bin (0 to n - 1) of value's rank among all rows; ties share
    their middle rank.  Ranks come from counts per value."""
    from .ranking import counts_up_to

    per = counts_up_to(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), value)
    total = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("_all"))  # one row
    rank = per.select(value, ((F.col("_to") - (F.col("_n") - 1) / 2)).alias("_rank")).crossJoin(F.broadcast(total))
    bin_of = F.least(F.floor((F.col("_rank") - 1) * n / F.col("_all")), F.lit(n - 1)).cast("int")
    return df.join(rank.select(value, bin_of.alias(out)), value, "left")


def noise_census(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Matched pairs (l_..., r_...: prepare() fields): how their names and addresses
    differ, by group."""
    from ..functions import similarity as sim

    flag = lambda c: F.avg(c.cast("double"))
    exact, empty = F.col("l_name_n") == F.col("r_name_n"), F.col("r_addr") == ""
    apart = (F.size("l_nums") > 0) & (F.size("r_nums") > 0) & ~F.arrays_overlap("l_nums", "r_nums")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), flag(F.col("r_native") == 1).alias("native"), flag(F.col("r_web") != "").alias("web"), flag(exact).alias("name_exact"), flag(empty).alias("addr_empty"),
        flag(apart).alias("nums_disjoint"), F.avg(sim.token_set_ratio("l_name_n", "r_name_n")).alias("name_tset"), F.avg(sim.token_set_ratio("l_addr", "r_addr")).alias("addr_tset"),
    )


def prior_odds(df: DataFrame, by: str, before: Column, after: Column, most: float = 4.0) -> DataFrame:
    """(by, odds): the odds of after over those of before, within 1/most and most."""
    s = df.groupBy(F.col(by).alias("k")).agg(F.avg(before.cast("int")).alias("a"), F.avg(after.cast("int")).alias("b"))
    odds = lambda c: F.col(c) / (1 - F.col(c))
    return s.select("k", F.greatest(F.least(odds("b") / odds("a"), F.lit(most)), F.lit(1 / most)).alias("odds"))


def token_census(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """(tok, kind, n): words that matched names drop or add (token arrays)."""
    side = lambda u, v, k: pairs.select(F.explode(F.array_except(u, v)).alias("tok"), F.lit(k).alias("kind"))
    return side(ours, theirs, "dropped").unionByName(side(theirs, ours, "added")).groupBy("tok", "kind").agg(F.count("*").alias("n"))


def shortlist_misses(pairs: DataFrame, gold: DataFrame, owners: DataFrame) -> DataFrame:
    """(ctry, p_outside): the share of references with a match that the shortlist
    misses; decode() takes it for each entity."""
    g = gold.select("s1_id", "cand_id").distinct().join(pairs.select("s1_id", "cand_id").distinct().withColumn("_in", F.lit(0)), ["s1_id", "cand_id"], "left")
    per = g.groupBy("s1_id").agg(F.max(F.coalesce("_in", F.lit(1))).alias("miss"))
    return per.join(owners.select("s1_id", "ctry"), "s1_id").groupBy("ctry").agg(F.avg("miss").alias("p_outside"))


def risk_monitor(pairs: DataFrame, owners: DataFrame, sure: float, low: float, high: float) -> DataFrame:
    """(ctry, same_per_s1, twins_per_s1): confident pairs whose rank score is poor,
    and doubtful ones whose rank score is good, per reference of the country."""
    n = owners.groupBy("ctry").agg(F.count("*").alias("n"))
    count = lambda c: F.sum(c.cast("int")) / F.first("n")
    yes = F.col("p") >= sure
    return pairs.join(owners, "s1_id").join(n, "ctry").groupBy("ctry").agg(count(yes & (F.col("rk") < low)).alias("same_per_s1"), count(~yes & (F.col("rk") >= high)).alias("twins_per_s1"))
