"""What near-duplicates shuffle, and components on both ways."""

import random

import pytest
from pyspark.sql import functions as F

from erspark.llm import common, simhash


def test_only_wanted_rows_leave_the_scan(spark, tmp_path):
    """A choice of few long rows by their hashes must not shuffle all of them."""
    spark.range(3000).select(F.xxhash64("id").alias("t"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text")).write.parquet(str(tmp_path / "x"))
    rows = spark.read.parquet(str(tmp_path / "x"))
    keys = spark.range(0, 3000, 100).select(F.xxhash64("id").alias("k"))
    assert common.those_among(rows, "t", keys).select("t").distinct().count() == 30
    left = common.those_among(rows, "t", keys)
    # the map alone, before the join that makes it exact
    passed = left._jdf.queryExecution().analyzed().children().apply(0)
    assert "MapInArrow" in passed.toString()
    assert common.those_among(rows, "t", keys.limit(0)).count() == 0


def test_choice_of_rows_takes_one_shuffle_of_texts(spark, docs):
    """Both the choice of a group's row and of repeated rows go by one key."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = simhash.drop_similar(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(_row" in x]
    assert len(shuffles) == 2  # the texts, and the rows to keep


@pytest.mark.parametrize("small", [0, 100_000])
def test_components_on_the_driver_equal_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_EDGES", small)
    rng = random.Random(3)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(i + 1000, i + 1001) for i in range(40)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in root}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm_shards_leave_the_executors(spark, docs, monkeypatch):
    """What was broadcast is gone when the scores are there, batches are bounded."""
    from erspark.llm import bloom_lm

    sent, rows = [], []
    real, write = bloom_lm.broadcasts, bloom_lm.materialize
    monkeypatch.setattr(bloom_lm, "broadcasts", lambda *a: sent.append(real(*a)) or sent[-1])
    monkeypatch.setattr(bloom_lm, "materialize", lambda df, name="t", batch_rows=None: rows.append((name, batch_rows)) or write(df, name, batch_rows))
    before = spark.conf.get(common.BATCH)
    out = bloom_lm.score(docs)
    assert out.count() == docs.count()
    assert sent and all(bc._jbroadcast is None or not bc._jbroadcast.isValid() for group in sent for _, bc in group)
    assert dict(rows)["counts"] == dict(rows)["scores"] == common.BATCH_ROWS and spark.conf.get(common.BATCH) == before
