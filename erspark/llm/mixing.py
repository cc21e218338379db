"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets its j-th block (from 0) released at floor(j / w) and
due at ceil((j + 1) / w).  Earliest deadline first, one block a slot, keeps each
source less than one block from its share at every slot.  Weights are exact
fractions, and the blocks that the sources really have are scheduled: one heap
step a block on the driver, written in pieces.  A document finds its block from
its rank within its source.  Ranks come from counts by (source, bucket): no
source is gathered in a task, however hot it is.

A source that runs out leaves its later slots empty; the others go on in their
proportions and nothing is dropped or repeated.  position orders all rows.

Cases: a null source is a source of its own; a source without a given weight
gets the least given one; weights of zero or less are refused; repeated rows
are placed once each; null texts and ids are kept; other columns are kept; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, shared_dir

#: Sources that a mixture may name.
MAX_SOURCES = 100_000
#: Blocks of the schedule that the driver holds at a time; a shorter one is broadcast.
PIECE = 100_000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of a period, at least one each, by largest remainders."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above zero")
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (-(exact[s] - int(exact[s])), s))
    i = 0
    while sum(out.values()) < period:
        out[order[i % len(order)]] += 1
        i += 1
    while sum(out.values()) > period:
        s = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1e9, s))
        out[s] -= 1
    return out


def timetable(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """So many blocks of each source by earliest deadline first, from exact
    weights: (source, block, slot, release, deadline) in order of slots."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be above zero")
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in exact.values()])
    whole = {s: int(w * unit) for s, w in exact.items()}
    total = sum(whole.values())
    waiting = sorted((0, s, 0) for s, n in blocks.items() if n > 0)
    ready: list[tuple[int, int, str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // whole[s]), -whole[s], s, j))
        due, _, s, j = heapq.heappop(ready)
        yield s, j, slot, j * total // whole[s], due
        slot += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // whole[s], s, j + 1))


def schedule(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period of whole shares: (source, block, slot, release, deadline)."""
    return list(timetable(share, share))


def schedule_table(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int], names: str) -> DataFrame:
    """timetable() as a table with columns of these names and types."""
    rows = timetable(weights, blocks)
    first = list(islice(rows, PIECE))
    if len(first) < PIECE:
        return F.broadcast(spark.createDataFrame(first, names))
    path = f"{shared_dir(spark)}/erspark-timetable-{uuid.uuid4().hex}"
    while first:
        spark.createDataFrame(first, names).write.mode("append").parquet(path)
        first = list(islice(rows, PIECE))
    return spark.read.schema(names).parquet(path)


def default_weights(counts: dict[str, int]) -> dict[str, float]:
    """Square roots of the sizes: large sources lead, small ones are heard."""
    return {s: n**0.5 for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", id_col: str = "doc_id", block: int = 16, period: int = 1000, buckets: int = 1024, seed: int = 7) -> DataFrame:
    """docs with _mix: struct(block, release, deadline, slot, position), longs
    (the last column, named __mix if docs has a _mix of its own).
    period is kept for callers: weights are exact, so nothing depends on it."""
    spark = docs.sparkSession
    key, bucket, rank, at, slot, release, due, base = (fresh(docs, c) for c in ("_src", "_bucket", "_r", "_block", "_slot", "_release", "_due", "_base"))
    named = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("\0"))
    order = F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed))
    keyed = docs.withColumn(key, named).withColumn(bucket, F.pmod(order, F.lit(buckets)).cast("int"))
    sizes = materialize(keyed.groupBy(key, bucket).agg(F.count("*").alias("_n")), "mix")
    totals = sizes.groupBy(key).agg(F.sum("_n").alias("_n"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    counts = {r[0]: r[1] for r in found}
    if weights is None:
        given = default_weights(counts)
    else:
        given = {("\0" if s is None else str(s)): float(w) for s, w in weights.items()}
        given |= {s: min(given.values(), default=1.0) for s in counts if s not in given}
    table = schedule_table(spark, given, {s: -(-n // block) for s, n in counts.items()}, f"{key} string, {at} long, {slot} long, {release} long, {due} long")
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # rows of a group here: buckets
    bases = sizes.select(key, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(key, bucket).orderBy(order, F.col(f"`{id_col}`"))
    ranked = (
        keyed.withColumn(rank, F.row_number().over(within) - 1)
        .join(bases, [key, bucket])
        .withColumn(rank, F.col(rank) + F.col(base))
        .withColumn(at, F.floor(F.col(rank) / block))
    )
    out = ranked.join(table, [key, at])
    spot = F.struct(
        F.col(at).alias("block"), F.col(release).alias("release"), F.col(due).alias("deadline"), F.col(slot).alias("slot"),
        (F.col(slot) * block + F.pmod(F.col(rank), F.lit(block))).alias("position"),
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], spot.alias(fresh(docs, "_mix")))


def in_order(mixed: DataFrame, source_of: DataFrame) -> DataFrame:
    """The rows of mix() in their order, with the columns of source_of."""
    return mixed.orderBy(f"{mixed.columns[-1]}.position").select(*[F.col(f"`{c}`") for c in source_of.columns])
