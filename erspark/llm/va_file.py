"""Exact top-k by inner product with vector-approximation files.

Vectors are integers.  A vector's approximation is the cell of each component
(width 2**cell_bits, 16 bits a component as a rule); cells are written once.  A
query's inner product with any vector of a cell lies between bounds that the
cell's corner gives.

1. Cells meet queries in blocks, (vector group, query group) is a task; a task
   returns the vectors whose upper bound reaches its k-th best lower bound.
2. A query's floor is the k-th best lower bound of all groups.
3. Exact vectors are read in the order of their upper bounds: the first FIRST * k
   of each query, whose k-th score is the new floor, then just those whose bound
   still reaches it.  Then the k-th result is certain.

Only cells are replicated over query groups, and only queries over vector
groups; exact vectors move for survivors.  No query's candidates are gathered.

Cases: vectors that are null, empty, or hold null or non-finite components take
no part, nor do rows with a null id; only vectors of one length are compared;
rows of the query's own id are not its candidates; a repeated candidate row is
returned as often as it occurs; query rows of one id whose vectors round alike
are one query; ties go to the smaller id; empty tables give empty results; other
columns are ignored.  Scores are 64-bit: a pair whose product might not fit is
refused with an error instead of a wrong score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

VECTORS_A_CHUNK, QUERIES_A_CHUNK, FIRST = 8192, 256, 4


class ApproximationFile:
    """Cells of a set of integer vectors."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, cell_bits: int):
        self.ids, self.cells, self.bits = ids, cells, cell_bits

    def candidates(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        """Yield (query index, ids, lower bounds, upper bounds) of the vectors
        that may be among a query's k best here."""
        width = (1 << self.bits) - 1
        qf = q.astype(np.float64)
        up, down = width * np.maximum(qf, 0).sum(1), width * np.minimum(qf, 0).sum(1)
        near = np.empty((len(q), len(self.ids)))
        for i in range(0, len(self.ids), VECTORS_A_CHUNK):
            near[:, i : i + VECTORS_A_CHUNK] = qf @ (self.cells[i : i + VECTORS_A_CHUNK].astype(np.float64) * (1 << self.bits)).T
        near[self.ids[None, :] == q_ids[:, None]] = -np.inf
        # bounds are whole numbers, but for rounding beyond 2**53
        slack = 1e-12 * np.abs(qf).sum(1) * (np.abs(self.cells).max(initial=0) + 1.0) * (1 << self.bits)
        for j in range(len(q)):
            floor = np.partition(near[j], len(self.ids) - k)[len(self.ids) - k] + down[j] if len(self.ids) > k else -np.inf
            may = np.flatnonzero((near[j] + up[j] + 2 * slack[j] >= floor) & np.isfinite(near[j]))
            yield j, self.ids[may], near[j][may] + down[j] - slack[j], near[j][may] + up[j] + slack[j]


def approximate(bits: int):
    """mapInArrow: (id, v) to (id, d, cells)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            flat, offsets = np.asarray(v.values) >> bits, np.asarray(v.offsets)
            small = bool((np.abs(flat) < 1 << 15).all())
            flat = flat.astype(np.int16 if small else np.int64)
            cells = [flat[i:j].tobytes() for i, j in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype(np.int32)), pa.array(cells, pa.binary())], names=["id", "d", "cells"])

    return run


def top_k(emb: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024, cell_bits: int = 3, group: int = 65_536, query_group: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows."""

    def clean(df):
        v = F.col(f"`{vector}`")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
        whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
        return df.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"))

    vectors = clean(emb)
    asked = materialize(clean(queries).distinct().withColumn("q", F.xxhash64("id", "v")), "queries")
    largest = lambda df: df.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    (ask, _), (_, top) = largest(asked), largest(vectors)
    if ask is not None and top is not None and ask * top >= 2.0**63:
        raise OverflowError("inner products beyond 64 bits: use a smaller scale")
    file = materialize(vectors.mapInArrow(approximate(cell_bits), "id long, d int, cells binary"), "cells")
    parallel = emb.sparkSession.sparkContext.defaultParallelism
    n, m = file.count(), asked.count()
    groups, q_groups = max(2 * parallel, -(-n // group)), max(1, -(-m // query_group))
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = file.select(part(groups, 1).alias("p"), "d", "id", "cells", every(q_groups).alias("g"))
    right = asked.select(part(q_groups, 2).alias("g"), F.size("v").alias("d"), "id", "v", "q", every(groups).alias("p"))
    out = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def scan(vs: pa.Table, qs: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if vs.num_rows and qs.num_rows:
            d = vs["d"][0].as_py()
            cells = np.stack([np.frombuffer(c, np.int16 if len(c) == 2 * d else np.int64).astype(np.int64) for c in vs["cells"].to_pylist()])
            at = ApproximationFile(vs["id"].to_numpy(), cells, cell_bits)
            q = np.array(qs["v"].to_pylist(), np.int64)
            q_ids, marks = qs["id"].to_numpy(), qs["q"].to_numpy()
            for i in range(0, len(q), QUERIES_A_CHUNK):
                for j, ids, low, high in at.candidates(q_ids[i : i + QUERIES_A_CHUNK], q[i : i + QUERIES_A_CHUNK], k):
                    parts.append((np.full(len(ids), marks[i + j]), ids, low, high))
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    # a task holds group vectors' cells and query_group queries
    found = materialize(left.groupBy("p", "g", "d").cogroup(right.groupBy("p", "g", "d")).applyInArrow(scan, "q long, id long, low double, high double"), "bounds")
    nth = lambda col: Window.partitionBy("q").orderBy(F.desc(col))
    floor = found.withColumn("n", F.row_number().over(nth("low"))).where(F.col("n") <= k).groupBy("q").agg(F.min("low").alias("floor"), F.count("*").alias("n"))
    # ids that repeat have a row each here, and each row of the id is read for one of them
    alive = found.join(floor, "q").where((F.col("high") >= F.col("floor")) | (F.col("n") < k)).groupBy("q", "id").agg(F.max("high").alias("high"))
    alive = materialize(alive, "alive")
    dot = F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0).cast("long"), lambda a, x: a + x)
    probe = asked.select("q", F.col("id").alias("query_id"), F.col("v").alias("qv"))

    def read(rows: DataFrame) -> DataFrame:
        exact = rows.select("q", "id").join(vectors, "id").join(probe, "q").where((F.size("v") == F.size("qv")) & (F.col("id") != F.col("query_id")))
        scored = exact.select("q", "query_id", "id", dot.alias("score"))
        best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = alive.withColumn("n", F.row_number().over(nth("high"))).where(F.col("n") <= FIRST * k)
    sure = materialize(read(first), "first")
    certain = sure.groupBy("q").agg(F.min("score").alias("floor"), F.count("*").alias("have"))
    rest = alive.join(first.select("q", "id"), ["q", "id"], "left_anti").join(certain, "q", "left")
    rest = rest.where(F.col("have").isNull() | (F.col("have") < k) | (F.col("high") >= F.col("floor")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    both = sure.drop("rank").unionByName(read(rest).drop("rank")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def oracle_sql() -> str:
    """The query's rows in DuckDB SQL over embeddings."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
 q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
 s AS (SELECT q.vec_id AS query_id, q.e AS qe, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10"""
