"""What the text operators share: storage that outlives executors, whole-text
iteration over Arrow batches, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a table of hashes, at least and at most (as powers of two): it is
#: broadcast, so it does not grow with the corpus beyond that.
LEAST_BITS, MOST_BITS = 15, 27
#: Edges of a graph that the driver connects by itself.
SMALL_EDGES = 100_000
#: Rows of an Arrow batch of texts: JVM and worker each hold one whole.
BATCH_ROWS = 1024
#: Rows that one step of a Python loop holds at a time.
SLICE_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).  A
    local master without that setting gets a temporary one, as in tests; a
    cluster without it is refused, since its machines share no such folder."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="erspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str = "t", batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends
    there, a lost executor costs no recomputation, and sizes are known.  What was
    shuffled for it goes once it is written.  batch_rows: rows of its Arrow
    batches at most."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/erspark-{name}-{uuid.uuid4().hex}"
    held = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._erspark_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    path = getattr(df, "_erspark_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else unmarked."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def give_back() -> None:
    """Workers stay for the next task; what they have let go of goes back to the
    system, else each keeps its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def those_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose key (long hashes) is among those of the one column of
    keys.  A table of hash bits goes to df's rows first, so only rows that it
    leaves are shuffled, not all of df."""
    sc, name = df.sparkSession.sparkContext, keys.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    slot = F.shiftrightunsigned(name, 64 - bits) + 1
    rows = keys.select(F.bitmap_bucket_number(slot).alias("n"), F.bitmap_bit_position(slot).alias("at")).groupBy("n").agg(F.bitmap_construct_agg("at").alias("bits"))
    table = np.zeros((1 << bits - 15, 1 << 12), np.uint8)
    for r in rows.toLocalIterator():
        table[r["n"] - 1] = np.frombuffer(r["bits"], np.uint8)
    held = sc.broadcast(table.ravel())

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.schema.get_field_index(key)).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield b.filter(pa.array((held.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1))

    return df.mapInArrow(some, df.schema).join(keys.withColumnRenamed(name, key), key, "left_semi")


def map_texts(
    df: DataFrame, cols: list[str], schema: str, work: Callable[..., list | tuple], text: str = "text"
) -> DataFrame:
    """Run work(list of whole UTF-8 texts, one list per column of cols) over
    slices of rows; it returns the lists of the output columns.  Null texts are
    empty bytes."""
    source = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").cast("string").alias(fresh(df, "_text")))
    target = source.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(i, SLICE_ROWS)
                texts = [t or b"" for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
                out = work(texts, *[b.column(k).to_pylist() for k in range(b.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)
        give_back()

    return source.mapInArrow(run, target)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each can reach) of some edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new, least = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges to (node, component): component is the least node that
    can be reached.  Alternating large-star and small-star rounds; every round
    is written to the shared folder.  Up to SMALL_EDGES edges are connected on the
    driver instead.  Nodes without an edge do not appear."""
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "cc")
    if now.count() <= SMALL_EDGES:
        rows = now.toArrow()
        discard(now)
        node, component = least_reachable(*(rows[c].to_numpy().astype(np.int64) for c in ("v", "u")))
        return materialize(spark.createDataFrame(pa.table({"node": node, "component": component})), "cc")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        star = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        step = materialize(star.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "cc")
        sign = step.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        discard(now)
        now = step
        if state == tuple(sign):
            break
        state = tuple(sign)
    nodes = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()).select("node", "component")
