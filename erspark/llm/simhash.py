"""SimHash near-duplicates, searched with sharded BK-trees.

Fingerprints within four bits of one another agree on at least two of six
blocks of their 64 bits.  So every distinct fingerprint goes to fifteen shards,
one for each pair of blocks, keyed by the two blocks' values.  Each shard's
fingerprints form a BK-tree (children keyed by the integer distance to their
parent); the search follows only edges within the radius.  A shard above
shard_rows fingerprints is cut into sub-shards, and each pair of sub-shards is
a task of its own: one's tree, the other's queries.  All trees together grow
with the corpus, so they are never broadcast whole: a tree and its queries meet
by their key.  A shard returns at most one edge for each fingerprint (to the
least of its component in the shard), never all pairs.

drop_similar() takes five-word shingles and a similarity of 0.8.  Such pairs
differ in some ten bits, too many for blocks of bits; its shards are keyed by
shingles instead: of the SKETCH least shingle hashes of a text, the KEYS rarest
that another text has too.  A pair of similarity 0.8 shares most of the SKETCH.
Trees are searched with a radius of WIDE bits, and what the search links is
checked against the whole shingle sets of both texts.  Pairs that share none of
these keys, or differ in more bits, come by an exact way for the rest
(rest_links): in any one order of all shingles, two texts of that similarity
share one of their first n - ceil(similarity * n) + 1.  The order is rarest
first, by a sketch of counts, and only texts that are not connected yet meet.
Where more than FEW hold a shingle, they bring parity sketches of their sets: two
sets differ in as many shingles as their sketches in bits, or more, so what is
too far apart goes without a row.

Cases: a null or wordless text has fingerprint zero, which links like any
other; a null doc_id is no candidate for component_id (a component of such rows
alone has a null one); repeated rows share a fingerprint; empty tables give
empty results; other columns are ignored by near_duplicates() and kept by
drop_near_duplicates().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chaining import pack, unpack, word_hashes
from .common import connected_components, discard, fresh, map_texts, materialize, those_among

#: (lowest bit, bits) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
STEP = 1 << 16
#: Least shingle hashes of a text, those of them that key its shards, and the
#: radius for a similarity of 0.8 (ten bits on average, three standard deviations more).
SKETCH, KEYS, WIDE = 16, 4, 18
#: Bits of the counters that order shingles, and of a row of them; holders of a
#: shingle that one task compares, and that meet without parity sketches, whose
#: bits come last.
SLOTS, CHUNK, HOLDERS, FEW, PARITY = 22, 16, 4096, 8, 1024


def shingle_hashes(raw: bytes, width: int):
    """XXH64 of all width-word shingles of a whole text, in arrays of STEP."""
    w = raw.lower().split()
    if not w:
        return
    n, digest = max(1, len(w) - width + 1), xxhash.xxh64_intdigest
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    last = min(width, len(w)) - 1
    for i in range(0, n, STEP):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : min(n, i + STEP)], ends[i + last : min(n, i + STEP) + last], strict=True)], np.uint64)


def majority(parts: list[np.ndarray]) -> int:
    """The bits that more than half of the hashes have."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes, width: int = 4) -> int:
    """Unsigned SimHash over all width-word shingles of a whole text."""
    return majority(shingle_hashes(raw, width))


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes; one of its own for a wordless text."""
    parts = list(shingle_hashes(raw, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)


def rolled(raw: bytes, width: int) -> np.ndarray:
    """As shingle_set(), by numbers made from word hashes, which take less time."""
    h = word_hashes(raw)
    if not len(h):
        return np.zeros(1, np.uint64)
    width = min(width, len(h))
    g = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(g)]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(g ^ (g >> np.uint64(29)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, more..., _fp): the fingerprint as a signed long."""
    from pyspark.sql.types import LongType, StructField, StructType

    def work(texts, *cols):
        return [*cols, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    cols = [id_col, *more]
    return map_texts(docs, cols, StructType([docs.schema[c] for c in cols] + [StructField("_fp", LongType())]), work, text)


class BKTree:
    """A BK-tree built in bulk.  Node i holds fps[order[i]]; its children are
    keyed by their distance to it."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.root, self.children = fps, 0, {}
        stack = [(None, 0, np.arange(len(fps)))]
        while stack:
            parent, edge, rows = stack.pop()
            node, rest = int(rows[0]), rows[1:]
            if parent is not None:
                self.children.setdefault(parent, []).append((edge, node))
            if len(rest):
                d = np.bitwise_count(fps[rest] ^ fps[node])
                for e in np.unique(d).tolist():
                    stack.append((node, e, rest[d == e]))

    def search(self, queries: np.ndarray, radius: int):
        """Yield (node, indices of the queries within radius of it).  All queries
        go down together; each follows only edges within radius of its distance."""
        if not len(self.fps):
            return
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int16)
            if (near := d <= radius).any():
                yield node, q[near]
            for edge, child in self.children.get(node, ()):
                if (go := np.abs(d - edge) <= radius).any():
                    stack.append((child, q[go]))


def star(tree_fps: np.ndarray, query_fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least of its component) among both sets, found by
    searching the tree of the first with all of the second."""
    every = np.unique(np.concatenate([tree_fps, query_fps]))
    label = np.arange(len(every))
    tree_at, query_at = np.searchsorted(every, tree_fps), np.searchsorted(every, query_fps)
    for node, near in BKTree(tree_fps).search(query_fps, radius):
        found = np.append(query_at[near], tree_at[node])
        ls = np.unique(label[found])
        if len(ls) > 1:
            label[np.isin(label, ls)] = ls[0]
    moved = label != np.arange(len(every))
    return every[moved].view(np.int64), every[label[moved]].view(np.int64)


def forest(fps: np.ndarray, mine: np.ndarray, theirs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows within radius that connect what the search of mine's
    tree with theirs connects, each a pair that was found: at most one a row."""
    values, first = np.unique(fps, return_index=True)
    at = np.searchsorted(values, fps)
    label, out_i, out_j = np.arange(len(values)), [np.flatnonzero(first[at] != np.arange(len(fps)))], []
    out_j.append(first[at[out_i[0]]])
    tree, queries = np.unique(at[mine]), np.unique(at[theirs])

    for node, near in BKTree(values[tree]).search(values[queries], radius):
        a = int(tree[node])
        near = queries[near]
        new, some = np.unique(label[near], return_index=True)
        other = new != label[a]
        if other.any():
            # one found pair for each component that joins
            out_i.append(first[near[some[other]]])
            out_j.append(np.full(int(other.sum()), first[a]))
            label[np.isin(label, new[other])] = label[a]
    return np.concatenate(out_i), np.concatenate(out_j)


def links(fps: DataFrame, radius: int = 4, shard_rows: int = 20_000) -> DataFrame:
    """Distinct signed fingerprints (_fp) to edges (a, b) that connect just what
    pairs within radius connect.  radius is 4 at most."""
    if radius > 4:
        raise ValueError("six blocks find pairs of four differing bits at most")

    def block(i):
        low, bits = BLOCKS[i]
        return F.shiftrightunsigned("_fp", low).bitwiseAND(F.lit((1 << bits) - 1))

    keys = [F.lit(n << 22) + block(i) * (1 << 11) + block(j) for n, (i, j) in enumerate(combinations(range(6), 2))]
    rows = fps.select("_fp", F.explode(F.array(*keys)).alias("_key"))
    sizes = rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_parts", F.ceil(F.col("_n") / shard_rows).cast("int"))
    own = F.expr("cast(pmod(xxhash64(_fp), _parts) as int)")
    tasks = F.expr("transform(sequence(0, _parts - 1), p -> struct(least(p, _own) as t, greatest(p, _own) as q))")
    dealt = (
        rows.join(sizes, "_key")
        .withColumn("_own", own)
        .select("_key", "_fp", "_own", F.explode(tasks).alias("_task"))
        .select("_key", F.col("_task.t").alias("_t"), F.col("_task.q").alias("_q"), "_own", "_fp")
    )

    def search(batches):
        left = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            key = pdf[["_key", "_t", "_q"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            at = int(cuts[-1]) if len(cuts) else 0
            left = pdf.iloc[at:]
            yield from solve(pdf.iloc[:at], cuts[:-1] if len(cuts) else cuts)
        if left is not None and len(left):
            key = left[["_key", "_t", "_q"]].to_numpy()
            yield from solve(left, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)

    def solve(pdf, cuts):
        if not len(pdf):
            return
        fp, t, q, mine = (pdf[c].to_numpy() for c in ("_fp", "_t", "_q", "_own"))
        fp, a, b = fp.view(np.uint64), [], []
        ends = [0, *cuts.tolist(), len(fp)]
        for i, j in zip(ends, ends[1:], strict=False):
            one = fp[i:j]
            if j - i == 2 and t[i] == q[i]:
                if np.bitwise_count(one[0] ^ one[1]) <= radius:
                    a.append(one[:1].view(np.int64))
                    b.append(one[1:].view(np.int64))
            elif j - i > 1:
                x, y = star(one[mine[i:j] == t[i]], one[mine[i:j] == q[i]], radius)
                a.append(x)
                b.append(y)
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt.repartition("_key", "_t", "_q").sortWithinPartitions("_key", "_t", "_q").mapInPandas(search, "a long, b long").distinct()


def components(prints: DataFrame, id_col: str, radius: int = 4) -> DataFrame:
    """(_fp, _root): the least fingerprint that each distinct one is linked to."""
    distinct = prints.select("_fp").distinct()
    edges = links(distinct, radius)
    return connected_components(edges).withColumnsRenamed({"node": "_fp", "component": "_root"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row per document: its fingerprint in hex and its component's least id."""
    prints = materialize(fingerprints(docs, id_col, text), "simhash")
    least = prints.groupBy("_fp").agg(F.min(id_col).alias("_least"))
    rooted = least.join(components(prints, id_col, radius), "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    reach = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    by_print = rooted.join(reach, "_root").select("_fp", "component_id")
    return prints.join(by_print, "_fp").select(id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """docs with one row of each component: that of the least id (null ids
    last), among rows of one id that of the least text hash."""
    mark = fresh(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.col(f"`{text}`")))
    prints = materialize(fingerprints(marked, id_col, text, (mark,)), "simhash")
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(mark).alias("mark"))).alias("best")
    least = prints.groupBy("_fp").agg(best)
    rooted = least.join(components(prints, id_col, radius), "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    kid, kmark = fresh(marked, "_k_id"), fresh(marked, "_k_mark")
    keep = rooted.groupBy("_root").agg(F.min("best").alias("best")).select(F.col("best.id").alias(kid), F.col("best.mark").alias(kmark)).distinct()
    out = marked.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col(kid)) & (F.col(mark) == F.col(kmark)), "left_semi")
    return out.dropDuplicates([id_col, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])


def similar_links(classes: DataFrame, radius: int = WIDE, shard_rows: int = 20_000) -> DataFrame:
    """(t: text class, fp, keys: its least shingle hashes) to pairs (t0, t1) that
    the trees of the shards connect."""
    spread = classes.select("t", "fp", F.explode("keys").alias("key"))
    counts = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rarest = Window.partitionBy("t").orderBy("n", "key")  # SKETCH rows of a text at most
    chosen = spread.join(counts, "key").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= KEYS).select("t", "fp", "key")
    sizes = chosen.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    tasks = F.expr("transform(sequence(0, parts - 1), p -> struct(least(p, own) as a, greatest(p, own) as b))")
    dealt = chosen.join(sizes, "key").withColumn("own", F.expr("cast(pmod(xxhash64(t), parts) as int)")).select("key", "t", "fp", "own", F.explode(tasks).alias("x")).select("key", "x.a", "x.b", "own", "fp", "t")

    def search(batches):
        left = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            key = pdf[["key", "a", "b"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            at = int(cuts[-1]) if len(cuts) else 0
            left = pdf.iloc[at:]
            if at:
                yield solve(pdf.iloc[:at])
        if left is not None and len(left):
            yield solve(left)

    def solve(pdf):
        key, t, fp, own = pdf[["key", "a", "b"]].to_numpy(), pdf["t"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(t)]
        found = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i > 1:
                x, y = forest(fp[i:j], own[i:j] == key[i, 1], own[i:j] == key[i, 2], radius)
                found.append((t[i:j][x], t[i:j][y]))
        x, y = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pd.DataFrame({"t0": np.minimum(x, y), "t1": np.maximum(x, y)})

    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInPandas(search, "t0 long, t1 long").where("t0 <> t1").distinct()


def shingle_weights(docs: DataFrame, width: int, text: str) -> np.ndarray:
    """For each slot of shingle hashes, four times the logarithm of its count."""
    slots, parts = 1 << SLOTS, 1 << SLOTS - CHUNK

    def count(batches):
        total = np.zeros(slots, np.uint32)
        for b in batches:
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                total[(rolled(raw or b"", width) >> np.uint64(64 - SLOTS)).astype(np.int64)] += 1
        some = [(i, pack(c)) for i, c in enumerate(total.reshape(parts, -1)) if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([c for _, c in some], pa.binary())], names=["chunk", "body"])

    def add(pdf):
        total = np.zeros(1 << CHUNK, np.int64)
        for body in pdf["body"]:
            total += unpack(body)[0]
        scale = np.ceil(4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "body": [scale.tobytes()]})

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "chunk int, body binary")
    out = np.zeros((parts, 1 << CHUNK), np.uint8)
    for r in rows.groupBy("chunk").applyInPandas(add, "chunk int, body binary").collect():
        out[r["chunk"]] = np.frombuffer(r["body"], np.uint8)
    return out.ravel()


def may_reach(n, pos, i, j, similarity: float) -> np.ndarray:
    """Whether rows i and j, if what they share here is the first that their
    texts share, leave enough after it for the similarity."""
    need = similarity / (1 + similarity) * (n[i] + n[j])
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need - 1e-6


def across(root, n, pos, own, sketch, a, b, similarity: float, tree: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of one shingle's holders that may be similar and are not connected;
    of holders that are dealt, those of part a with those of part b.  tree: only
    what connects the same, by the least distances, one a row at most."""
    root = np.unique(root, return_inverse=True)[1]
    by = np.argsort(n, kind="stable")
    left, right = by[own[by] == a], by[own[by] == b]
    sizes, out_i, out_j, most = n[right], [by[:0]], [by[:0]], (1 - similarity) / (1 + similarity)
    for x in left.tolist():
        lo = np.searchsorted(sizes, similarity * n[x] - 1e-6)
        hi = np.searchsorted(sizes, n[x] / similarity + 1e-6, side="right")
        y = right[lo:hi]
        y = y[(root[y] != root[x]) & ((y > x) if a == b else True)]
        y = y[may_reach(n, pos, np.full(len(y), x), y, similarity)]
        far = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        near = far <= most * (n[y] + n[x]) + 1e-6
        y = y[near]
        if tree and len(y):
            y = y[np.argsort(far[near], kind="stable")]
            new, some = np.unique(root[y], return_index=True)
            y = y[some]
            root[np.isin(root, new)] = root[x]
        out_i.append(np.full(len(y), x))
        out_j.append(y)
    return np.concatenate(out_i), np.concatenate(out_j)


def by_group(names: list[str], solve):
    """mapInPandas over rows sorted by names: solve() gets whole groups."""

    def run(batches):
        held = []
        for pdf in batches:
            key = pdf[names].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if held and len(key) and (held[-1][names].to_numpy()[-1] != key[0]).any():
                cuts = np.append(0, cuts)
            if len(cuts):
                yield solve(pd.concat([*held, pdf.iloc[: cuts[-1]]], ignore_index=True))
                held = []
            if len(pdf):
                held.append(pdf.iloc[int(cuts[-1]) if len(cuts) else 0 :])
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def rest_links(docs: DataFrame, roots: DataFrame, t: str, text: str, width: int, similarity: float):
    """(pairs, hot, what was written) for pairs (t0, t1) of texts with different roots (t, root; a
    text without a row is its own) that share one of their first shingles and may
    be similar: those that share one of few holders, and a function of newer roots
    and tree that gives those that share one of many."""
    heat = docs.sparkSession.sparkContext.broadcast(shingle_weights(docs, width, text))

    def work(texts, ts):
        n, keys, heats, sketches = [], [], [], []
        for raw in texts:
            g = rolled(raw, width)
            w = heat.value[(g >> np.uint64(64 - SLOTS)).astype(np.int64)]
            first = np.lexsort((g, w))[: len(g) - int(np.ceil(similarity * len(g) - 1e-9)) + 1]
            n.append(len(g))
            keys.append(g[first].tobytes())
            heats.append(w[first].tobytes())
            odd = np.bincount((g & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
            sketches.append(np.packbits(odd.astype(bool)).tobytes())
        return [ts, n, keys, heats, sketches]

    per = map_texts(docs, [t], "t long, n int, keys binary, heats binary, sketch binary", work, text).dropDuplicates(["t"])
    per = materialize(per.join(roots, "t", "left").select("t", F.coalesce("root", "t").alias("root"), "n", "keys", "heats", "sketch"), "first")
    kinds = [("key", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("own", pa.int32()), ("t", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]

    def deal(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for t, root, n, keys, heats, _ in zip(*[c.to_pylist() for c in batch.slice(i, 256).columns], strict=True):
                    key = np.frombuffer(keys, np.int64)
                    # the parts of a shingle that many may hold; a key and its parts agree in all texts
                    parts = np.maximum(1, np.ceil(2.0 ** (np.frombuffer(heats, np.uint8) / 4) / HOLDERS)).astype(np.int64)
                    own = t % parts
                    at = np.repeat(np.arange(len(key)), parts)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
                    same = np.full(len(at), 1)
                    out.append((key[at], np.minimum(own[at], other), np.maximum(own[at], other), own[at], same * t, same * root, same * n, at))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[x for x, _ in kinds])

    names = ["key", "a", "b"]

    def groups(pdf):
        key, cols = pdf[names].to_numpy(), [pdf[c].to_numpy() for c in ("t", "root", "n", "pos", "own")]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        return key, cols, first, np.diff(np.append(first, len(key)))

    def few(pdf):
        """The pairs of small groups, the rows of large ones that are not one component."""
        key, (t, root, n, pos, _), first, size = groups(pdf)
        out_i, out_j = [first[:0]], [first[:0]]
        for m in range(2, FEW + 1):
            at = first[(size == m) & (key[first, 1] == key[first, 2])]
            i, j = np.triu_indices(m, 1)
            i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            some = (root[i] != root[j]) & may_reach(n, pos, i, j, similarity)
            out_i.append(i[some])
            out_j.append(j[some])
        i, j = np.concatenate(out_i), np.concatenate(out_j)
        pairs = pd.DataFrame({"t0": np.minimum(t[i], t[j]), "t1": np.maximum(t[i], t[j])}).drop_duplicates()
        large = (size > 1) & ((size > FEW) | (key[first, 1] != key[first, 2]))
        large &= np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        # whole numbers beside missing ones
        both = [pairs.astype("Int64"), pdf[np.repeat(large, size)].astype("Int64")]
        return pd.concat(both, ignore_index=True).reindex(columns=["t0", "t1", *[x for x, _ in kinds]])

    def many(pdf, tree):
        key, (t, root, n, pos, own), first, size = groups(pdf)
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(t), -1)
        out_i, out_j = [first[:0]], [first[:0]]
        for x, m in zip(first.tolist(), size.tolist(), strict=True):
            y = x + m
            i, j = across(root[x:y], n[x:y], pos[x:y], own[x:y], sketch[x:y], key[x, 1], key[x, 2], similarity, tree)
            out_i.append(x + i)
            out_j.append(x + j)
        i, j = np.concatenate(out_i), np.concatenate(out_j)
        return pd.DataFrame({"t0": np.minimum(t[i], t[j]), "t1": np.maximum(t[i], t[j])}).drop_duplicates()

    columns = ", ".join(f"{x} {'long' if k == pa.int64() else 'int'}" for x, k in kinds)
    dealt = per.mapInArrow(deal, columns).repartition(*names).sortWithinPartitions(*names)
    found = materialize(dealt.mapInPandas(by_group(names, few), f"t0 long, t1 long, {columns}"), "rest")
    rows = found.where("t0 is null").select(*[x for x, _ in kinds if x != "root"]).join(per.select("t", "sketch"), "t")

    def hot(roots: DataFrame, tree: bool) -> DataFrame:
        now = rows.join(roots, "t", "left").withColumn("root", F.coalesce("root", "t")).repartition(*names).sortWithinPartitions(*names)
        return now.mapInPandas(by_group(names, lambda pdf: many(pdf, tree)), "t0 long, t1 long").distinct()

    return found.where("t0 is not null").select("t0", "t1").distinct(), hot, (per, found)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of texts that shingle sets of similarity
    (shared over all) connect: that of the least id (null ids last), among rows of
    one id that of the least text hash."""
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    mark, ident = fresh(docs, "_mark"), docs.schema[id_col]
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))

    def work(texts, ids, ts):
        fps, keys = [], []
        for t in texts:
            parts = list(shingle_hashes(t, width))
            fps.append(majority(parts))
            keys.append((np.unique(np.concatenate(parts))[:SKETCH] if parts else np.zeros(1, np.uint64)).view(np.int64).tolist())
        return [ids, ts, np.array(fps, np.uint64).view(np.int64), keys]

    schema = StructType([StructField("id", ident.dataType), StructField("t", LongType()), StructField("fp", LongType()), StructField("keys", ArrayType(LongType()))])
    prints = materialize(map_texts(marked, [id_col, mark], schema, work, text), "prints")
    classes = prints.groupBy("t").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))

    def check(batches):
        for pdf in batches:
            good = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pdf.loc[np.array(good, bool), ["a", "b"]]

    def verified(found: DataFrame) -> DataFrame:
        """The pairs whose whole shingle sets are similar."""
        ends = found.select(F.col("t0").alias("t")).unionByName(found.select(F.col("t1").alias("t"))).distinct()
        texts = those_among(marked.select(F.col(mark).alias("t"), F.col(f"`{text}`").cast("string").alias("text")), "t", ends).dropDuplicates(["t"])
        sets = materialize(map_texts(texts, ["t"], "t long, s binary", lambda xs, ts: [ts, [shingle_set(x, width).tobytes() for x in xs]], "text"), "sets")
        side = lambda t, s: sets.select(F.col("t").alias(t), F.col("s").alias(s))
        good = found.join(side("t0", "x"), "t0").join(side("t1", "y"), "t1").select(F.col("t0").alias("a"), F.col("t1").alias("b"), "x", "y").mapInPandas(check, "a long, b long")
        out = materialize(good, "sure")
        discard(sets)
        return out

    def connected(edges: DataFrame) -> DataFrame:
        return connected_components(edges).withColumnsRenamed({"node": "t", "component": "root"})

    sure = verified(materialize(similar_links(classes), "similar"))
    roots = connected(sure)
    pairs, hot, parts = rest_links(marked, roots, mark, text, width, similarity)
    found = materialize(pairs.unionByName(hot(roots, True)).distinct(), "rest")
    while True:
        # large groups of similar texts become one, then what is left meets as a whole
        more = verified(found)
        if more.limit(1).count() == 0:
            break
        sure = sure.unionByName(more)
        roots = connected(sure)
        found = materialize(hot(roots, True), "rest")
    comp = connected(sure.unionByName(verified(materialize(hot(roots, False), "rest"))))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("t").alias("mark"))).alias("best")
    least = prints.groupBy("t").agg(best).join(comp, "t", "left").withColumn("root", F.coalesce("root", "t"))
    for df in parts:
        discard(df)
    # rows of one (id, hash) lie together: one shuffle for the choice and for repeated rows
    row, kept = fresh(marked, "_row"), fresh(marked, "_kept")
    keep = least.groupBy("root").agg(F.min("best").alias("best")).select(F.struct("best.id", "best.mark").alias(kept)).distinct()
    keep = keep.withColumn(row, F.xxhash64(f"{kept}.id", f"{kept}.mark"))
    rows = marked.withColumn(row, F.xxhash64(F.col(f"`{id_col}`"), mark))
    own = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(mark).alias("mark"))
    # as an order, so that the hash alone is the key of the join
    out = rows.join(keep.withColumnRenamed(row, f"{row}_"), (F.col(row) == F.col(f"{row}_")) & (own <= F.col(kept)) & (own >= F.col(kept)), "left_semi")
    return out.dropDuplicates([row, id_col, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
