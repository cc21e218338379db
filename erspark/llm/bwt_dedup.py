"""Removal of repeated 200-byte strings by merging sorted shards.

Sorting all suffixes of a corpus is out of reach; sorting those at synchronised
places is enough.  In every window of size bytes one 64-byte anchor is chosen
by the least hash, so equal windows choose equal anchors at equal offsets.  An
anchor found once only cannot lie in a repeated window.  For the others, the
text around the anchor (its context) is what a window may cover.

Contexts with one anchor come from many shards, aligned at the anchor.  They
are merged the way Burrows-Wheeler transforms are merged: the interleave starts
as one block per anchor, and each round splits the blocks by the next symbol to
the right, or by the preceding symbol (that of the transform) to the left.  The
round that leaves a context alone in its block is its longest common prefix or
suffix; a window repeats if its left and right blocks, together, hold it twice.
No round sorts suffixes anew, and none is longer than a window.

Equal contexts are counted before they are shuffled.  An anchor with more than
`heavy` different contexts is not gathered in a task: its windows are counted
by their 128-bit hash instead (the exact way for hot anchors).  A stretch of
one short period has an anchor at every period; only those near its ends are
kept, and the stretch is found from them (see sparse, stretches).

Cases: a null text is empty; texts below size bytes lose nothing; repeated rows
are copies of one another; a null doc_id is kept; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

ANCHOR = 64
BLOCK = 1 << 22
#: Contexts that leave a task at a time.
CONTEXTS = 20_000
MULT = 0x9E3779B97F4A7C15


def rolling(x: np.ndarray, width: int, salt: int = MULT) -> np.ndarray:
    """A 64-bit hash of every substring of width bytes, by doubling."""
    out, done, power = None, 0, 1
    part, size, p = x.astype(np.uint64) + np.uint64(1), 1, salt % 2**64
    while width:
        if width & 1:
            if out is None:
                out, done = part, size
            else:  # what is done so far, then this part
                n = min(len(out), len(part) - done)
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:n] * np.uint64(p) + part[done : done + n]
                done += size
        width >>= 1
        if width:
            if len(part) <= size:
                return np.zeros(0, np.uint64)
            part = part[:-size] * np.uint64(p) + part[size:]
            size, p = 2 * size, p * p % 2**64
    return out ^ (out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    n = len(x) - width + 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def anchors(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a whole text."""
    pos, hs = [], []
    w = size - ANCHOR + 1
    for i in range(0, max(1, len(raw) - size + 1), BLOCK):
        x = np.frombuffer(raw, np.uint8)[i : i + BLOCK + size - 1]
        if len(x) < size:
            break
        h = rolling(x, ANCHOR)
        packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        at = np.unique(sliding_min(packed, w) & np.uint64(0xFFFFFF)).astype(np.int64)
        pos.append(at + i)
        hs.append(h[at])
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.concatenate(pos), return_index=True)
    return at, np.concatenate(hs)[first].view(np.int64)


def sparse(at: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Which anchors of a text to keep.  One anchor again and again at a distance
    p below its own length means a stretch of period p.  Where that has size + p
    bytes or more, its windows repeat one another and those near its ends, so the
    anchors in its middle say nothing more (stretches() finds what it loses)."""
    keep = np.ones(len(at), bool)
    gap = np.diff(at)
    same = (h[1:] == h[:-1]) & (gap < ANCHOR)
    if not same.any():
        return keep
    new = np.r_[True, ~(same[1:] & same[:-1] & (gap[1:] == gap[:-1]))]
    number = np.cumsum(new)
    for i in np.flatnonzero(new & same).tolist():
        j, p = int(np.searchsorted(number, number[i], side="right")), int(gap[i])
        a, e = int(at[i]), int(at[j]) + ANCHOR
        if e - a >= size + p:
            keep[i : j + 1] = (at[i : j + 1] < a + size + p) | (at[i : j + 1] > e - ANCHOR - size - p)
    return keep


def stretches(x: np.ndarray, at: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of x of some period p below the anchor's length and of size + p bytes
    or more, that begin at an anchor which lies p bytes further once more."""
    out: list[tuple[int, int]] = []
    for a, p in zip(at[:-1].tolist(), np.diff(at).tolist(), strict=True):
        if p >= ANCHOR or (out and a < out[-1][1] - ANCHOR) or (x[a : a + ANCHOR] != x[a + p : a + p + ANCHOR]).any():
            continue
        e, step = a + p, 1 << 12
        while e < len(x):
            same = x[e : e + step] == x[e - p : min(len(x), e + step) - p]
            if not same.all():
                e += int(np.argmin(same))
                break
            e, step = e + len(same), 2 * step
        if e - a >= size + p:
            out.append((a, e))
    return out


def refine(symbols: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Blocks of the interleave after 0, 1, ... rounds over the columns of
    symbols: row t holds each context's block, -1 once it is alone in it."""
    out = np.full((symbols.shape[1] + 1, len(block)), -1, np.int64)
    active = np.arange(len(block))
    now = block
    for t in range(symbols.shape[1] + 1):
        _, now, n = np.unique(now, return_inverse=True, return_counts=True)
        stay = n[now] > 1
        active, now = active[stay], now[stay]
        if not len(active):
            break
        out[t, active] = now
        if t < symbols.shape[1]:
            now = now * 257 + symbols[active, t]
    return out


def merged(group: np.ndarray, ctx: list[bytes], left: np.ndarray, mult: np.ndarray, size: int) -> np.ndarray:
    """repeated[i, a]: the window that begins a bytes before the anchor of
    context i occurs elsewhere.  group: the anchors, as numbers."""
    reach = size - ANCHOR
    m = len(ctx)
    lefts, rights = np.full((m, reach), 256, np.int64), np.full((m, reach), 256, np.int64)
    right = np.array([len(c) for c in ctx]) - left - ANCHOR
    for i, c in enumerate(ctx):
        b = np.frombuffer(c, np.uint8)
        lefts[i, : left[i]] = b[: left[i]][::-1]
        rights[i, : right[i]] = b[left[i] + ANCHOR :]
    L, R = refine(lefts, group), refine(rights, group)
    out = np.zeros((m, reach + 1), bool)
    for a in range(reach + 1):
        valid = (left >= a) & (right >= reach - a)
        out[valid & (mult > 1), a] = True
        some = np.flatnonzero(valid & (L[a] >= 0) & (R[reach - a] >= 0))
        if len(some) > 1:
            _, back, n = np.unique(L[a][some] * m + R[reach - a][some], return_inverse=True, return_counts=True)
            out[some[n[back] > 1], a] = True
    return out


def covered(repeated: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Byte runs, relative to the anchor, that repeated windows cover."""
    starts, out = -np.flatnonzero(repeated)[::-1], []
    for s in starts.tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = s + size
        else:
            out.append([s, s + size])
    return [tuple(x) for x in out]


def repeated_bytes(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text: str = "text", heavy: int = 20_000) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256.
    docs is read several times in the same order, as scans of files are; give a
    materialized table for anything else."""
    reach = size - ANCHOR
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("_id"), body.alias("_t"))
    rows = rows.select("*", F.xxhash64("_t").alias("d1"), F.xxhash64(F.lit(7), F.col("_t"), F.octet_length("_t")).alias("d2"))
    facts = materialize(rows.select("rid", "_id", "d1", "d2", F.octet_length("_t").cast("long").alias("n_bytes"), F.sha2("_t", 256).alias("sha")), "facts")
    classes = facts.groupBy("d1", "d2").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))

    def find(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                hs, d1, d2, at = [], [], [], []
                for x, y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    p, h = anchors(t, size)
                    keep = sparse(p, h, size)
                    p, h = p[keep], h[keep]
                    hs.append(h)
                    at.append(p)
                    d1.append(np.full(len(p), x, np.int64))
                    d2.append(np.full(len(p), y, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (hs, d1, d2, at)], names=["h", "d1", "d2", "pos"])

    found = rows.where(F.octet_length("_t") >= size).select("d1", "d2", "_t").mapInArrow(find, "h long, d1 long, d2 long, pos long")
    # two places at least; a place goes by its hash, copies of a text have the same
    place = F.xxhash64("d1", "d2", "pos")
    shared = found.select("h", place.alias("p")).groupBy("h").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("h")
    # written, so that the join below reads it anew and a hot anchor can be split
    shared = materialize(shared, "shared")
    # copies of a text put the same places here
    places = found.join(shared, "h").groupBy("d1", "d2").agg(F.collect_set("pos").alias("at"))
    wanted = places.join(classes, ["d1", "d2"]).select("rid", "copies", "at")
    texts = materialize(rows.select("rid", "_t").join(wanted, "rid"), "texts")

    def contexts(with_bytes: bool):
        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 64):
                    out: list[list] = [[] for _ in range(6)]
                    for rid, t, copies, at in zip(*[(c.cast(pa.binary()) if c.type == pa.string() else c).to_pylist() for c in b.slice(i, 64).columns], strict=True):
                        for p in sorted(at):
                            a, e = max(0, p - reach), min(len(t), p + ANCHOR + reach)
                            c = t[a:e]
                            h, key = xxhash.xxh64_intdigest(t[p : p + ANCHOR]), xxhash.xxh3_64_intdigest(c, p - a)
                            for col, v in zip(out, (h, key, c if with_bytes else None, p - a, rid if not with_bytes else copies, p), strict=True):
                                col.append(v)
                            if len(out[0]) >= CONTEXTS:
                                yield columns(out)
                                out = [[] for _ in range(6)]
                    if out[0]:
                        yield columns(out)

        def columns(out):
            h, key = (np.array(out[k], np.uint64).view(np.int64) for k in (0, 1))
            if with_bytes:
                return pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64())], names=["h", "key", "ctx", "left", "mult"])
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64())], names=["h", "key", "rid", "pos"])

        return run

    cols = texts.select("rid", "_t", "copies", "at")
    every = cols.mapInArrow(contexts(True), "h long, key long, ctx binary, left int, mult long")
    distinct = every.groupBy("h", "key").agg(F.first("ctx").alias("ctx"), F.first("left").alias("left"), F.sum("mult").alias("mult"))
    distinct = materialize(distinct, "contexts")
    counts = distinct.groupBy("h").agg(F.count("*").alias("n"))
    hot = materialize(counts.where(F.col("n") > heavy).select("h"), "hot")
    some_hot = hot.limit(1).count() > 0
    light = distinct.join(hot, "h", "left_anti") if some_hot else distinct

    def merge(batches):
        left = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            h = pdf["h"].to_numpy()
            cuts = np.flatnonzero(h[1:] != h[:-1])
            at = int(cuts[-1]) + 1 if len(cuts) else 0
            left = pdf.iloc[at:]
            if at:
                yield spans(pdf.iloc[:at])
        if left is not None and len(left):
            yield spans(left)

    def spans(pdf):
        group = np.unique(pdf["h"].to_numpy(), return_inverse=True)[1]
        rep = merged(group, list(pdf["ctx"]), pdf["left"].to_numpy(), pdf["mult"].to_numpy(), size)
        found = [(h, k, s, e) for h, k, r in zip(pdf["h"], pdf["key"], rep, strict=True) if r.any() for s, e in covered(r, size)]
        return pd.DataFrame(found, columns=["h", "key", "s", "e"])

    result = light.repartition("h").sortWithinPartitions("h").mapInPandas(merge, "h long, key long, s long, e long")
    if some_hot:
        def windows(batches):
            for pdf in batches:
                for h, key, c, lf, m in zip(pdf["h"], pdf["key"], pdf["ctx"], pdf["left"], pdf["mult"], strict=True):
                    x = np.frombuffer(c, np.uint8)
                    w1, w2 = rolling(x, size), rolling(x, size, 0xC2B2AE3D27D4EB4F)
                    if len(w1):
                        yield pd.DataFrame({"h": h, "key": key, "s": np.arange(len(w1)) - lf, "w1": w1.view(np.int64), "w2": w2.view(np.int64), "m": m})

        out = distinct.join(hot, "h").mapInPandas(windows, "h long, key long, s long, w1 long, w2 long, m long")
        again = out.groupBy("h", "s", "w1", "w2").agg(F.sum("m").alias("m")).where("m > 1").drop("m")
        result = result.unionByName(out.join(again, ["h", "s", "w1", "w2"]).select("h", "key", "s", (F.col("s") + size).alias("e")))
    where = cols.mapInArrow(contexts(False), "h long, key long, rid long, pos long")
    runs = where.join(result, ["h", "key"]).select("rid", F.struct((F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e")).alias("e")).alias("run"))
    runs = runs.groupBy("rid").agg(F.collect_set("run").alias("runs"))

    def cut(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                out: list[list] = [[] for _ in range(4)]
                for rid, t, at, found in zip(*[(c.cast(pa.binary()) if c.type == pa.string() else c).to_pylist() for c in b.slice(i, 64).columns], strict=True):
                    found = [(r["s"], r["e"]) for r in found or ()] + stretches(np.frombuffer(t, np.uint8), np.sort(np.array(at, np.int64)), size)
                    edge = np.zeros(len(t) + 1, np.int32)
                    np.add.at(edge, [s for s, _ in found], 1)
                    np.add.at(edge, [e for _, e in found], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                    begins = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    for col, v in zip(out, (rid, int(gone.sum()), begins, hashlib.sha256(kept).hexdigest()), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["rid", "gone", "spans", "kept"])

    done = texts.select("rid", "_t", "at").join(runs, "rid", "left").mapInArrow(cut, "rid long, gone long, spans long, kept string")
    per_class = classes.join(done, "rid", "left").drop("rid")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= size)
    return facts.join(per_class, ["d1", "d2"]).select(
        F.col("_id").alias(id_col), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
