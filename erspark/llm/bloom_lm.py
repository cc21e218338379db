"""Language-model scores from a log-frequency Bloom filter.

Tokens are lower-cased words, then one end per text.  Counts of single tokens,
of pairs and of triples come from all training rows; nothing is cut but triples
that occur once (least_count), so the model grows with the corpus.
A log-frequency Bloom filter stores each n-gram with its quantised count q = 1 +
floor(log_base c) as the q entries (n-gram, 1) ... (n-gram, q).  A probe asks for
1, 2, ... until an entry is missing: that q gives the count back.

Texts are read in blocks of about a million words.  A block sends each bucket of
hashes one compressed row with its distinct n-grams and their counts.  A bucket
adds up, fills its shard of the filter, and answers each block with the exact
counts of its tokens; the block's own postings wait for them under the block's
key.  So nothing gathers by token or by partition: a group is a bucket (its
share of the distinct n-grams) or a block.  Shards are broadcast in groups of at
most GROUP_BYTES, so no broadcast grows with the corpus, only their number.

score: sum of log10 P(w | u, v); P is a weighted mean of triple, pair and
add-one single estimates, all of them probes.  A context seen c times weighs
c / (c + TRUST), the shorter order the rest.  A text comes from that model or from single tokens alone with equal chance, so
one without familiar n-grams loses next to nothing.  base_score uses exact
counts.

Cases: a null text is empty (its only token is the end); a null doc_id counts
as the empty text in the hold-out rule; repeated rows are counted and scored as
often as they occur; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chaining import pack, unpack
from .common import BATCH_ROWS, discard, give_back, materialize

END = b""
HASHES = 3
#: Words of a block, words of a bucket, bytes of a broadcast, texts scored at a time.
BLOCK_WORDS, BUCKET_WORDS, GROUP_BYTES, SLICE = 1 << 20, 3 << 18, 1 << 26, 512
#: Bytes of text scored at a time, if more than one text.
SLICE_BYTES = 1 << 21
#: Levels that a count has at most; a context seen so often weighs one half.
LEVELS, TRUST = 128, 5.0
TOKENS, PAIRS, TRIPLES, POSTINGS, ANSWER, SHARD, STATS = range(7)
ROW = "bucket int, block long, kind int, body binary"


def keys_of(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of XXH3-128 for each token."""
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in tokens]), "<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].astype(np.uint32)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def levels(c: np.ndarray, base: float) -> np.ndarray:
    """The quantised count 1 + floor(log_base c)."""
    return 1 + np.floor(np.log(c) / math.log(base) + 1e-9).astype(np.int64)


def value(q: np.ndarray, base: float) -> np.ndarray:
    """The count that a level stands for: 0, or the middle of its whole numbers."""
    low, high = np.ceil(base ** (q - 1) - 1e-9), np.ceil(base**q - 1e-9) - 1
    return np.where(q > 0, (low + np.maximum(low, high)) / 2, 0.0)


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def shard(gram: np.ndarray, q: np.ndarray, bits_per_entry: float) -> np.ndarray:
    """The bytes of a filter with entries (gram, 1) ... (gram, q)."""
    bits = max(1024, int(q.sum() * bits_per_entry) // 8 * 8)
    table = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        some = gram[q >= level]
        for i in range(HASHES):
            table[mixed(some, 17 + level * HASHES + i) % np.uint64(bits)] = True
    return np.packbits(table, bitorder="little")


class Shards:
    """A group of shards that lie in one array: buckets first, first + 1, ..."""

    def __init__(self, first: int, tables: list[np.ndarray]):
        self.first, self.bytes = first, np.concatenate(tables)
        sizes = np.array([len(t) for t in tables], np.int64)
        self.bits, self.begin = (sizes * 8).astype(np.uint64), (np.cumsum(sizes) - sizes) * 8

    def levels(self, gram: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        own = bucket - self.first
        out, alive, level = np.zeros(len(gram), np.int64), np.arange(len(gram)), 0
        while len(alive):
            level += 1
            g, b = gram[alive], own[alive]
            hit = np.ones(len(alive), bool)
            for i in range(HASHES):
                at = self.begin[b] + (mixed(g, 17 + level * HASHES + i) % self.bits[b]).astype(np.int64)
                hit &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            out[alive] = level
            if level >= 400:  # a full shard would answer yes for ever
                break
        return out


def probe(gram: np.ndarray, groups: list, buckets: int) -> np.ndarray:
    """The level of each gram.  groups: (first bucket, callable that gives its
    Shards), by first bucket; one group is held at a time."""
    bucket = bucket_of(gram, buckets)
    which = np.searchsorted([g[0] for g in groups], bucket, side="right") - 1
    out = np.zeros(len(gram), np.int64)
    for k, (_, load) in enumerate(groups):
        some = np.flatnonzero(which == k) if len(groups) > 1 else np.arange(len(gram))
        if len(some):
            out[some] = load().levels(gram[some], bucket[some])
    return out


def words(raw: bytes) -> list[bytes]:
    out = raw.lower().split()
    out.append(END)
    return out


def grams_of(k: np.ndarray, begins: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair and the triple that end at each token of texts laid end to end
    (begins: their first tokens); start stands before a text."""
    x, y = np.empty_like(k), np.empty_like(k)
    x[1:] = k[:-1]
    x[begins] = start
    y[1:] = x[:-1]
    y[begins] = start
    pair = mixed(x * np.uint64(3) + mixed(k, 1), 2)
    return pair, mixed(y * np.uint64(5) + pair, 4)


def block_rows(buckets: int):
    """mapInArrow: (row key, is training, text) to ROW: what a block sends."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
    start = int(keys_of([END])[0][0])

    def row(bucket: int, block: int, kind: int, *cols):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([pack(*cols)], pa.binary())], schema=schema)

    def flush(block: int, known: dict, ids: list, train: list, keys: list):
        k1, k2 = keys_of(list(known))
        order = np.lexsort((k2, k1))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        k1, k2 = k1[order], k2[order]
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = rank[np.concatenate(ids)]
        train = np.array(train, bool)
        learnt = np.repeat(train, lengths)
        count = np.bincount(flat[learnt], minlength=len(k1))
        cut = np.searchsorted(bucket_of(k1, buckets), np.arange(buckets + 1)).tolist()
        for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
            if j > i:
                yield row(b, block, TOKENS, np.diff(k1[i:j], prepend=np.uint64(0)), k2[i:j], count[i:j])
        # the n-grams of training rows
        own = lengths[train]
        pair, triple = grams_of(k1[flat[learnt]], np.cumsum(own) - own, start)
        for kind, every in ((PAIRS, pair), (TRIPLES, triple)):
            grams, n = np.unique(every, return_counts=True)
            cut = np.searchsorted(bucket_of(grams, buckets), np.arange(buckets + 1)).tolist()
            for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
                if j > i:
                    yield row(b, block, kind, np.diff(grams[i:j], prepend=np.uint64(0)), n[i:j].astype(np.int32))
        del pair, triple, every, grams, n
        # token by token: documents and how often; the bucket is any
        doc = np.repeat(np.arange(len(ids)), lengths)
        spot, tf = np.unique(flat * len(ids) + doc, return_counts=True)
        held = np.bincount(spot // len(ids), minlength=len(k1))
        yield row(block % buckets, block, POSTINGS, held.astype(np.int32), (spot % len(ids)).astype(np.int32), tf.astype(np.int32), np.array(keys, np.int64), lengths)

    def run(batches):
        known: dict[bytes, int] = {}
        ids, train, keys, size, seq = [], [], [], 0, 0
        part = TaskContext.get().partitionId()
        for b in batches:
            for i in range(0, b.num_rows, 64):
                s = b.slice(i, 64)
                for k, learn, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    w = words(t or b"")
                    ids.append(np.array([known.setdefault(x, len(known)) for x in w], np.int64))
                    train.append(learn)
                    keys.append(k)
                    size += len(w)
                    if size >= BLOCK_WORDS:
                        yield from flush(part << 32 | seq, known, ids, train, keys)
                        known, ids, train, keys, size, seq = {}, [], [], [], 0, seq + 1
                        give_back()
        if ids:
            yield from flush(part << 32 | seq, known, ids, train, keys)
        del known, ids, train, keys
        give_back()

    return run


def added_up(bodies: pa.ChunkedArray, rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of some rows and how often each is there."""
    parts = []
    for i in rows:
        d, n = unpack(bodies[i].as_py())
        parts.append((np.cumsum(d), n))
    g, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    del parts, d
    order = np.argsort(g, kind="stable")
    n, g = n[order], g[order]
    del order
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return g[first], np.add.reduceat(n, first, dtype=np.int64)


def add_up(base: float, bits_per_entry: float, least_count: int):
    """applyInArrow over a bucket's rows: exact counts back to each block, the
    bucket's shard, and (tokens, types, entries)."""

    def work(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        bucket = t["bucket"][0].as_py()
        # bodies stay packed until their kind's turn
        tokens, grams = [], {PAIRS: [], TRIPLES: []}
        for i, (block, kind) in enumerate(zip(t["block"].to_pylist(), t["kind"].to_pylist(), strict=True)):
            if kind == POSTINGS:
                out.append((-1, block, POSTINGS, t["body"][i].as_py()))
            elif kind == TOKENS:
                d, k2, n = unpack(t["body"][i].as_py())
                tokens.append((block, np.cumsum(d), k2, n))
            else:
                grams[kind].append(i)
        gram, q = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if tokens:
            k1, k2, n = (np.concatenate([x[i] for x in tokens]) for i in (1, 2, 3))
            order = np.lexsort((k2, k1))
            a, b = k1[order], k2[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            group = np.cumsum(new) - 1
            total = np.bincount(group, n[order]).astype(np.int64)
            back = np.empty(len(order), np.int64)
            back[order] = total[group]
            at = 0
            for block, x, _, _ in tokens:
                out.append((bucket, block, ANSWER, pack(back[at : at + len(x)])))
                at += len(x)
            some = total > 0
            gram, q = a[new][some], levels(total[some], base)
            out.append((bucket, -1, STATS, pack(np.array([total.sum(), some.sum()], np.int64))))
        if tokens:
            tokens = [None]
            del k1, k2, n, order, a, b, new, group, total, back, some
        for kind, least in ((PAIRS, 1), (TRIPLES, least_count)):
            if grams[kind]:
                g, n = added_up(t["body"], grams[kind])
                some = n >= least
                gram, q = np.concatenate([gram, g[some]]), np.concatenate([q, levels(n[some], base)])
                del g, n, some
        if tokens or any(grams.values()):
            out.append((bucket, -1, SHARD, shard(gram, q, bits_per_entry).tobytes()))
        types = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        del gram, q, grams
        give_back()
        return pa.table({n.split()[0]: pa.array([o[i] for o in out], x) for i, (n, x) in enumerate(zip(ROW.split(", "), types, strict=True))})

    return work


def base_sums(t: pa.Table) -> pa.Table:
    """applyInArrow over a block's rows: exact sums of each of its texts."""
    rows = sorted(zip(t["kind"].to_pylist(), t["bucket"].to_pylist(), t["body"].to_pylist(), strict=True), key=lambda x: x[:2])
    held, doc, tf, keys, lengths = unpack(rows[0][2])
    c = np.concatenate([unpack(r[2])[0] for r in rows[1:]])
    c = np.repeat(c, held)
    logs = np.bincount(doc, tf * np.log10(c + 1.0), minlength=len(keys))
    known = np.bincount(doc, tf * (c > 0), minlength=len(keys)).astype(np.int64)
    return pa.table({"k": keys, "n_tokens": lengths, "n_known": known, "logs": logs})


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", base: float = 1.5, bits_per_entry: float = 8.0, least_count: int = 2) -> DataFrame:
    """One row per document: token counts, base_score and score.  least_count:
    triples below it are left out, at any size of the corpus."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    remainder = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 7
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), body).alias("k"), F.col(f"`{id_col}`").alias("_id"), (remainder != 2).alias("train"), body.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // (6 * BUCKET_WORDS)))
    sent = rows.select("k", "train", "text").mapInArrow(block_rows(buckets), ROW)
    done = materialize(sent.groupBy("bucket").applyInArrow(add_up(base, bits_per_entry, least_count), ROW), "counts", BATCH_ROWS)
    # one row a bucket
    n = v = 0
    for r in done.where(F.col("kind") == STATS).select("body").toLocalIterator():
        x = unpack(r[0])[0]
        n, v = n + int(x[0]), v + int(x[1])
    groups = broadcasts(done.where(F.col("kind") == SHARD).select("bucket", "body"), buckets)
    sums = done.where(F.col("kind").isin(POSTINGS, ANSWER)).groupBy("block").applyInArrow(base_sums, "k long, n_tokens long, n_known long, logs double")
    # written, so that the shards leave the executors
    model = materialize(model_scores(rows, groups, buckets, n, v, base, docs.schema[id_col].dataType.simpleString()), "scores", BATCH_ROWS)
    for _, bc in groups:
        bc.destroy()
    plain = materialize(sums.dropDuplicates(["k"]), "sums")
    discard(done)
    plain = plain.withColumn("base_score", F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1)))
    out = model.join(plain, "k")
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def broadcasts(shards: DataFrame, buckets: int) -> list[tuple[int, object]]:
    """(first bucket, broadcast Shards) by groups of at most GROUP_BYTES; the
    driver holds one group at a time."""
    sc, out, now, first, size = shards.sparkSession.sparkContext, [], [], 0, 0
    last = -1
    for r in shards.orderBy("bucket").toLocalIterator():
        table = np.frombuffer(r["body"], np.uint8)
        empty = [np.zeros(128, np.uint8)] * (r["bucket"] - last - 1)  # buckets without rows
        if now and size + len(table) > GROUP_BYTES:
            out.append((first, sc.broadcast(Shards(first, now))))
            now, first, size = [], last + 1, 0
        now += [*empty, table]
        size += len(table)
        last = r["bucket"]
    if now:
        out.append((first, sc.broadcast(Shards(first, now + [np.zeros(128, np.uint8)] * (buckets - last - 1)))))
    return out


def held(bc, alone: bool):
    """A callable for a broadcast's value, which is let go again where there are
    several, so that a worker holds one group."""

    def load():
        x = bc.value
        if not alone:
            bc.__dict__.pop("_value", None)
        return x

    return load


def model_scores(rows: DataFrame, groups: list, buckets: int, n: int, v: int, base: float, kind: str) -> DataFrame:
    """(k, _id, held_out, score) of rows, one map pass."""
    start = int(keys_of([END])[0][0])
    worth = value(np.arange(LEVELS), base)

    def slices(batches, text: int):
        """(slice, first tokens, levels of c1, c2, c3 and of both contexts)."""
        filters = [(first, held(bc, len(groups) == 1)) for first, bc in groups]
        known: dict[bytes, int] = {}
        for whole in batches:
            size, j = np.cumsum(pc.binary_length(whole.column(text)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while j < whole.num_rows:
                i, most = j, (size[j - 1] if j else 0) + SLICE_BYTES
                j = min(i + SLICE, max(i + 1, int(np.searchsorted(size, most, side="right"))))
                b = whole.slice(i, j - i)
                texts = [words(x) for x in b.column(text).cast(pa.binary()).to_pylist()]
                new = list({w for ws in texts for w in ws} - known.keys())
                if new:
                    known.update(zip(new, keys_of(new)[0].tolist(), strict=True))
                k = np.array([known[w] for ws in texts for w in ws], np.uint64)
                lengths = np.array([len(ws) for ws in texts])
                begins = np.cumsum(lengths) - lengths
                pair, triple = grams_of(k, begins, start)
                every, back = np.unique(np.concatenate([k, pair, triple, np.array([start], np.uint64)]), return_inverse=True)
                q = np.minimum(probe(every, filters, buckets) if filters else np.zeros(len(every), np.int64), LEVELS - 1)[back]
                q1, q2, q3 = (q[j * len(k) : (j + 1) * len(k)] for j in range(3))
                one, two = np.empty_like(q1), np.zeros_like(q2)  # contexts: the token before, the pair before
                one[1:] = q1[:-1]
                two[1:] = q2[:-1]
                one[begins] = q[-1]
                two[begins] = 0  # a text's first token has no pair before it
                yield b, begins, q1, q2, q3, one, two
                if len(known) > 200_000:
                    known.clear()
        known.clear()
        give_back()

    def run(batches):
        for b, begins, q1, q2, q3, one, two in slices(batches, 3):
            c1, c2, c3, o, t = (worth[q] for q in (q1, q2, q3, one, two))
            # the filter may overstate, so a share never exceeds its context's whole
            p3, p2, p1 = np.minimum(c3, t) / np.maximum(t, 1), np.minimum(c2, o) / np.maximum(o, 1), np.minimum((c1 + 1) / (n + v + 1), 1.0)
            w3, w2 = t / (t + TRUST), o / (o + TRUST)
            p = w3 * p3 + (1 - w3) * (w2 * p2 + (1 - w2) * p1)
            mixed_model, single = np.add.reduceat(np.log10(p), begins), np.add.reduceat(np.log10(p1), begins)
            total = np.maximum(mixed_model, single) + np.log10((1 + 10.0 ** -np.abs(mixed_model - single)) / 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([not x for x in b.column(2).to_pylist()], pa.bool_()), pa.array(total)], names=["k", "_id", "held_out", "score"])

    return rows.mapInArrow(run, f"k long, _id {kind}, held_out boolean, score double")
