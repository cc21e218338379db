"""Best-fit decreasing packing of token sequences.

Documents become token ids with an end id; longer ones than the capacity are
cut.  Best-fit decreasing takes lengths from the longest to the shortest and
puts each into the open bin with the least room that still holds it, found by a
segment tree over remaining capacities in logarithmic time.  Pieces of one
length are interchangeable, and so are bins with one history: the packing of a
whole corpus is planned from the histogram of lengths (capacity entries), as
groups of identical bins.  Pieces are numbered within their length, without
gathering a length in one task, and each looks up its group, bin and offset.

Cases: a null text is empty (its only id is the end id); a null doc_id is kept;
repeated rows are packed once each; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import map_texts, materialize

#: Words whose ids a worker keeps; forgotten and begun anew beyond that.
CACHE_WORDS = 300_000
#: Marks after a word that are pieces of their own.
MARKS = (b".", b",", b";", b":", b"!", b"?")


def lowered(s: str) -> str:
    """Lower case, character by character (a final sigma is like any other)."""
    return "".join([c.lower() for c in s]) if "\u03a3" in s else s.lower()


class WordTokenizer:
    """The ids of the vocabulary file, worked out once per distinct word.

    The file's normaliser and splitter never join what ASCII white space
    separates, so a text's ids are those of its words in order.  Words are
    merged by a tiktoken core over the same vocabulary, with byte FF for the
    word-end mark (no UTF-8 text holds it); what the core may not see the same
    way (anything but letters, digits and ASCII marks) goes to the file's own
    tokenizer.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                end = token.endswith("</w>") and token != "</w>"
                ranks[bytes(table[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = i
        ranks.setdefault(b"\xff", 1 << 30)
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.simple = regex.compile(r"[\p{L}\p{N}!-/:-@\[-`{-~]+").fullmatch
        self.cache: dict[bytes, bytes] = {}

    def word(self, w: bytes) -> bytes:
        if w.isalpha():  # ASCII letters only
            return array("I", self.core.encode_single_piece(w.lower() + b"\xff")).tobytes()
        if w[-1:] in MARKS and w[:-1].isalpha():
            return array("I", self.core.encode_single_piece(w[:-1].lower() + b"\xff") + self.core.encode_single_piece(w[-1:] + b"\xff")).tobytes()
        s = w.decode("utf-8", "replace")
        if s.isalpha() and unicodedata.is_normalized("NFC", s) and (low := lowered(s)).isalpha():
            return array("I", self.core.encode_single_piece(low.encode() + b"\xff")).tobytes()
        if not self.simple(s) or "<|" in s:
            ids = self.own.encode(s, add_special_tokens=False).ids
        else:
            s = lowered(unicodedata.normalize("NFC", s))
            ids = [i for p in self.split(s) for i in self.core.encode_single_piece(p.encode() + b"\xff")]
        return array("I", ids).tobytes()

    def ids(self, raw: bytes) -> bytes:
        """All ids of a whole text as little-endian 32-bit integers."""
        words, cache = raw.split(), self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            for w in set(words):
                if w not in cache:
                    cache[w] = self.word(w)
            return b"".join([cache[w] for w in words])


@lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Capacities:
    """A segment tree over remaining capacities 0..size: how many open bins have
    each, and the least capacity of at least so much that one has."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.tree = np.zeros(2 * self.base, np.int64).tolist()

    def add(self, at: int, n: int) -> None:
        i = at + self.base
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, least: int) -> int:
        """The least capacity >= least with an open bin, or -1."""
        i, tree = least + self.base, self.tree
        if tree[i]:
            return least
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over {length: pieces}.  Returns (length, first rank,
    last rank + 1, first bin, offset): the pieces of that length with those ranks
    lie in consecutive bins at that offset.  Bins of one group are alike; a group
    splits only where pieces of a length run out, so the plan depends on the
    capacity, not on the number of documents."""
    room, groups, out = Capacities(capacity), defaultdict(list), []  # groups: capacity left -> (first bin, bins)
    bins = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = room.tightest(length)
            if at < 0:
                # as many pieces to a new bin as best fit would go on to put there
                per = capacity // length
                n = max(1, left // per)
                groups[capacity].append((bins, n))
                room.add(capacity, n)
                bins += n
                at = capacity
            first, n = groups[at].pop()
            per = at // length
            use = min(n, left // per)
            if not use:
                per, use = left, 1
            for slot in range(per):
                out.append((length, rank + slot * use, rank + (slot + 1) * use, first, capacity - at + slot * length))
            rank, left = rank + per * use, left - per * use
            room.add(at, -use)
            room.add(at - per * length, use)
            groups[at - per * length].append((first, use))
            if n > use:
                groups[at].append((first + use, n - use))
    return out


def pieces(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text: str = "text", end_id: int = 0, order: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, _part, _rank, _at): every document's
    pieces; _rank counts those of a length within the task's partition; _at is the
    document's place in the order, if there is one."""
    end = np.array([end_id], "<u4").tobytes()

    def work(texts, ids, places=None):
        seen = work.__dict__.setdefault("seen", {})
        part = TaskContext.get().partitionId()
        if work.__dict__.setdefault("part", part) != part:
            seen.clear()
            work.part = part
        out = [[] for _ in range(8)]
        enc = tokenizer(path)
        for t, i, at in zip(texts, ids, places or [None] * len(ids), strict=True):
            raw = enc.ids(t) + end
            for k in range(0, len(raw), 4 * capacity):
                piece = raw[k : k + 4 * capacity]
                n = len(piece) // 4
                seen[n] = seen.get(n, -1) + 1
                for column, x in zip(out, (i, k // (4 * capacity), k // 4, n, zlib.crc32(piece), part, seen[n], at), strict=True):
                    column.append(x)
        return out

    names = (("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType()), ("_part", IntegerType()), ("_rank", LongType()), ("_at", LongType()))
    return map_texts(docs, [id_col, *([order] if order else [])], StructType([StructField("_id", docs.schema[id_col].dataType), *[StructField(n, t) for n, t in names]]), work, text)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text: str = "text", end_id: int = 0, order: str | None = None) -> DataFrame:
    """One row per piece: where it comes from, and its sequence and offset.
    order: a column of different longs; pieces of one length are then taken in
    that order, task by task, and a sequence is numbered by its first document's
    place, so sequences read by number follow the order."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    cut = materialize(pieces(docs, path, capacity, id_col, text, end_id, order), "pieces")
    sizes = materialize(cut.groupBy("length", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), "lengths")
    # capacity rows at most come to the driver
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}
    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("_first", "_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rows = np.array(plan(histogram, capacity) or [(0, 0, 0, 0, 0)], np.int64)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def place(batches):
        table = shared.value
        firsts = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for pdf in batches:
            n, rank = pdf["length"].to_numpy(), (pdf["_rank"] + pdf["_base"]).to_numpy()
            at = np.empty(len(n), np.int64)
            for length in np.unique(n):
                own, (a, b) = n == length, firsts[[length, length + 1]]
                at[own] = a + np.searchsorted(table[a:b, 1], rank[own], side="right") - 1
            pdf["sequence_id"] = table[at, 3] + rank - table[at, 1]
            pdf["offset"] = table[at, 4]
            yield pdf.drop(columns=["_part", "_rank", "_base"])

    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("_id", kind), StructField("piece", IntegerType()), *[StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "_at", "sequence_id", "offset")]])
    # as many rows as lengths and tasks: a join by key, not a broadcast that grows with both
    joined = cut.join(bases.hint("merge"), ["length", "_part"]).select("_id", "piece", "start", "length", "ids_crc32", "_at", "_part", "_rank", "_base")
    placed = joined.mapInPandas(place, schema)
    if order:
        placed = materialize(placed, "placed")
        number = placed.groupBy("sequence_id").agg(F.min(F.struct("_at", "piece")).alias("_f"))
        # a document has fewer than 2**20 pieces of a sequence's length
        placed = placed.join(number, "sequence_id").withColumn("sequence_id", F.shiftleft(F.col("_f._at"), 20) + F.col("_f.piece"))
    return placed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
