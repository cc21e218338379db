"""Secret scans: pattern rules, plus a token-efficiency test for random strings.

A random string costs many tokens for its length.  Runs of key-like characters
whose characters-per-token ratio under a tiktoken vocabulary is low are
reported, unless they are known digests (hex of a digest's length, or listed by
the caller), UUIDs, numbers, or identifiers made of words.

Cases: a null text is empty and gives no span; a null doc_id is kept as null;
repeated rows give repeated results; further columns of the input are ignored
by scan_secrets() and kept by redact(); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs that are long enough for a key; every access or hex finding lies in one.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORDY = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_/](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")
#: Lengths of hex digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    import public_tokenizers

    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def is_random(run: str, path: str, ratio: float, known: frozenset[str] = frozenset()) -> bool:
    """True for a run whose characters per token are below ratio, digests and
    identifiers excluded."""
    s = run.strip("=-_/+")
    if s.lower() in known or len(s) < 20 or s.isdigit() or UUID.fullmatch(s) or WORDY.fullmatch(s):
        return False
    if len(s) in DIGESTS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        return False
    if not re.search("[A-Za-z]", s):
        return False
    return len(s) / len(encoding(path).encode_ordinary(s)) < ratio


def find_spans(raw: bytes, path: str, ratio: float = 2.0, known: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """(start, end, index into KINDS), sorted, in code points of the whole text."""
    text, out = raw.decode("utf-8", "replace"), []
    low = raw.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    for run in RUN.finditer(text):
        a, b = run.span()
        if "AKIA" in run[0]:
            out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20]
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    # a sweep: runs and the reach of the base spans that begin before a run's end
    base, i, reach = sorted(out), 0, -1
    for run in RUN.finditer(text):
        a, b = run.span()
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][1])
            i += 1
        if reach <= a and is_random(run[0], path, ratio, known):
            out.append((a, b, 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ratio: float = 2.0, vocabulary: str | None = None, known: Iterable[str] = ()) -> DataFrame:
    """One row per document: counts by kind, the base spans' digest, all spans.
    known: digests and keys that are no secrets (a list that fits a task)."""
    path, known = vocabulary or vocabulary_path(), frozenset(x.lower() for x in known)

    def work(texts, ids):
        counts, shas, spans = [], [], []
        for t in texts:
            found = find_spans(t, path, ratio, known)
            said = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in xs)
            counts.append([sum(k == n for *_, k in found) for n in range(4)])
            shas.append(hashlib.sha256(said([x for x in found if x[2] < 3]).encode()).hexdigest())
            spans.append(said(found))
        return [ids, *[[c[n] for c in counts] for n in range(3)], shas, spans, [c[3] for c in counts]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, [id_col], f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long", work, text)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", ratio: float = 2.0, vocabulary: str | None = None, known: Iterable[str] = ()) -> DataFrame:
    """docs with every found span replaced by mask; rows and columns stay.
    n_chars, where it exists, counts the new text."""
    path, known = vocabulary or vocabulary_path(), frozenset(x.lower() for x in known)
    rest, mark = [c for c in docs.columns if c != text], fresh(docs, "_had")

    def work(texts, had, *cols):
        new = []
        for t, h in zip(texts, had, strict=True):
            s, parts, at = t.decode("utf-8", "replace"), [], 0
            for a, b, _ in find_spans(t, path, ratio, known):
                if b > at:
                    parts += [s[at : max(a, at)], mask if a >= at else ""]
                    at = b
            new.append("".join([*parts, s[at:]]) if h else None)
        return [*cols, new]

    marked = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").isNotNull().alias(mark), F.col(f"`{text}`"))
    from pyspark.sql.types import StructType

    schema = StructType([docs.schema[c] for c in rest] + [docs.schema[text]])
    order = [mark, *rest]
    out = map_texts(marked, order, schema, work, text)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
