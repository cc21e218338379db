"""String and set similarities.  Expressions where Spark has them; Arrow UDFs
over distinct pairs for indel, token-set, partial and Jaro-Winkler ratios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def kept(a: str, b: str) -> int:
    """lcs(): what both begin or end with is in it."""
    n, i = min(len(a), len(b)), 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return i + j + (lcs(x, y) if x and y else 0)


def indel(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * kept(a, b) / n


def sorted_ratio(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(sorted(z)) for z in (x - y, y - x))
    if not both:
        return max(indel(left, right), 0.0)
    # the words of both sides begin both strings: only the others are compared
    k = len(both)
    m, n = k + 1 + len(left), k + 1 + len(right)
    return max(200.0 * (k + 1 + kept(left, right)) / (m + n), 200.0 * k / (k + m), 200.0 * k / (k + n))


def prefix_lcs(where: dict[str, int], n: int, b: str) -> list[int]:
    """lcs() of a string of n characters, given by where each is, with b[:1], b[:2], ..."""
    full = (1 << n) - 1
    v, out = full, []
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
        out.append(n - v.bit_count())
    return out


def places(a: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one.
    Windows at the ends of b are prefixes of b, or of b reversed: one pass each.
    Whole windows next to each other differ by one at most, so those that cannot
    reach the best are passed over."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    where = places(a)
    head, tail = prefix_lcs(where, n, b[:n]), prefix_lcs(places(a[::-1]), n, b[: -n - 1 : -1])
    best = max(200.0 * x / (n + k) for side in (head, tail) for k, x in enumerate(side, 1))
    i = 0
    while i <= len(b) - n and best < 100.0:
        found = prefix_lcs(where, n, b[i : i + n])[-1]
        best = max(best, 200.0 * found / (n + n))
        i += max(1, int(best * n / 100 + 1e-9) + 1 - found)
    return best


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach, hit, m = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit[j] and b[j] == ch:
                hit[j] = True
                m.append(ch)
                break
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(m, (ch for ch, h in zip(b, hit, strict=True) if h), strict=True)) // 2
    jaro = (len(m) / len(a) + len(m) / len(b) + (len(m) - swaps) / len(m)) / 3
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return jaro + lead * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _udf(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict = {}
        return pd.Series([seen[k] if k in seen else seen.setdefault(k, f(*k)) for k in zip(a.fillna(""), b.fillna(""), strict=True)], dtype=float)

    return run


indel_ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler_ratio = map(_udf, (indel, sorted_ratio, set_ratio, partial, jaro_winkler))


def tri_state(a: Column, b: Column) -> Column:
    """1 overlap, -1 conflict, 0 if either side is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(F.arrays_overlap(a, b), 1).otherwise(-1)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def number_close(a: Column, b: Column) -> Column:
    """1 equal, .8 one begins or ends the other (two digits each), .6 within 10."""
    nine = lambda x: F.substring(x, 1, 9).cast("long")
    part = (F.length(a) >= 2) & (F.length(b) >= 2) & (a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a))
    return F.when(a == b, 1.0).when(part, 0.8).when(F.abs(nine(a) - nine(b)) <= 10, 0.6).otherwise(0.0)


def number_cover(a: Column, b: Column) -> Column:
    """Mean over a's numbers of the best closeness in b; -1 if a side is empty."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: number_close(x, y))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), -1.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def house_one_digit(a: Column, b: Column) -> Column:
    """1 if equal length and exactly one digit differs, -1 if one is missing."""
    differ = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))
    return F.when((a == "") | (b == ""), -1).when((F.length(a) == F.length(b)) & (differ == 1), 1).otherwise(0)


def acronym_hit(acr_a: Column, name_a: Column, acr_b: Column, name_b: Column) -> Column:
    """1 if one side's acronym is the other side's name without spaces; the
    first side's acronym needs two letters."""
    glued = lambda c: F.regexp_replace(c, " ", "")
    return ((F.length(acr_a) > 1) & ((acr_a == glued(name_b)) | (acr_b == glued(name_a)))).cast("int")


def house_features(house: Column, mine: Column, nums: Column, theirs: Column) -> dict[str, Column]:
    """A reference house number against a record's numbers (nums) and house
    (theirs); mine: the reference's numbers.  -1 where a side is empty."""
    there = (F.size(mine) > 0) & (F.size(nums) > 0) & (house != "")
    nine = lambda c: F.substring(c, 1, 9).cast("long")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(house), F.lit(1))), lambda i: F.concat(F.substring(house, F.lit(1), i - 1), F.substring(house, i + 1, F.length(house))))
    shorter = F.exists(nums, lambda y: (F.length(y) == F.length(house) - 1) & F.array_contains(cut, y))
    made = {
        "house_close": F.array_max(F.transform(nums, lambda y: number_close(house, y))),
        "house_eq": F.array_contains(nums, house).cast("int"),
        "house_diff": F.log1p(F.array_min(F.transform(nums, lambda y: F.abs(nine(house) - nine(y))))),
        "house_drop": shorter.cast("int"),
        "house_first": F.when(theirs != "", (theirs == house).cast("int")).otherwise(-1),
    }
    return {k: F.when(there, v).otherwise(-1) for k, v in made.items()}
