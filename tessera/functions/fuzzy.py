"""Fuzzy string kernels for which Spark has no function; one Arrow call scores all of a pair's strings."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

#: Strings whose sorted words a worker remembers: a record stands in many pairs.
REMEMBERED = 1 << 14


def _places(a: str) -> dict[str, int]:
    """Positions of each character, as bits of one number."""
    at: dict[str, int] = {}
    bit = 1
    for c in a:
        at[c] = at.get(c, 0) | bit
        bit <<= 1
    return at


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; rows of the table are bits of one number."""
    if a == b:
        return len(a)
    if len(a) < len(b):  # fewer steps over the shorter one
        a, b = b, a
    at = _places(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if hit := row & at.get(c, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


@lru_cache(maxsize=REMEMBERED)
def _sorted_words(x: str) -> str:
    return " ".join(sorted(x.split()))


@lru_cache(maxsize=REMEMBERED)
def _words(x: str) -> frozenset[str]:
    return frozenset(x.split())


def token_sort(a: str, b: str) -> float:
    return ratio(_sorted_words(a), _sorted_words(b))


def token_set(a: str, b: str) -> float:
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 1.0
    if not both:
        return ratio(left, right)
    one, two = f"{both} {left}", f"{both} {right}"
    shared = len(both) + 1 + common_subsequence(left, right)
    return max(2 * shared / (len(one) + len(two)), 2 * len(both) / (len(both) + len(one)), 2 * len(both) / (len(both) + len(two)))


def jaro_winkler(a: str, b: str) -> float:
    """Characters match within a window around their place; free places of b are bits of one number."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    at, free, mine = _places(b), (1 << len(b)) - 1, []
    window = (1 << min(reach + 1, len(b))) - 1  # places 0 to reach
    for i, c in enumerate(a):
        if hit := at.get(c, 0) & free & window:
            free ^= hit & -hit
            mine.append(c)
        window = window << 1 | (1 if i < reach else 0)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for j, c in enumerate(b) if not free >> j & 1]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


_KERNELS = {"sort": token_sort, "set": token_set, "jw": jaro_winkler}


@lru_cache(maxsize=8)
def _kernels(names: tuple[str, ...]):
    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def kernels(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple[float, ...]] = {}
        chosen = [_KERNELS[n] for n in names]
        rows = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            got = known.get(pair)
            if got is None:
                got = known[pair] = tuple(f(*pair) for f in chosen)
            rows.append(got)
        return pd.DataFrame(rows, columns=list(names))

    return kernels


def similarities(a, b, *names: str):
    """Struct of the named scores (sort, set, jw; all by default) of two string columns; equal pairs of a batch are scored once."""
    return _kernels(names or tuple(_KERNELS))(a, b)


def levenshtein_norm(a, b):
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
