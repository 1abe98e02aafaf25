"""Similarity of strings, 0..100, by the longest common subsequence, and what is built on it.

Built from the public definitions: the plain ratio, its best partial window, both over sorted or compared word sets, and
the weighted ratio that takes the best of them scaled by how different the lengths are. Columns are Arrow UDFs.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.text import content_tokens


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << k)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Best ratio of the shorter string with a window of the longer one; windows may run over its ends.

    The letters that a window shares with the shorter string, in any order, are counted as the window moves; only
    windows whose count allows for a better ratio than the best so far are measured. A ratio below `least` may come out
    as any other below it.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best, own = len(a), max(0.0, least - 1e-6), Counter(a)
    held: Counter = Counter()
    shared = 0
    for start in range(1 - n, len(b)):
        end = start + n
        if end <= len(b):  # a letter comes in
            c = b[end - 1]
            held[c] += 1
            shared += held[c] <= own[c]
        if start > 0:  # and one leaves
            c = b[start - 1]
            shared -= held[c] <= own[c]
            held[c] -= 1
        w = b[max(0, start) : end]
        # a window that starts or ends outside the shorter string's letters is beaten by its neighbour
        if w and 200.0 * shared > best * (n + len(w)) and (w[-1] in own if end <= len(b) else w[0] in own):
            best = max(best, ratio(a, w))
            if best == 100.0:
                break
    return best


def _sorted(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base = " ".join(both)
    one, two = " ".join([*both, *left]), " ".join([*both, *right])
    scores = [ratio(one, two)]
    if both:
        scores += [ratio(base, one), ratio(base, two)]
    return max(scores)


def partial_token_ratio(a: str, b: str, least: float = 0.0) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b), least), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x)), least))


def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The weighted ratio; one below `least` may come out as any other below it."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    best = max(best, 0.95 * scale * partial_token_ratio(a, b, least / (0.95 * scale)))
    return max(best, scale * partial_ratio(a, b, max(least, best) / scale))


def _column(f, a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def ratio_col(a: Column, b: Column) -> Column:
    return _column(ratio, a, b)


def token_set_ratio_col(a: Column, b: Column) -> Column:
    return _column(token_set_ratio, a, b)


def weighted_ratio_col(a: Column, b: Column) -> Column:
    return _column(weighted_ratio, a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length: a built-in stand-in that SQL can check; not the same measure as the ratios."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def name_score(query_key: str, title_key: Column, title: Column, base: Column, query_words: list[str]) -> Column:
    """How well a title answers a query, from a base similarity 0..1.

    Equal keys add 0.5, a title that begins with the query adds 0.15; else the base is damped by how much of the query's
    length and of its content words the title covers. An empty query key never counts as a beginning.
    """
    q = F.lit(query_key)
    covered = F.least(F.lit(1.0), F.length(title_key) / F.lit(max(len(query_key), 1)))
    have = content_tokens(title)
    shared = sum((F.array_contains(have, w).cast("int") for w in query_words), F.lit(0))
    words = shared / F.lit(len(query_words)) if query_words else F.lit(1.0)
    damped = base * (0.4 + 0.6 * covered) * (0.2 + 0.8 * words)
    begins = F.startswith(title_key, q) if query_key else F.lit(False)
    return F.when(title_key == q, base + 0.5).when(begins, base + 0.15).otherwise(damped)
