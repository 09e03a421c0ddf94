"""Similarity of values and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix padded with zeros, and lengths."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    flat = np.frombuffer("".join(v.ljust(width, "\0") for v in values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat.reshape(len(values), width), sizes


def jaro_winkler_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of value pairs, all pairs at once, one step for each position of the left values.

    Characters match when equal and at most max(lengths) // 2 - 1 apart, each to the first free partner. A common prefix of up to
    four adds a tenth of the rest each, where the Jaro similarity is above 0.7. Two empty values are alike, an empty and another aren't.
    """
    a, na = _codes(left)
    b, nb = _codes(right)
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    used, hit = np.zeros((n, wb), bool), np.zeros((n, wa), bool)
    at = np.arange(wb)
    for i in range(wa if wb else 0):
        free = (b == a[:, i : i + 1]) & ~used & (np.abs(at - i)[None, :] <= reach[:, None]) & (at[None, :] < nb[:, None])
        free &= (i < na)[:, None]
        found = free.any(axis=1)
        rows = np.flatnonzero(found)
        used[rows, free[rows].argmax(axis=1)] = True
        hit[rows, i] = True
    m = hit.sum(axis=1)
    # The matched characters of both, in order, side by side.
    pick = lambda x, mask, k: np.where(np.arange(k)[None, :] < m[:, None], np.take_along_axis(x, np.argsort(~mask, axis=1, kind="stable")[:, :k], axis=1), 0)
    k = int(m.max()) if n else 0
    swaps = (pick(a, hit, k) != pick(b, used, k)).sum(axis=1) // 2 if k else np.zeros(n, np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / na + m / nb + (m - swaps) / m) / 3, 0.0)
    jaro = np.where((na == 0) & (nb == 0), 1.0, jaro)
    width = min(4, wa, wb)
    same = (a[:, :width] == b[:, :width]) & (np.arange(width)[None, :] < np.minimum(na, nb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1) if width else 0
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winkler(left: Column, right: Column) -> Column:
    """Jaro-Winkler similarity as a column (an Arrow UDF; Spark has no built-in for it). A null counts as empty.

    It isn't one over iterators of batches: Spark gives each of those a Python worker of its own, so a row of five columns took five for each task.
    """

    @F.pandas_udf("double")
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_distinct(a.fillna("").tolist(), b.fillna("").tolist()))

    return pairs(left, right)


def jaro_winkler_distinct(left: list[str], right: list[str]) -> np.ndarray:
    """As ``jaro_winkler_pairs``; repeated pairs are computed once, and long values apart from short ones."""
    pairs = list(zip(left, right, strict=True))
    index = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
    todo = sorted(index, key=lambda p: max(len(p[0]), len(p[1])))
    out = np.zeros(len(todo))
    for lo in range(0, len(todo), 4096):
        part = todo[lo : lo + 4096]
        out[[index[p] for p in part]] = jaro_winkler_pairs([p[0] for p in part], [p[1] for p in part])
    return out[[index[p] for p in pairs]] if pairs else np.zeros(0)


def normalized_levenshtein(left: Column, right: Column) -> Column:
    """One less edit distance over the greater length; two empty values are alike."""
    longest = F.greatest(F.char_length(left), F.char_length(right))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(left, right) / longest)


def value_similarity(left: Column, right: Column) -> Column:
    """Raw values: Jaro-Winkler where both have up to 20 bytes, else normalised edit distance."""
    short = (F.octet_length(left) <= 20) & (F.octet_length(right) <= 20)
    return F.when(short, jaro_winkler(left, right)).otherwise(normalized_levenshtein(left, right))


def edit_distance(a: str, b: str) -> int:
    """Edit distance with two rows of the table, a row at a time in numpy."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    row, step = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        row = np.minimum.accumulate(new - step) + step  # insertions run along the row
    return int(row[-1])
