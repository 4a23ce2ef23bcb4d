"""Differences of wording: words and lines of two texts, by longest common subsequence."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import SAME

#: Cells of a table that is held at most; larger comparisons are halved until they fit.
CELLS = 4_000_000
_SAME = str.maketrans(dict(zip(*SAME)) | {"œ": "oe"})


def same_word(word: str) -> str:
    """A word without typographic differences."""
    return word.translate(_SAME).lower()


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Equal ends are taken off first; the rest is compared in numpy, whatever its size.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y:
        ids: dict[str, int] = {}
        p = np.array([ids.setdefault(w, len(ids)) for w in x])
        q = np.array([ids.setdefault(w, len(ids)) for w in y])
        pairs += _matched(p, q, head, head)
    return pairs + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _next_row(row: np.ndarray, word: int, q: np.ndarray) -> np.ndarray:
    """From above, diagonally where equal, then the running maximum from the left."""
    return np.maximum.accumulate(np.maximum(row[1:], np.where(q == word, row[:-1] + 1, 0)))


def _lengths(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``p`` and each beginning of ``q``."""
    row = np.zeros(len(q) + 1, np.int32)
    for word in p:
        row[1:] = _next_row(row, word, q)
    return row


def _matched(p: np.ndarray, q: np.ndarray, i0: int, j0: int) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, from ``i0`` and ``j0`` on.

    Where the table would be too large, ``p`` is halved and ``q`` cut where the halves have
    most in common, which loses nothing and holds a row at a time.
    """
    if not len(p) or not len(q):
        return []
    if len(p) > 1 and len(p) * len(q) > CELLS:
        half = len(p) // 2
        cut = int(np.argmax(_lengths(p[:half], q) + _lengths(p[half:][::-1], q[::-1])[::-1]))
        return _matched(p[:half], q[:cut], i0, j0) + _matched(p[half:], q[cut:], i0 + half, j0 + cut)
    table = np.zeros((len(p) + 1, len(q) + 1), np.int32)
    for i in range(len(p)):
        table[i + 1, 1:] = _next_row(table[i], p[i], q)
    i, j, found = len(p), len(q), []
    while i and j:
        if p[i - 1] == q[j - 1]:
            found.append((i0 + i - 1, j0 + j - 1))
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def word_diff(old: str, new: str) -> list[tuple[str, str]]:
    """``(kind, word)`` in order: ``=`` kept, ``-`` removed, ``+`` added; by the same rule at any size."""
    a, b = re.findall(r"\S+", old), re.findall(r"\S+", new)
    out, i, j = [], 0, 0
    for x, y in [*common([same_word(w) for w in a], [same_word(w) for w in b]), (len(a), len(b))]:
        out += [("-", w) for w in a[i:x]] + [("+", w) for w in b[j:y]]
        if x < len(a) and y < len(b):
            out.append(("=", b[y]))
        i, j = x + 1, y + 1
    return out


def line_diff(old: str, new: str) -> list[tuple[str, str]]:
    a, b = old.splitlines(), new.splitlines()
    out, i, j = [], 0, 0
    for x, y in [*common(a, b), (len(a), len(b))]:
        out += [("-", w) for w in a[i:x]] + [("+", w) for w in b[j:y]]
        if x < len(a) and y < len(b):
            out.append(("=", b[y]))
        i, j = x + 1, y + 1
    return out


def wording_changes(diff: DataFrame, texts: DataFrame) -> DataFrame:
    """Words kept, removed and added in each changed anchor of a version diff.

    Each distinct pair of texts is compared once, however many versions show it.
    """
    pairs = diff.where("state = 'changed'").select("from_sha", "to_sha").distinct()
    old = texts.select(F.col("text_sha").alias("from_sha"), F.col("text").alias("old"))
    new = texts.select(F.col("text_sha").alias("to_sha"), F.col("text").alias("new"))
    both = pairs.join(old, "from_sha").join(new, "to_sha")

    @F.pandas_udf("struct<kept:long,removed:long,added:long>")
    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            kinds = [k for k, _ in word_diff(x, y)]
            rows.append((kinds.count("="), kinds.count("-"), kinds.count("+")))
        return pd.DataFrame(rows, columns=["kept", "removed", "added"])

    return both.select("from_sha", "to_sha", count("old", "new").alias("c")).select("from_sha", "to_sha", "c.*")
