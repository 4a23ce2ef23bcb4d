"""Words of texts as 64-bit hashes, for fingerprints of shared passages."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+").findall
_MARKS = re.compile("[̀-ͯ­​-‏⁠-⁤﻿]+")


def fold(text: str) -> str:
    """Lower case without accents and invisible characters.

    Canonical decomposition, combining marks and format characters (soft hyphen, zero-width
    characters and the like) removed, then case folding.
    """
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFD", text)
    text = _MARKS.sub("", text)
    if not text.isascii():
        rare = {c for c in set(text) if c > "\x7f" and unicodedata.category(c) in ("Mn", "Cf")}
        if rare:
            text = text.translate(dict.fromkeys(map(ord, rare)))
        # folding can decompose again (dotted capital i)
        folded = text.casefold()
        return folded if folded.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", folded))
    return text.lower()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the folded text; none for null."""
    return _WORD(fold(text)) if text else []


class WordHashes:
    """64-bit hashes of words, remembered for the words met so far."""

    #: Distinct words remembered; beyond it the memory is emptied, which costs time only.
    REMEMBERED = 1_000_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.REMEMBERED:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each position on; shorter than ``h`` by ``k - 1``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each ``window`` adjacent ones, the rightmost of equals.

    Two sequences that share ``window`` adjacent grams select the same gram of that share.
    A sequence of fewer grams than a window selects its least one.
    """
    n = len(g) - window + 1
    if n <= 0:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))]) if len(g) else np.zeros(0, np.int64)
    least, at = g[:n].copy(), np.arange(n)
    for i in range(1, window):
        other = g[i : i + n]
        better = other <= least
        least[better] = other[better]
        at[better] = (np.arange(n) + i)[better]
    return np.unique(at)
