"""Pages of repeated keywords, link lists, tags and product listings."""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import fold

#: Share of a page's words that must be spam, and how often a substring must occur to count.
SHARE, TIMES = 0.5, 3
#: Words between repeated ones that belong to the same list at most.
VARYING = 3
#: Words of a clause at least, and for each link that stands in it.
CLAUSE_WORDS, LINK_WORDS = 5, 8
#: Letters of a short word, words of a clause for each of its short words at most, and words
#: from which on a clause has short words of two kinds.
SHORT, PER_SHORT, TWO_KINDS = 3, 8, 16
#: Share of a clause's words that differ from each other at least, and of those with digits at most.
DIFFERENT, DIGITS = 0.55, 0.25
#: Words between two separators of a segment of so many words on average at least.
UNIT, LONG = 5, 40
#: Words of a text without breaks up to which its different words grow.
GROWS = 150

_INVISIBLE = re.compile("[\x02\x03­​-‏⁠-⁤﻿]+")
_ANCHOR = re.compile(r"<a\b[^>]*?href\s*=\s*[\"']?([^\"'>\s]*)[^>]*>(.*?)</a\s*>", re.I | re.S)
_MARKED = re.compile(r"!?\[([^\]\n]*)\]\(([^)\s]*)\)")
_MARKUP = re.compile(r"<[/!a-zA-Z][^<>\n]*>")
_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_BREAK = re.compile(r"[\r\n]+|(?<=[.!?;])(?<!\.\.)[ \t]+")
_TOKEN = re.compile(r"(?:https?://|www\.)\S+|#\w[\w'’]*|[^\W_]+", re.I)
_SEPARATOR = re.compile(r"[,;:/|·•=>()]|\s[-–—*]\s")
#: A link with its label, as ``spam_share`` marks it; sentences of a label may part it.
_LINKED = re.compile("\x02[^\x02\x03]*\x03?|[^\x02\x03]*\x03")
#: Rows of tables, and dates as lists of acts have them.
_TABLE = re.compile(r"\s*\|.*\|\s*\Z")
_ACT = re.compile(r"\b\d{4}-\d\d-\d\d\b|\b\d{1,2}\.? \w+ \d{4}\b")


def suffix_coverage(symbols: list[int], times: int = TIMES) -> list[bool]:
    """Which symbols lie in a substring that occurs at least ``times`` times.

    The suffix automaton of the sequence is built online; the number of occurrences of each
    state's substrings comes up along the suffix links.  At each position the longest
    suffix that is repeated often enough is the repeated substring that is maximal there.
    States lie in arrays; only those with several edges have a table of them.
    """
    most = 2 * len(symbols) + 2
    length, link, count, to = (array("i", bytes(4 * most)) for _ in range(4))
    symbol = array("q", bytes(8 * most))
    many: dict[int, dict[int, int]] = {0: {}}
    link[0], size, last = -1, 1, 0
    at = array("i", bytes(4 * len(symbols)))
    for i, s in enumerate(symbols):
        new, size = size, size + 1
        length[new], count[new] = length[last] + 1, 1
        p, q = last, 0
        # an edge leads to a state other than the first, so that 0 is none
        while p >= 0:
            own = many.get(p)
            if own is None:
                q = to[p] if symbol[p] == s else 0
                if q:
                    break
                if to[p]:
                    many[p] = {symbol[p]: to[p], s: new}
                else:
                    symbol[p], to[p] = s, new
            else:
                q = own.get(s, 0)
                if q:
                    break
                own[s] = new
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy, size = size, size + 1
                length[copy], link[copy], symbol[copy], to[copy] = length[p] + 1, link[q], symbol[q], to[q]
                if q in many:
                    many[copy] = dict(many[q])
                while p >= 0:
                    own = many.get(p)
                    if own is None:
                        if symbol[p] != s or to[p] != q:
                            break
                        to[p] = copy
                    elif own.get(s) == q:
                        own[s] = copy
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = copy
        last = new
        at[i] = new
    order = np.argsort(-np.frombuffer(length, np.int32)[:size], kind="stable")[: size - 1].tolist()
    for v in order:
        if link[v] >= 0:
            count[link[v]] += count[v]
    repeated = to
    repeated[0] = 0
    for v in reversed(order):
        repeated[v] = length[v] if count[v] >= times else repeated[link[v]]
    covered, reach = [False] * len(symbols), 0
    for i in range(len(symbols) - 1, -1, -1):
        reach = max(reach, repeated[at[i]])
        covered[i] = reach > 0
        reach -= reach > 0
    return covered


def _is_clause(words: list[str], segment: str, links: int = 0) -> bool:
    """Whether the words of a segment are running text, in whatever language.

    Running text says few words twice and joins its nouns by short words of several kinds;
    lists of phrases, tags and products repeat their words, lack short ones or are full of
    numbers.
    """
    n = len(words)
    if n < max(CLAUSE_WORDS, LINK_WORDS * links):
        return False
    # what stands between separators in a long list are names and phrases of a few words
    if n >= LONG and n < UNIT * (1 + len(_SEPARATOR.findall(segment))):
        return False
    kinds = set(words)
    if len(kinds) < DIFFERENT * min(n, GROWS):
        return False
    short = {w for w in kinds if len(w) <= SHORT and w.isalpha()}
    if len(short) < 1 + (n >= TWO_KINDS) or sum(map(short.__contains__, words)) * PER_SHORT < n:
        return False
    return sum(not w.isalpha() for w in words) <= DIGITS * n


def _numbered(heads: list[int | None]) -> list[bool]:
    """Which of the leading numbers of segments count on from the one before or to the one after."""
    out = [False] * len(heads)
    before = None
    for i, n in enumerate(heads):
        if n is None:
            continue
        if before is not None and heads[before] <= n <= heads[before] + 1:
            out[before] = out[i] = True
        before = i
    return out


_ROMAN = re.compile(r"(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\Z")
_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _head(found: list[str]) -> int | None:
    """The number among the first two words of a segment, Arabic or Roman."""
    for w in found[:2]:
        if w.isdecimal() and len(w) < 6:
            return int(w)
        if _ROMAN.match(w):
            values = [_VALUES[c] for c in w]
            return sum(-a if a < b else a for a, b in zip(values, [*values[1:], 0]))
    return None


def _is_url(token: str) -> bool:
    return token.startswith(("http://", "https://", "www."))


def _shape(token: str) -> str:
    """A token as a symbol: links, tags, amounts and codes are each one symbol."""
    if token[0] == "#":
        return "#"
    if _is_url(token):
        return "://"
    digits = sum(map(str.isdigit, token))
    return token if not digits else "0" if digits == len(token) else "a0"


def spam_share(text: str | None, times: int = TIMES) -> float:
    """The share of a page's words that are spam; 0 for null, empty and wordless texts.

    Segments (lines, and sentences of a line) that are running text are set aside, and so
    are rows of tables, dated acts and entries whose numbers count on (contents, articles),
    unless they hold links; of running text with links only the links with their labels are
    not set aside.  If these make up half of the words, the page is no case whatever the
    rest is.  Otherwise the automaton of the other words tells which of them belong to
    repeated maximal substrings; links with their labels, tags and up to ``VARYING`` words
    between repeated ones belong to the list that they stand in.
    """
    if not text:
        return 0.0
    if "&" in text:
        text = html.unescape(text)
    text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _MARKUP.sub(" ", _ANCHOR.sub(r" [\2](\1) ", text))
    if "](" in text:
        text = _MARKED.sub(" \x02\\1 https://\\2 \x03 ", text)
    total, lone = 0, []
    segments: list[tuple[str, list[str], bool]] = []
    for segment in _BREAK.split(text):
        folded = fold(segment)
        found = _TOKEN.findall(folded)
        if not found:
            continue
        total += len(found)
        if len(found) == 1 and _head(found) is not None:
            lone += found  # the number of the entry that follows
            continue
        if lone:
            found, lone = lone + found, []
        link = "http" in folded or "www." in folded
        if link:
            plain = [t for t in _TOKEN.findall(_LINKED.sub(" ", folded)) if t[0] != "#" and not _is_url(t)]
            urls = sum(map(_is_url, found))
            if _is_clause(plain, "", urls):
                # of running text with links the links alone are judged
                left = [t for x in _LINKED.findall(folded) for t in _TOKEN.findall(x)] + [t for t in _TOKEN.findall(_LINKED.sub(" ", folded)) if _is_url(t)]
                segments.append((segment, left, True))
                continue
        elif _is_clause([t for t in found if t[0] != "#"] if "#" in segment else found, segment):
            continue
        segments.append((segment, found, link))
    if lone:
        segments.append(("", lone, False))
    counted = _numbered([None if link else _head(found) for _, found, link in segments])
    loose, linked = [], []
    for (segment, found, link), goes_on in zip(segments, counted):
        if link or not (goes_on or _TABLE.match(segment) or _ACT.search(segment)):
            loose.append(found)
            linked.append(link)
    rest = sum(map(len, loose))
    if rest <= total * SHARE:
        return 0.0
    number: dict[str, int] = {}
    symbols: list[int] = []
    for i, found in enumerate(loose):
        symbols += [number.setdefault(_shape(t), len(number)) for t in found]
        symbols.append(-1 - i)  # no substring goes across segments
    covered = suffix_coverage(symbols, times)
    spam, at = 0, 0
    for found, link in zip(loose, linked):
        n = len(found)
        own = covered[at : at + n]
        at += n + 1
        if link and "://" in map(_shape, found):
            spam += n
            continue
        # a few words between repeated ones are the varying part of the list
        hits = [i for i, c in enumerate(own) if c]
        spam += len(hits)
        if hits:
            spam += sum(gap - 1 for gap in map(int.__sub__, [*hits, n], [-1, *hits]) if gap - 1 <= VARYING)
    return spam / total


def spam_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_id`` of the texts of which more than ``share`` of the words are spam.

    One pass over whole texts without a shuffle; a null id is kept, an id that occurs in
    several rows comes out once; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("__doc"), F.col(text).cast("string").alias("__text")).where("__text is not null")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.fromiter((spam_share(t) > share for t in batch.column(1).to_pylist()), bool, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit))], names=["__doc"])

    return rows.mapInArrow(judge, rows.select("__doc").schema).toDF(doc_id).distinct()
