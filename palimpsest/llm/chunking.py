"""Pieces of texts under a token limit, cut at natural boundaries, stable under edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a piece at most, tokens shared by consecutive pieces, and the two that an
#: encoder adds to every text.
LIMIT, OVERLAP, SPECIAL = 256, 32, 2
#: Fewest new tokens of a piece that is not the last.
LEAST = 96
#: Tokens over which the rolling hash is taken.
ROLL = 8
_PIECE = "text_sha string, piece int, piece_text string, token_count int, start int, n_tokens long, boundary string"


def token_count(text: Column) -> Column:
    """Maximal runs of characters other than space, tab, CR and LF, plus two; null of null."""
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+")) + SPECIAL


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than blanks and line ends."""
    solid = ~((data == 32) | (data == 9) | (data == 13) | (data == 10))
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def gaps(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What lies before each token: 2 a blank line, 1 a line break, 0 neither; 2 for the first.

    Lines end in LF or CRLF; a line of nothing but spaces and tabs is blank.  Within a gap
    all characters are blanks, so that two line ends make a blank line.  A CR that no LF
    follows is a blank within its line.
    """
    lf = np.r_[0, np.cumsum(data == 10)]
    crs = (data == 13) & (np.r_[data[1:], 0] != 10) if len(data) else np.zeros(0, bool)
    lone = np.r_[0, np.cumsum(crs)]
    out = np.zeros(len(starts), np.int8)
    if len(starts):
        out[0] = 2
        n = lf[starts[1:]] - lf[ends[:-1]]
        out[1:] = np.minimum(n, 2)
        # a lone CR keeps the line it stands on from being blank: look at such gaps one by one
        for i in np.flatnonzero((n > 1) & (lone[starts[1:]] > lone[ends[:-1]])):
            lines = data[ends[i] : starts[i + 1]].tobytes().replace(b"\r\n", b"\n").split(b"\n")[1:-1]
            out[i + 1] = 2 if any(b"\r" not in x for x in lines) else 1
    return out


def _token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of the ``ROLL`` tokens before each gap."""
    m = 0x9E3779B97F4A7C15
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(data), m, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(data), pow(m, -1, 2**64), np.uint64)])
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])]
    h = (sums[ends] - sums[starts]) * down[starts]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    # window of the ROLL tokens before the gap; the first gaps have fewer
    rolled = np.zeros(len(h), np.uint64)
    for i in range(1, ROLL + 1):
        rolled[i:] = rolled[i:] * np.uint64(0xBF58476D1CE4E5B9) + h[:-i] if i < len(h) else rolled[i:]
    rolled ^= rolled >> np.uint64(29)
    return rolled * np.uint64(0x94D049BB133111EB)


def cut_points(gap: np.ndarray, rolled: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, level: int = 0) -> list[int] | None:
    """First tokens of the pieces after the first, leaving the overlap aside.

    From the last cut on, the landmark is the gap of the least rolling hash among those
    that leave a piece of the minimum and maximum size; it snaps to the nearest gap of the
    coarsest kind in that range (blank line, else line break).  If it holds neither, the last
    gap of the coarsest kind before it that still leaves a new token is taken, and only if
    there is none the landmark itself.  With a ``level`` only gaps of at least that kind are
    cut at, and None says that they do not suffice.
    A cut depends on the text since the last cut only, and landmarks on a few tokens each,
    so that after an edit the cuts fall into step again within a few pieces.
    """
    cuts, at, n = [], 0, len(gap)
    room = limit - SPECIAL
    if overlap >= room:
        raise ValueError("the overlap leaves no room for new tokens")
    least = max(least, overlap + 1)
    while n - at > room - (overlap if cuts else 0):
        most = room - (overlap if cuts else 0)
        low, high = at + min(least, most), at + most
        landmark = low + int(np.argmin(rolled[low : high + 1]))
        kind = gap[low : high + 1]
        best = kind.max()
        if best and best >= level:
            natural = low + np.flatnonzero(kind == best)
            landmark = int(natural[np.argmin(np.abs(natural - landmark))])
        else:
            # every piece needs a new token, and the overlap must lie in what came before
            early = max(at, overlap) + 1
            kind = gap[early:low]
            if len(kind) and kind.max() and kind.max() >= level:
                landmark = early + int(np.flatnonzero(kind == kind.max())[-1])
            elif level:
                return None
        cuts.append(landmark)
        at = landmark
    return cuts


def boundary_kind(gap: np.ndarray, rolled: np.ndarray, limit: int = LIMIT) -> str:
    """The coarsest cut that suffices: pieces without overlap, cut at blank lines (or at line breaks) alone, keep the limit."""
    for kind, level in (("paragraph", 2), ("line", 1)):
        if cut_points(gap, rolled, limit, 0, 1, level) is not None:
            return kind
    return "inside"


def chunk_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> tuple[list[tuple[str, int, int]], int, str]:
    """Pieces ``(text, token_count, first token)``, the token count and the boundary of a text.

    A text within the limit is one piece, as it stands.  Every later piece begins with the
    last ``overlap`` tokens of the one before it.  Pieces keep the blanks between their
    tokens; blanks before the first and after the last token of a piece are dropped.
    """
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends = _runs(data)
    n = len(starts)
    gap = gaps(data, starts, ends)
    if n + SPECIAL <= limit:
        return [(text, n + SPECIAL, 0)], n + SPECIAL, "paragraph"
    rolled = _token_hashes(data, starts, ends)
    kind = boundary_kind(gap, rolled, limit)
    cuts = cut_points(gap, rolled, limit, overlap, least)
    firsts = [0, *(c - overlap for c in cuts)]
    lasts = [*cuts, n]
    return [(raw[starts[a] : ends[b - 1]].decode(), b - a + SPECIAL, a) for a, b in zip(firsts, lasts)], n + SPECIAL, kind


def oversized(df: DataFrame, text: str, limit: int = LIMIT) -> DataFrame:
    """``text_sha, text``: the distinct texts of more than ``limit`` tokens.

    Tokens of ``limit - 2`` runs need twice as many characters less one, so that shorter
    texts are passed over without a count; then texts are hashed and one of each kept.
    """
    t = F.col(text).cast("string")
    long = df.select(t.alias("text")).where(F.length("text") >= 2 * (limit - SPECIAL + 1) - 1).where(token_count(F.col("text")) > limit)
    return long.withColumn("text_sha", F.sha2("text", 256)).dropDuplicates(["text_sha"]).select("text_sha", "text")


def chunk_texts(texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST, pieces: bool = True) -> DataFrame:
    """The pieces of every text of ``text_sha, text`` (see ``chunk_text``).

    ``piece`` counts from 0, ``start`` is its first token, ``n_tokens`` and ``boundary``
    belong to the whole text.  Without ``pieces`` only the first piece of each text comes
    out, for those who want the text's figures alone.  Null texts have no pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for sha, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.errstate(over="ignore"):
                    parts, n, kind = chunk_text(text, limit, overlap, least)
                rows += [(sha, i, part, count, start, n, kind) for i, (part, count, start) in enumerate(parts if pieces else parts[:1])]
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return texts.where("text is not null").select("text_sha", "text").mapInArrow(cut, _PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PIECE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
