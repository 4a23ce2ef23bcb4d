"""Encoding of a corpus by the merges of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

#: Fixed value: the public pattern that splits a text before merges apply (see split_starts).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words whose ids a task remembers; beyond it the memory is emptied, which costs
#: time, never a result.
REMEMBERED = 500_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Bytes to id from the lines of a rank file; the id of a merge is also its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class MergeReplay:
    """Replays the merges of a vocabulary over many distinct words at once.

    The words lie in one row of symbols with links to the neighbours on either side.  An
    inverted index holds, for each merge, the positions of its left symbols in all words.
    Merges apply in the order of rank: the one of lowest rank that occurs is taken at all
    of its positions from left to right, and only the two neighbours of each position enter
    the index anew.  A merge can only give rise to pairs of later rank, so that each rank
    comes up once, whatever the number of words.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.names: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.names[rank] = token
        self.ranks = ranks
        self.bytes = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.bytes[token[0], token[1]] = rank
        #: a << 20 | b to the id into which the symbols a and b merge, -1 if they do not
        self.pairs: dict[int, int] = {}

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes on end and the end of each; returns ids and ends."""
        n = len(data) + len(ends)
        # each word is followed by a symbol that merges with nothing
        place = np.arange(len(data)) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        row = np.full(n, -1, np.int64)
        row[place] = self.single[data]
        rank = np.full(n, -1, np.int64)
        if len(data) > 1:
            rank[place[:-1]] = np.where(np.diff(place) == 1, self.bytes[data[:-1], data[1:]], -1)
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        first = np.flatnonzero(np.diff(rank[at], prepend=-1))
        index = {int(rank[x[0]]): x.tolist() for x in np.split(at, first[1:]) if len(x)}
        # one more at either end, so that neighbours need no bounds
        symbols, after, before = [*row.tolist(), -1], list(range(1, n + 2)), list(range(-1, n))
        pairs, ranks, names = self.pairs, self.ranks, self.names
        queue = list(index)
        heapify(queue)
        while queue:
            now = heappop(queue)
            positions = index.pop(now)
            positions.sort()
            for here in positions:
                a = symbols[here]
                if a < 0:
                    continue
                right = after[here]
                b = symbols[right]
                # other merges may have taken either symbol since; several pairs can spell one token
                if b < 0 or (pairs.get(a << 20 | b) != now and names[a] + names[b] != names[now]):
                    continue
                symbols[here], symbols[right] = now, -2
                beyond = after[right]
                after[here] = beyond
                before[beyond] = here
                left = before[here]
                for start, x, y in ((left, symbols[left], now), (here, now, symbols[beyond])):
                    if x >= 0 and y >= 0:
                        new = pairs.get(x << 20 | y)
                        if new is None:
                            new = pairs[x << 20 | y] = ranks.get(names[x] + names[y], -1)
                        if new >= 0:
                            if new in index:
                                index[new].append(start)
                            else:
                                index[new] = [start]
                                heappush(queue, new)
        left = np.array(symbols[:-1], np.int64)
        kept = left >= 0
        return left[kept].astype(np.int32), np.cumsum(kept)[place[ends - 1]] if len(ends) else ends


_KINDS: dict[str, np.ndarray] = {}
_SPACE, _BLANK, _LETTER, _DIGIT, _OTHER, _END = range(6)


def char_kinds() -> np.ndarray:
    """The kind of every code point: space, other white space, letter, number, other."""
    if "all" not in _KINDS:
        kinds = np.full(0x110001, _OTHER, np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((_BLANK, r"\s+"), (_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, points):
                a, b = ord(m[0][0]), ord(m[0][-1])
                kinds[a : b + 1] = kind
        kinds[32] = _SPACE
        kinds[0x110000] = _END
        _KINDS["all"] = kinds
    return _KINDS["all"]


def split_starts(points: np.ndarray) -> np.ndarray:
    """Whether a word of ``PATTERN`` starts at each code point; 0x110000 ends each text.

    The pattern as arithmetic on runs of one kind: a run of letters, numbers or others takes
    a single space before it along; of white space before anything else, all but the last
    character is one word, and the last one is a word of its own unless it is that space; a
    lone apostrophe takes along the letters of a contraction.
    """
    kinds = char_kinds()[points]
    run = np.maximum(kinds, _BLANK)
    fresh = np.empty(len(run), bool)
    fresh[:1] = True
    np.not_equal(run[1:], run[:-1], out=fresh[1:])
    start = fresh.copy()
    solid = run > _BLANK
    # the run after a space starts with that space
    start[1:] &= ~(solid[1:] & (kinds[:-1] == _SPACE) & (run[1:] != _END))
    # the last white space before a solid run starts a word
    start[:-1] |= ~solid[:-1] & solid[1:] & (run[1:] != _END)
    lone = np.flatnonzero((points == 39) & fresh)
    lone = lone[lone + 1 < len(points)]
    lone = lone[fresh[lone + 1] & (run[lone + 1] == _LETTER) & start[lone]]
    if len(lone):
        padded = np.r_[points, 0x110000, 0x110000]
        x, y = padded[lone + 1], padded[lone + 2]
        one = np.isin(x, [ord(c) for c in "stmd"])
        two = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for at, length in ((lone[one], 1), (lone[two], 2)):
            start[at + 1] = False
            rest = at + 1 + length
            start[rest] |= run[rest] == _LETTER
    start[run == _END] = True
    return start


#: Bytes of a word that are hashed by their place; longer words are told apart by themselves.
HASHED = 64
#: Bytes of text that are encoded in one go.
BLOCK = 2_000_000


class BlockEncoder:
    """Encodes blocks of texts; words already seen by this task are looked up.

    Words meet by a hash, the sum of a random number for each byte at each place, and are
    then compared byte by byte, so that no two words are ever taken for one: where a hash
    joins different words, the block's words are told apart by their bytes instead.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.replay = MergeReplay(ranks)
        self.key = np.random.default_rng().integers(0, 2**64, (HASHED, 256), np.uint64)
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.spelled, self.spelled_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _hashes(self, data: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of each of the words of ``size`` bytes from ``a`` on; words are on end."""
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(begin, size).astype(np.int32)
        word = data[np.repeat((a - begin).astype(np.int32), size) + np.arange(len(place), dtype=np.int32)]
        h = np.add.reduceat(self.key[np.minimum(place, HASHED - 1), word], begin) if len(size) else np.zeros(0, np.uint64)
        for i in np.flatnonzero(size >= HASHED).tolist():
            h[i] = hash(data[a[i] : a[i] + size[i]].tobytes()) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _equal(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
        """Whether the words of ``size`` bytes from ``a`` on in x and from ``b`` on in y are pairwise equal."""
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum()), dtype=np.int32)
        return np.array_equal(x[np.repeat((a - begin).astype(np.int32), size) + at], y[np.repeat((b - begin).astype(np.int32), size) + at])

    def _distinct(self, data: np.ndarray, a: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, first places and members of the distinct words of a block."""
        h = self._hashes(data, a, size)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        same = first[which]
        if (size[same] == size).all() and self._equal(data, a, data, a[same], size):
            return distinct, first, which
        seen: dict[bytes, int] = {}
        which = np.fromiter((seen.setdefault(data[x : x + n].tobytes(), len(seen)) for x, n in zip(a.tolist(), size.tolist())), np.int64, len(a))
        _, first = np.unique(which, return_index=True)
        self.forget()
        return h[first], first, which

    def _known(self, distinct: np.ndarray, data: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word among those remembered, -1 for new ones."""
        known = np.fromiter((self.number.get(x, -1) for x in distinct.tolist()), np.int64, len(distinct))
        old = np.flatnonzero(known >= 0)
        at = self.spelled_at[known[old]]
        if (self.spelled_at[known[old] + 1] - at == size[old]).all() and self._equal(data, a[old], self.spelled, at, size[old]):
            return known
        self.forget()
        return np.full(len(distinct), -1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end and the offsets of each text; null and empty texts have none."""
        rows = [t or "" for t in texts]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
        text_ends = np.cumsum(lengths)
        points = np.full(int(text_ends[-1]) if len(rows) else 0, 0x110000, np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        inside = np.ones(len(points), bool)
        inside[text_ends - 1] = False
        joined = "".join(rows)
        points[inside] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(split_starts(points))
        width = (inside * 1 + (points >= 0x80) * inside + (points >= 0x800) * inside + (points >= 0x10000) * inside).astype(np.int64)
        place = np.r_[0, np.cumsum(width)]
        word = inside[starts]
        a, b = place[starts][word], place[np.r_[starts[1:], len(points)]][word]
        data = np.frombuffer(joined.encode(), np.uint8)
        size = b - a
        distinct, first, which = self._distinct(data, a, size)
        if len(self.number) > REMEMBERED:
            self.forget()
        known = self._known(distinct, data, a[first], size[first])
        new = np.flatnonzero(known < 0)
        if len(new):
            wa, n = a[first[new]], size[first[new]]
            ends = np.cumsum(n)
            spelled = data[np.repeat(wa - (ends - n), n) + np.arange(ends[-1])]
            ids, id_ends = self.replay.encode(spelled, ends)
            at = len(self.starts) - 1
            known[new] = at + np.arange(len(new))
            self.number.update(zip(distinct[new].tolist(), known[new].tolist()))
            self.spelled_at = np.r_[self.spelled_at, len(self.spelled) + ends]
            self.spelled = np.r_[self.spelled, spelled]
            self.starts = np.r_[self.starts, len(self.ids) + id_ends]
            self.ids = np.r_[self.ids, ids]
        which = known[which]
        begin = self.starts[which]
        length = self.starts[which + 1] - begin
        total = np.r_[0, np.cumsum(length)]
        flat = self.ids[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        words_before = np.r_[0, np.cumsum(word)]
        return flat, np.r_[0, total[words_before[np.searchsorted(starts, text_ends - 1)]]]


def encode_column(df: DataFrame, vocabulary: str, keys: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """``keys`` and the token ids of ``text`` by the rank file at ``vocabulary``.

    One row per row of ``df``, in one pass without a shuffle: each task splits its block of
    the corpus, replays the merges over the distinct words that it has not met before and
    gathers the ids of all words.  No special tokens; a text that spells one is ordinary
    text; the text is taken as stored (no normalisation).  Empty and null texts give an
    empty list.  A key column named like the result is kept under its own name only if it
    differs from ``ids``; other columns are ignored.  The rank file (a fixed vocabulary,
    under 2 MB) is read on the driver and broadcast.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add(ids, T.ArrayType(T.IntegerType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or BlockEncoder(load_ranks(shared.value))
            texts = batch.column(batch.num_columns - 1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            # in blocks, so that what is held about their words stays small in memory
            cuts = [0, *np.flatnonzero(np.diff(size // BLOCK)) + 1, len(texts)] if len(texts) else []
            for a, b in zip(cuts, cuts[1:]):
                flat, offsets = encoder.encode(texts.slice(a, b - a).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keys))), column], names=[*keys, ids])

    return rows.mapInArrow(encode, schema)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of ids; the inverse of encoding for every valid string."""
    names = {rank: token for token, rank in ranks.items()}
    return b"".join(names[i] for i in ids).decode()
