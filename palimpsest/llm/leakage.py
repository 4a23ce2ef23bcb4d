"""Passages of evaluation items that turn up in training texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import WordHashes, grams, winnow, words

#: Consecutive words that make a leak.
SPAN = 13
#: Words of a fingerprinted gram; windows of SPAN - GRAM + 1 grams guarantee every span.
GRAM = 7
#: Items, and bytes of their passages, up to which they are broadcast (200 items here).
BROADCAST_ITEMS, BROADCAST_BYTES = 50_000, 64_000_000


def has_span(doc: list[str], item: list[str], span: int = SPAN) -> bool:
    """The definition itself on words, used in tests."""
    need = min(span, len(item))
    if not need:
        return False
    held = {tuple(item[i : i + need]) for i in range(len(item) - need + 1)}
    return any(tuple(doc[i : i + need]) in held for i in range(len(doc) - need + 1))


#: Hits that are extended in one go.
HITS = 200_000


@dataclass
class Fingerprints:
    """Fingerprints of items with their places, sorted by hash, by the kind of gram.

    Items of at least ``span`` words are winnowed: of each window of grams the least hash.
    A shorter item has one fingerprint, the gram of all its words, kept by its length.
    """

    span: int
    gram: int
    #: Hashes of the words of all items on end, and where each item starts.
    flat: np.ndarray
    starts: np.ndarray
    #: Length of a short item, 0 for winnowed ones, to hashes and their places in ``flat``.
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[np.ndarray], span: int = SPAN, gram: int = GRAM) -> Fingerprints:
        starts = np.r_[0, np.cumsum([len(h) for h in items])].astype(np.int64)
        out: dict[int, tuple[list, list]] = {}
        for h, start in zip(items, starts):
            if not len(h):
                continue
            # short items of as many words as a gram are apart from winnowed ones
            key = len(h) if len(h) < span else 0
            g = grams(h, key or gram)
            at = np.arange(len(g)) if key else winnow(g, span - gram + 1)
            hashes, places = out.setdefault(key, ([], []))
            hashes.append(g[at])
            places.append(start + at)
        by_length = {}
        for k, (hashes, places) in out.items():
            h, p = np.concatenate(hashes), np.concatenate(places)
            order = np.argsort(h, kind="stable")
            by_length[k] = (h[order], p[order])
        return cls(span, gram, np.concatenate([np.zeros(0, np.uint64), *items]), starts, by_length)

    def leaks(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, item, and first word in either, of hits that extend to the span.

        Texts are hashes of words on end with their ends.  A fingerprint that both share is
        a hit; it is extended word by word to either side, within text and item, and kept if
        it reaches the span (or all of a shorter item).  Pairs may come out several times.
        """
        begin = np.r_[0, ends[:-1]]
        for key, (hashes, places) in self.by_length.items():
            k = key or self.gram
            g = grams(flat, k)
            if not len(g):
                continue
            text = np.searchsorted(ends, np.arange(len(g)), side="right")
            inside = np.arange(k - 1, len(flat)) < ends[text]
            # hashes of items are rare among those of texts: look them up first, winnow the hits
            low = np.searchsorted(hashes, g)
            low[low == len(hashes)] = 0
            at = np.flatnonzero((hashes[low] == g) & inside)
            if not key and len(at):
                at = at[self._selected(g, text, inside, at)]
            low = low[at]
            size = np.searchsorted(hashes, g[at], side="right") - low
            total = np.cumsum(size)
            known = np.zeros(0, np.int64)
            for cut in range(0, int(total[-1]) if len(total) else 0, HITS):
                here = np.arange(cut, min(cut + HITS, int(total[-1])))
                owner = np.searchsorted(total, here, side="right")
                there = places[low[owner] + here - (total[owner] - size[owner])]
                here = at[owner]
                item = np.searchsorted(self.starts, there, side="right") - 1
                pair = text[here] * len(self.starts) + item
                fresh = ~np.isin(pair, known)
                hit = self._extended(flat, begin[text[here[fresh]]], ends[text[here[fresh]]], here[fresh], there[fresh], item[fresh], k)
                d, i, x, y = text[here[fresh]][hit[0]], item[fresh][hit[0]], hit[1], hit[2]
                known = np.unique(np.r_[known, d * len(self.starts) + i])
                if len(d):
                    yield d, i, x, y

    def _extended(self, flat, first, end, here, there, item, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hits reach their span, and where it starts in text and item."""
        start, stop = self.starts[item], self.starts[item + 1]
        need = np.minimum(self.span, stop - start)
        left, right = np.zeros(len(here), np.int64), np.full(len(here), k, np.int64)
        going = np.ones(len(here), bool)
        for i in range(1, self.span - k + 1):
            going = going & (here - i >= first) & (there - i >= start)
            going[going] = flat[here[going] - i] == self.flat[there[going] - i]
            left += going
        going = right + left < need
        for i in range(k, self.span):
            going = going & (here + i < end) & (there + i < stop)
            going[going] = flat[here[going] + i] == self.flat[there[going] + i]
            right += going
        hit = np.flatnonzero(left + right >= need)
        return hit, here[hit] - left[hit], there[hit] - left[hit]

    def _selected(self, g, text, inside, at) -> np.ndarray:
        """Which of the grams ``at`` are least in some window of their text."""
        w = self.span - self.gram + 1
        n = len(g)
        # count of adjacent grams on either side, within the text, that are not smaller
        left, right = np.zeros(len(at), int), np.zeros(len(at), int)
        for side, step in ((left, -1), (right, 1)):
            going = np.ones(len(at), bool)
            for i in range(1, w):
                other = at + step * i
                ok = going & (other >= 0) & (other < n)
                o = np.where(ok, other, 0)
                ok &= inside[o] & (text[o] == text[at]) & (g[o] >= g[at])
                side[ok] += 1
                going = ok
        keep = left + right + 1 >= w
        # a text of fewer grams than a window has one fingerprint, its least gram
        grams_of = np.bincount(text[inside], minlength=int(text[-1]) + 1)
        short = grams_of[text[at]] < w
        return keep | (short & (left + right + 1 >= grams_of[text[at]]))


def _leaked(index: Fingerprints, spelled: list[list[str]], found: list[list[str]], hashes: WordHashes) -> list[tuple[int, int]]:
    """(text, item) pairs of texts given as words; the words of each span are compared as well."""
    ends = np.cumsum([len(x) for x in found])
    begin = np.r_[0, ends[:-1]] if len(ends) else ends
    pairs: set[tuple[int, int]] = set()
    for d, i, x, y in index.leaks(hashes([w for words_ in found for w in words_]), ends):
        for d, i, x, y in zip(d.tolist(), i.tolist(), (x - begin[d]).tolist(), (y - index.starts[i]).tolist()):
            need = min(index.span, len(spelled[i]))
            if (d, i) not in pairs and found[d][x : x + need] == spelled[i][y : y + need]:
                pairs.add((d, i))
    return sorted(pairs)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", passage: str = "passage", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, item_id`` of every text that holds ``span`` consecutive words of a passage.

    A passage of fewer words leaks if all of them stand in a text in order and adjacent.
    Words are maximal runs of letters and digits of the text without case, accents and
    invisible characters; a null, empty or wordless text or passage leaks nothing.  Rows
    repeated with the same id give one row; ids may be of any type, null ids are kept.

    Winnowed fingerprints of the passages meet those of the texts, and each hit is extended
    word by word to the span.  Up to ``BROADCAST_ITEMS`` items of ``BROADCAST_BYTES`` (measured) the
    fingerprints go to every task and the corpus is read once, without a shuffle; beyond
    that both sides' fingerprints are joined by hash, and hits are confirmed after a join.
    """
    wanted = items.select(F.col(item_id).alias("__item"), F.col(passage).cast("string").alias("__passage")).where("__passage is not null and __passage <> ''").distinct()
    texts = docs.select(F.col(doc_id).alias("__doc"), F.col(text).cast("string").alias("__text")).where("__text is not null and __text <> ''")
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("__passage")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_ITEMS and size["bytes"] <= BROADCAST_BYTES:
        return _broadcast(texts, wanted, span, gram).toDF(doc_id, item_id).distinct()
    return _joined(texts, wanted, span, gram).toDF(doc_id, item_id).distinct()


def _broadcast(texts: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    rows = wanted.toArrow().combine_chunks()
    spelled = [words(p) for p in rows.column(1).to_pylist()]
    hashes = WordHashes()
    # built once; bounded by the items' own bounds
    index = Fingerprints.of([hashes(w) for w in spelled], span, gram)
    shared = texts.sparkSession.sparkContext.broadcast((rows.column(0), spelled, index))
    schema = texts.select("__doc").schema.add(wanted.schema["__item"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, spelled, index = shared.value
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        hashes = WordHashes()
        for batch in batches:
            pairs = _leaked(index, spelled, [words(t) for t in batch.column(1).to_pylist()], hashes)
            if pairs:
                d, i = (pa.array(x, pa.int64()) for x in zip(*pairs))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(d), keys.take(i)], names=["__doc", "__item"])

    return texts.mapInArrow(search, schema)


def _prints(df: DataFrame, key: str, text: str, span: int, gram: int, lengths: list[int] | None) -> DataFrame:
    """``key, kind, fp``: winnowed fingerprints (kind 0) and, by length, those of short items.

    For items ``lengths`` is null; for texts it has the lengths of the short items.
    """
    schema = df.select(key).schema.add("kind", "integer").add("fp", "long")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            row, kind, fp = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                h = hashes(words(t))
                parts = []
                if lengths is not None or len(h) >= span:
                    g = grams(h, gram)
                    parts.append((0, np.unique(g[winnow(g, span - gram + 1)])))
                for k in (x for x in (lengths if lengths is not None else [len(h)] * (0 < len(h) < span))):
                    parts.append((k, np.unique(grams(h, k))))
                for k, f in parts:
                    row.append(np.full(len(f), r))
                    kind.append(np.full(len(f), k, np.int32))
                    fp.append(f.view(np.int64))
            if row:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(kind)), pa.array(np.concatenate(fp))], names=[key, "kind", "fp"])

    return df.select(key, text).mapInArrow(make, schema)


def _joined(texts: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    items = _prints(wanted, "__item", "__passage", span, gram, None)
    lengths = sorted(r[0] for r in items.where("kind > 0").select("kind").distinct().collect())  # below span
    pairs = _prints(texts, "__doc", "__text", span, gram, lengths).join(items, ["kind", "fp"]).select("__doc", "__item").distinct()
    # ids are compared null-safe: a null id is an id of its own
    held = pairs.join(texts, pairs["__doc"].eqNullSafe(texts["__doc"])).select(pairs["__doc"], "__item", "__text")
    both = held.join(wanted, held["__item"].eqNullSafe(wanted["__item"])).select("__doc", held["__item"], "__text", "__passage")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ok = []
            for t, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                item = words(p)
                ok.append(bool(_leaked(Fingerprints.of([hashes(item)], span, gram), [item], [words(t)], hashes)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], names=["__doc", "__item"])

    return both.mapInArrow(confirm, both.select("__doc", "__item").schema)
