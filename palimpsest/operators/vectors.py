"""Quantised vectors: sign bits for a first cut, signed bytes for the ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows of a block, and products of a block that are held at a time.
QUERIES, ROWS, PRODUCTS = 500, 100_000, 4_000_000
#: Rows that the ladder compares by their exact products.
NARROW = 500
_HITS = "profile string, asked string, chunk_sha string, distance int, dot int"


def sign_words(record: str) -> list[Column]:
    """The 64 sign bits of a record as two numbers of 32 bits."""
    digits = F.hex(F.col(record))
    return [F.conv(F.substring(digits, a, 8), 16, 10).cast("long") for a in (1, 9)]


def hamming(a: list[Column], b: list[int]) -> Column:
    """Differing bits: a popcount per word, within code generation."""
    parts = [F.bit_count(x.bitwiseXOR(F.lit(y))) for x, y in zip(a, b)]
    return sum(parts[1:], parts[0])


def words_of(record: bytes) -> list[int]:
    return [int.from_bytes(record[a : a + 4], "big") for a in (0, 4)]


def dot_with(record: bytes, skip: int = 8):
    """A vectorised function: dot products of records' signed bytes with those of one record."""
    query = np.frombuffer(record, np.int8)[skip:].astype(np.int32)

    @F.pandas_udf("int")
    def dot(records: pd.Series) -> pd.Series:
        v = np.frombuffer(b"".join(records), np.int8).reshape(len(records), -1)[:, skip:].astype(np.int32)
        return pd.Series((v @ query).astype(np.int32))

    return dot


def well_formed(cache: DataFrame, size: int = 72) -> DataFrame:
    """Records of the right length that are what their hash says, once each."""
    rows = cache.where((F.octet_length("record") == size) & (F.lower("record_sha") == F.sha2("record", 256)))
    return rows.select("profile", "chunk_sha", "record").distinct()


def hamming_topk(vectors: DataFrame, query: bytes, k: int) -> DataFrame:
    """The ``k`` records that differ in fewest sign bits (then by chunk_sha); a bounded top-k."""
    return vectors.withColumn("distance", hamming(sign_words("record"), words_of(query))).orderBy("distance", "chunk_sha").limit(k)


def reranked(candidates: DataFrame, query: bytes, k: int) -> DataFrame:
    """The ``k`` candidates of greatest dot product (then by chunk_sha)."""
    dots = candidates.withColumn("dot", dot_with(query)("record"))
    return dots.orderBy(F.col("dot").desc(), "chunk_sha").limit(k)


def ladder(vectors: DataFrame, query: bytes, limit: int, keep: Column | None = None) -> DataFrame:
    """Two-phase search: a wide Hamming cut, then filters, a narrower cut and exact products.

    Filters apply after the first cut, so that they can leave fewer than ``limit`` hits.
    """
    wide = hamming_topk(vectors, query, max(2000, 20 * limit))
    held = wide if keep is None else wide.where(keep)
    return reranked(held.orderBy("distance", "chunk_sha").limit(500), query, limit)


def askers(vectors: DataFrame) -> DataFrame:
    """The vectors that ask: those whose chunk_sha (its first 15 hex digits) is divisible by 20."""
    return vectors.where(F.conv(F.substring("chunk_sha", 1, 15), 16, 10).cast("long") % 20 == 0)


def _blocks(vectors: DataFrame, choose) -> tuple[DataFrame, bool]:
    """Every asker against all vectors of its profile; whether a block held all of these.

    Blocks of queries meet blocks of rows, each pair in a task.  ``choose`` gets distances and
    products of some queries and tells which columns to return; rows are in order of chunk_sha.
    """
    own = vectors.where("profile is not null and chunk_sha is not null")
    asking = askers(own).select("profile", F.col("chunk_sha").alias("asked"), F.col("record").alias("query"))
    most = lambda df: df.groupBy("profile").count().agg(F.max("count")).first()[0] or 1
    parts, blocks = -(-most(own) // ROWS), -(-most(asking) // QUERIES)
    part, block = (F.pmod(F.xxhash64(x), F.lit(n)).cast("int") for x, n in (("chunk_sha", parts), ("asked", blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select("*", block.alias("block"), every(parts).alias("part")).groupBy("profile", "block", "part")
    right = own.select("profile", "chunk_sha", "record", part.alias("part"), every(blocks).alias("block")).groupBy("profile", "block", "part")

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        rows = rows.sort_values("chunk_sha")
        if len(queries) and len(rows):
            signs, values = _arrays(rows.record)
            own_signs, own_values = _arrays(queries["query"])
            step = max(1, PRODUCTS // len(rows))
            for at in range(0, len(queries), step):
                # sums of 64 products of bytes are exact in single precision
                distance = ((64 - own_signs[at : at + step] @ signs.T) / 2).astype(np.int32)
                dot = (own_values[at : at + step] @ values.T).astype(np.int32)
                r, c = choose(distance, dot)
                found.append((at + r, c, distance[r, c], dot[r, c]))
        r, c, distance, dot = (np.concatenate(x) for x in zip(*found))
        names = [x.to_numpy(object)[i] for x, i in ((queries["profile"], r), (queries["asked"], r), (rows["chunk_sha"], c))]
        return pd.DataFrame(dict(zip(("profile", "asked", "chunk_sha"), names)) | {"distance": distance, "dot": dot})

    return left.cogroup(right).applyInPandas(meet, _HITS), parts == 1


def _arrays(records: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits as -1 and 1, and signed bytes, a row each."""
    raw = np.frombuffer(b"".join(records), np.uint8).reshape(len(records), -1)
    return np.unpackbits(raw[:, :8], axis=1).astype(np.float32) * 2 - 1, raw[:, 8:].view(np.int8).astype(np.float32)


def _first(hits: DataFrame, n: int, *order) -> DataFrame:
    ranked = Window.partitionBy("profile", "asked").orderBy(*order, "chunk_sha")
    return hits.withColumn("_i", F.row_number().over(ranked)).where(F.col("_i") <= n).drop("_i")


def nearest(vectors: DataFrame, near: int, limit: int | None = None) -> DataFrame:
    """``profile, asked, chunk_sha, distance, dot``: the ``near`` rows of fewest differing bits of every asker.

    With ``limit`` those of them with the greatest products, as in ``ladder``.
    """

    def choose(distance: np.ndarray, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = distance.astype(np.int64) * distance.shape[1] + np.arange(distance.shape[1])
        n = min(near, distance.shape[1])
        c = np.argpartition(key, n - 1, axis=1)[:, :n]
        return np.repeat(np.arange(len(c)), n), c.ravel()

    hits, whole = _blocks(vectors, choose)
    hits = hits if whole else _first(hits, near, "distance")
    return hits if limit is None else _first(hits, limit, F.col("dot").desc())


def within(vectors: DataFrame, least: int) -> DataFrame:
    """``profile, asked, chunk_sha, distance, dot``: all rows of products of ``least`` on of every asker."""
    return _blocks(vectors, lambda distance, dot: np.nonzero(dot >= least))[0]


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, bits, bytes``: unit vectors as sign bits and as signed bytes.

    Bytes are ``v * 127`` rounded half to even and clamped; a bit is set from zero up.
    """
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, v: a + v * v))
    rows = embeddings.select("vec_id", doubles.alias("v"), norm.alias("norm"))
    unit = F.transform("v", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(F.lit(0.0)))
    rows = rows.select("vec_id", unit.alias("u"))
    scaled = F.transform("u", lambda v: F.least(F.greatest(F.bround(v * 127), F.lit(-127.0)), F.lit(127.0)).cast("int"))
    return rows.select("vec_id", F.array_join(F.transform("u", lambda v: F.when(v >= 0, "1").otherwise("0")), "").alias("bits"), scaled.alias("bytes"))


#: Tokens of a batch that an encoder is given at most, and widths to which texts are filled up.
BUDGET, WIDTHS = 8_192, (32, 64, 128, 256, 512)


def batches_of(counts: np.ndarray, most: int = 64, budget: int = BUDGET) -> list[np.ndarray]:
    """Places of texts by batches of one width each; a batch has at most ``most`` texts and ``budget`` tokens."""
    width = np.asarray(WIDTHS)[np.minimum(np.searchsorted(WIDTHS, counts), len(WIDTHS) - 1)]
    out = []
    for w in WIDTHS:
        own = np.flatnonzero(width == w)
        size = max(1, min(most, budget // w))
        out += [own[i : i + size] for i in range(0, len(own), size)]
    return out


def encode_missing(chunks: DataFrame, cache: DataFrame, profile: str, encoder) -> DataFrame:
    """``profile, chunk_sha, record, record_sha``: what the cache lacks of a profile, encoded once each.

    ``chunks`` has chunk_sha, text and token_count; ``encoder`` takes a list of texts and
    gives an array, a row each.  Vectors are quantised to sign bits and signed bytes.  The
    rows are to be appended to the cache; chunks without text are left out.
    """
    held = cache.where((F.col("profile") == profile) & F.col("record").isNotNull()).select("chunk_sha").distinct()
    rows = chunks.where("chunk_sha is not null and text is not null").groupBy("chunk_sha").agg(F.min("text").alias("text"), F.coalesce(F.max("token_count"), F.lit(WIDTHS[-1])).alias("n")).join(held, "chunk_sha", "left_anti")

    def encode(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            records = [b""] * len(batch)
            for at in batches_of(batch["n"].to_numpy()):
                v = np.asarray(encoder([f"passage: {t}" for t in batch["text"].to_numpy()[at]]), np.float64)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                bits, signed = np.packbits(v >= 0, axis=1, bitorder="little"), np.clip(np.rint(v * 127), -127, 127).astype(np.int8)
                for i, b, s in zip(at, bits, signed):
                    records[i] = b.tobytes() + s.tobytes()
            yield pd.DataFrame({"profile": profile, "chunk_sha": batch["chunk_sha"], "record": records, "record_sha": [hashlib.sha256(r).hexdigest() for r in records]})

    return rows.mapInPandas(encode, "profile string, chunk_sha string, record binary, record_sha string")
