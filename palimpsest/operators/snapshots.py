"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import durable

#: Snapshots of one chain that are compared in one block; the last of a block is also in the next.
BLOCK = 256
_KINDS = np.array(["added", "changed", "removed"])
_DIFF = "ch1 long, ch2 long, i1 long, i2 long, k long, change_kind string"
#: Rows that are compared in one task.
ROWS = 500_000


def _hash(salt: str, *columns: Column) -> Column:
    """64 bits of the columns, nulls apart from every value."""
    return F.xxhash64(F.lit(salt), *[x for c in columns for x in (c.isNull(), c)])


def diff_arrays(c1, c2, k, digest, last, own, block: int = BLOCK):
    """Differences of the snapshots in one bucket, as (kind, row) index arrays.

    ``c1, c2`` name the item within its chain, ``k`` is the ordinal of the snapshot, ``last``
    that it has no successor and ``own`` that the row belongs to this block rather than
    being the last snapshot of the block before.  Kinds: 0 added, 1 changed, 2 removed.
    """
    order = np.lexsort((k, c2, c1))
    c1, c2, k, digest, last, own = (x[order] for x in (c1, c2, k, digest, last, own))
    fresh = np.ones(len(k), bool)
    fresh[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
    item = np.cumsum(fresh) - 1
    key = item * (int(k.max()) + 2) + k if len(k) else k
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(k) else np.zeros(0, int)
    # an item that a snapshot holds several times has the sum of its distinct digests
    sums = np.add.reduceat(digest, starts) if len(starts) else digest
    keys, own, last, k, rows = key[starts], own[starts], last[starts], k[starts], order[starts]

    def find(wanted):
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(0, bool)

    before, there = find(keys - 1)
    there &= k > 0
    added = own & (k > 0) & ~there
    changed = own & there & (sums != sums[before] if len(keys) else there)
    _, stays = find(keys + 1)
    # the successor of the last snapshot of a block is in the next block only
    removed = ~last & ~stays & (~own | (k % block != block - 1))
    return np.r_[np.zeros(added.sum(), int), np.ones(changed.sum(), int), np.full(removed.sum(), 2)], np.r_[rows[added], rows[changed], rows[removed]]


def _item_keys(ch1, ch2, i1, i2):
    """128 bits for an item within its chain, of the hashes of both."""
    return ch1 * np.int64(-7046029254386353131) + i1, ch2 * np.int64(-4658895280553007687) + i2


def _diff_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    a = {n: t.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in t.column_names}
    with np.errstate(over="ignore"):
        c1, c2 = _item_keys(a["ch1"], a["ch2"], a["i1"], a["i2"])
        kind, row = diff_arrays(c1, c2, a["place"] >> 2, a["digest"], (a["place"] & 2) > 0, (a["place"] & 1) > 0)
    for at in range(0, len(row), 100_000):
        r = row[at : at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(a[n][r]) for n in ("ch1", "ch2", "i1", "i2")), pa.array(a["place"][r] >> 2), pa.array(_KINDS[kind[at : at + 100_000]], pa.string())],
            names=["ch1", "ch2", "i1", "i2", "k", "change_kind"],
        )


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """``chain, rid`` of ``chain, day, key, rid`` rows with ``k`` (ordinal in the chain), ``last`` and ``next_rid``.

    Ordinals come from two windows, neither of which grows with a chain's rows: the
    snapshots of one chain and day are numbered, and the days of a chain (bounded by the
    calendar) get a running count.
    """
    days = snapshots.groupBy("chain", "day").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "rid")).alias("first"))
    of_chain = Window.partitionBy("chain").orderBy("day")
    before = F.coalesce(F.sum("n").over(of_chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("chain", "day", before.alias("before"), F.lead("first.rid").over(of_chain).alias("next_first"))
    in_day = Window.partitionBy("chain", "day").orderBy("key", "rid")
    numbered = snapshots.withColumns({"in_day": F.row_number().over(in_day) - 1, "next_in_day": F.lead("rid").over(in_day)}).join(days, ["chain", "day"])
    following = F.coalesce("next_in_day", "next_first")
    return numbered.select("chain", "rid", (F.col("before") + F.col("in_day")).alias("k"), following.isNull().alias("last"), following.alias("next_rid"))


def snapshot_changes(df: DataFrame, chain: list[Column], day: Column, key: Column, rid: str = "rid", item: str = "anchor", digest: Column | str = "text_sha") -> DataFrame:
    """``rid, anchor, change_kind``: items added, removed or changed from one snapshot to the next.

    ``rid`` names a snapshot; ``chain``, the columns it is compared within, and ``day`` and
    ``key``, its order there, are expressions of the rid alone (``day`` must be a prefix of
    the order; equal keys are ordered by rid).  The first snapshot of a chain gives nothing;
    rid is the later of the two.

    The table is read twice.  A narrow pass takes the distinct names of snapshots and items,
    from which the snapshots are numbered once.  The other moves hashes only: 128 bits of
    item and of chain and 64 of the digest go to buckets of at most ``BLOCK`` snapshots of an
    item, as many tasks as the counted rows need, so that no chain, however long, meets in
    one task; each bucket is sorted in numpy and compared by ``searchsorted``, and the values
    are looked up for the differing keys alone.  Repeated rows count once and are removed on
    the map side; a null item is an item of its own and a null digest a text of its own;
    rows with a null rid belong to no snapshot; an empty table gives an empty result; other
    columns are ignored.
    """
    digest = F.col(digest) if isinstance(digest, str) else digest
    src = df.where(F.col(rid).isNotNull())
    kinds = F.array(F.struct(F.lit(True).alias("snapshot"), F.col(rid).cast("string").alias("value")), F.struct(F.lit(False).alias("snapshot"), F.col(item).cast("string").alias("value")))
    held = durable(src.select(F.explode(kinds).alias("x")).select("x.*").groupBy("snapshot", "value").agg(F.count(F.lit(1)).alias("rows")))
    total = held.where("snapshot").agg(F.sum("rows")).first()[0] or 0
    snapshots = held.where("snapshot").select(F.col("value").alias(rid))
    order = durable(snapshot_order(snapshots.select(F.struct(*chain).alias("chain"), day.alias("day"), key.alias("key"), F.col(rid).alias("rid"))))
    of_chain = [_hash("c", F.col("chain")).alias("ch1"), _hash("e", F.col("chain")).alias("ch2")]
    of_item = lambda c: [_hash("i", c).alias("i1"), _hash("j", c).alias("i2")]
    of_rid = lambda c: [_hash("r", c).alias("r1"), _hash("s", c).alias("r2")]
    rows = src.select(*of_rid(F.col(rid).cast("string")), *of_item(F.col(item).cast("string")), _hash("d", digest).alias("digest")).distinct()
    place = (F.col("k") * 4 + F.when(F.col("last"), 2).otherwise(0)).alias("place")
    placed = rows.join(order.select(*of_rid(F.col("rid")), *of_chain, place), ["r1", "r2"]).drop("r1", "r2")
    ordinal = F.shiftright("place", 2)
    halo = F.when((ordinal % BLOCK == BLOCK - 1) & (F.col("place").bitwiseAND(F.lit(2)) == 0), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))
    blocks = placed.withColumn("own", F.explode(halo)).withColumn("block", F.floor(ordinal / BLOCK) + 1 - F.col("own")).withColumn("place", F.col("place") + F.col("own"))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS))
    differing = blocks.repartition(tasks, "ch1", "i1", "block").select("ch1", "ch2", "i1", "i2", "digest", "place").mapInArrow(_diff_partition, _DIFF)
    named = differing.join(order.select(*of_chain, "k", "rid", "next_rid"), ["ch1", "ch2", "k"])
    items = held.where("not snapshot").select(*of_item(F.col("value")), F.col("value").alias("anchor"))
    later = F.when(F.col("change_kind") == "removed", F.col("next_rid")).otherwise(F.col("rid"))
    return named.join(items, ["i1", "i2"]).select(later.alias("rid"), "anchor", "change_kind")


def provision_changes(provisions: DataFrame) -> DataFrame:
    """``snapshot_changes`` of provisions: chains are (group_key, language) as written in the rid."""
    key, parts = F.substring_index("rid", "|", 1), F.split("rid", "\\|")
    group = F.get(F.split(key, ":"), F.lit(1))
    head = F.length(F.substring_index(key, ":", 2)) + 1
    sha = F.coalesce(F.lower("text_sha"), F.sha2("text_md", 256))
    return snapshot_changes(provisions, [group.alias("g"), F.get(parts, F.lit(1)).alias("l")], F.substring(key, F.lit(1), head + 10), key, digest=sha)
