"""Append-only corpus maintenance: observations, tombstones, reconciliation, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import broadcast_if_small


def observation_chain(observations: DataFrame) -> DataFrame:
    """Observations of an expression in order, each ended by the next one.

    The last keeps its own ``observed_to``.  A chain is an expression's; its length is the
    number of times that the expression was looked at.
    """
    key = F.lower(F.trim("key"))
    order = Window.partitionBy("chain", "language", "expr_valid_from").orderBy("observed_from", "obs_id")
    rows = observations.withColumn("chain", key)
    return rows.select("obs_id", "chain", "language", "expr_valid_from", "sha256", "observed_from", F.row_number().over(order).alias("step"), F.coalesce(F.lead("observed_from").over(order), F.col("observed_to")).alias("ended"),
                       (~F.lag("sha256").over(order).eqNullSafe(F.col("sha256"))).alias("changed"))


def lifecycle(raw_docs: DataFrame) -> DataFrame:
    """Per rid its sightings, withdrawals and resightings, and the state they end in.

    Rows in order of observation are compared with the one before; the last decides.
    """
    rows = raw_docs.where("rid is not null").select("rid", "observed_from", F.coalesce("withdrawn", F.lit(False)).alias("withdrawn")).distinct()
    order = Window.partitionBy("rid").orderBy("observed_from", "withdrawn")
    before = F.lag("withdrawn").over(order)
    steps = rows.withColumns({"tombstone": F.col("withdrawn") & ~F.coalesce(before, F.lit(False)), "resighted": ~F.col("withdrawn") & F.coalesce(before, F.lit(False))})
    total = lambda c: F.sum(F.col(c).cast("long")).alias(f"{c}s")
    return steps.groupBy("rid").agg(F.count(F.lit(1)).alias("sightings"), total("tombstone"), total("resighted"), F.max(F.struct("observed_from", "withdrawn"))["withdrawn"].alias("withdrawn"))


def reconcile(held: DataFrame, seen: DataFrame, fields: list[str]) -> DataFrame:
    """What a new observation of the source means for each rid that is held or seen.

    ``first_seen``, ``unchanged``, ``revised`` (with the names of the fields that differ),
    ``interval_closed`` (only the end differs and was open), ``resighted`` (held as
    withdrawn), ``tombstoned`` (live and not seen) or ``still_withdrawn``.  A full outer
    join on rid; nothing is overwritten, the action is the event to append.
    """
    a = held.select("rid", F.lit(True).alias("is_held"), F.col("withdrawn").alias("gone"), *[F.col(f).alias(f"old_{f}") for f in fields])
    b = seen.select("rid", F.lit(True).alias("is_seen"), *[F.col(f).alias(f"new_{f}") for f in fields])
    both = a.join(b, "rid", "full")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    both = both.withColumn("differ", F.when(F.col("is_held") & F.col("is_seen"), differing))
    closed = (F.col("differ") == F.array(F.lit("valid_to"))) & F.col("old_valid_to").isNull() if "valid_to" in fields else F.lit(False)
    action = (
        F.when(F.col("is_held").isNull(), "first_seen")
        .when(F.col("is_seen").isNull() & F.col("gone"), "still_withdrawn")
        .when(F.col("is_seen").isNull(), "tombstoned")
        .when(F.col("gone"), "resighted")
        .when(F.size("differ") == 0, "unchanged")
        .when(closed, "interval_closed")
        .otherwise("revised")
    )
    return both.select("rid", action.alias("action"), F.coalesce(F.array_join("differ", ","), F.lit("")).alias("fields"))


def state_at(raw_docs: DataFrame, moment: str) -> DataFrame:
    """What was held at a moment: of each rid the last row observed until then."""
    rows = raw_docs.where((F.col("rid").isNotNull()) & (F.col("observed_from") <= F.lit(moment).cast("timestamp")))
    rest = [c for c in raw_docs.columns if c not in ("rid", "observed_from")]
    last = rows.groupBy("rid").agg(F.max(F.struct("observed_from", *rest)).alias("r"))
    return last.select("rid", "r.*").withColumn("withdrawn", F.coalesce("withdrawn", F.lit(False)))


def apply_actions(held: DataFrame, seen: DataFrame, actions: DataFrame, moment: str) -> DataFrame:
    """The rows to append for the actions: seen values, or a tombstone of the held row.

    Reconciling again after they are appended gives no action but ``unchanged`` and
    ``still_withdrawn``.
    """
    columns = [c for c in held.columns if c in seen.columns]
    new = seen.join(actions.where("action in ('first_seen', 'revised', 'interval_closed', 'resighted')"), "rid", "left_semi").select(*columns)
    gone = held.join(actions.where("action = 'tombstoned'"), "rid", "left_semi").select(*columns).withColumn("withdrawn", F.lit(True))
    return new.unionByName(gone).withColumn("observed_from", F.lit(moment).cast("timestamp"))


def body_backfill(provisions: DataFrame, texts: DataFrame) -> DataFrame:
    """Hashes that provisions name but no text is held for, with how many name them."""
    return provisions.groupBy("text_sha").agg(F.count(F.lit(1)).alias("provisions")).join(texts.select("text_sha"), "text_sha", "left_anti")


def integrity(raw_docs: DataFrame, docs: DataFrame, provisions: DataFrame, citations: DataFrame) -> DataFrame:
    """``rule, violations``: the rules that a corpus must keep, and how often it breaks them."""
    one = F.count(F.lit(1)).alias("violations")
    shaped = r"^[^:|]+:[^:|]+:\d{4}-\d{2}-\d{2}--[0-9a-f]{64}$"
    rules = {
        "rid is key, language and start": docs.where(F.col("rid") != F.concat_ws("|", "key", "language", F.col("valid_from").cast("string"))),
        "key is canonical": docs.where(~F.col("key").rlike(shaped)),
        "key carries its start": docs.where(F.substring(F.substring_index("key", ":", -1), 1, 10) != F.col("valid_from").cast("string")),
        "one row per version and language": docs.groupBy("key", "language").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "end is not before start": docs.where("valid_to < valid_from"),
        "one value per observation": raw_docs.groupBy("rid", "observed_from").agg(F.countDistinct(F.struct("valid_to", "withdrawn", "record_sha")).alias("n")).where("n > 1"),
        "provisions have a version": provisions.select("rid").distinct().join(docs.select("rid"), "rid", "left_anti"),
        "citations have a version": citations.select("rid").distinct().join(docs.select("rid"), "rid", "left_anti"),
        "public text has provisions": docs.where("text_public and not withdrawn").join(provisions.select("rid").distinct(), "rid", "left_anti"),
    }
    out = None
    for rule, rows in rules.items():
        row = rows.agg(one).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def unmatched_states(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Live baseline states without exactly one candidate of the same work, language and start."""
    on = ["group_key", "language", "valid_from"]
    counts = candidate.groupBy(*on).agg(F.count(F.lit(1)).alias("candidates"))
    rows = baseline.where("not withdrawn").select("rid", *on).join(counts, on, "left")
    return rows.select("rid", F.coalesce("candidates", F.lit(0)).alias("candidates")).where("candidates <> 1")


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``profile, chunk_sha``: distinct chunk hashes that have no record under each profile: what is still to be encoded."""
    profiles = cache.where("profile is not null").select("profile").distinct()
    held = cache.where(F.col("record").isNotNull()).select("profile", "chunk_sha")
    chunks = wanted.where("chunk_sha is not null").select("chunk_sha").distinct()
    return chunks.crossJoin(broadcast_if_small(profiles)).select("profile", "chunk_sha").join(held, ["profile", "chunk_sha"], "left_anti")
