"""Continuous periods and gaps of overlapping validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stands for "no end" while intervals are compared; it never leaves this module.
OPEN = "9999-12-31"


def latest_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of each ``key`` the row with the latest ``order``; repeated rows collapse.

    A ``max`` over a struct, so that the work is done in map-side partial aggregates and a
    key that holds a third of all rows costs no more than any other.  Rows with a null key
    are dropped; a null ``order`` is earlier than any other; equal ``order`` values are
    decided by the remaining columns in the order given (larger wins).
    """
    rest = [c for c in columns if c not in (key, order)]
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("__row"))
        .select(F.col("__key").alias(key), F.col(f"__row.{order}").alias(order), *[F.col(f"__row.{c}").alias(c) for c in rest])
    )


def merged_spans(df: DataFrame, entity: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Maximal covered runs of days per entity and the gaps between them.

    Both ends are inclusive and days are the unit: an interval that begins the day after
    another ended continues it.  A null end or 9999-12-31 is open.  Rows with a null start
    or an end before the start cover nothing.  A null in an entity column is a value of its
    own.  Other columns of ``df`` are ignored.

    Returns the entity columns, ``span_kind`` (``period`` or ``gap``), ``span_from`` and
    ``span_to`` (null: open).

    Scale: only the longest interval per entity and start day can matter, so one partial
    aggregate bounds every entity by the number of calendar days before its rows meet in
    one task for the ordered scan.
    """
    names = [f"__e{i}" for i in range(len(entity))]
    rows = df.select(
        *[F.col(c).alias(n) for c, n in zip(entity, names)],
        F.col(start).cast("date").alias("__from"),
        F.coalesce(F.col(end).cast("date"), F.lit(OPEN).cast("date")).alias("__to"),
    ).where("__from is not null and __to >= __from")
    days = rows.groupBy(*names, "__from").agg(F.max("__to").alias("__to"))
    ordered = Window.partitionBy(*names).orderBy("__from")
    reach = F.max("__to").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.datediff("__from", reach) > 1), 1).otherwise(0)
    islands = days.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(ordered))
    periods = islands.groupBy(*names, "__island").agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"))
    following = F.lead("__from").over(Window.partitionBy(*names).orderBy("__island"))
    shape = "array<struct<k:string,a:date,b:date>>"
    period = F.struct(F.lit("period").alias("k"), F.col("__from").alias("a"), F.when(F.col("__to") < F.lit(OPEN).cast("date"), F.col("__to")).alias("b"))
    gap = F.struct(F.lit("gap").alias("k"), F.date_add("__to", 1).alias("a"), F.date_sub("__next", 1).alias("b"))
    spans = periods.withColumn("__next", following).withColumn(
        "__span", F.explode(F.when(F.col("__next").isNull(), F.array(period)).otherwise(F.array(period, gap)).cast(shape))
    )
    return spans.select(
        *[F.col(n).alias(c) for c, n in zip(entity, names)],
        F.col("__span.k").alias("span_kind"),
        F.col("__span.a").alias("span_from"),
        F.col("__span.b").alias("span_to"),
    )


def version_spans(docs: DataFrame) -> DataFrame:
    """``merged_spans`` of the versions of each (group_key, language) of a ``docs`` table.

    Of each rid the row with the latest observed_from counts, and not if it is withdrawn
    (a null flag is not withdrawn).
    """
    columns = ["rid", "observed_from", "withdrawn", "group_key", "language", "valid_from", "valid_to"]
    current = latest_rows(docs, "rid", "observed_from", columns).where(~F.coalesce(F.col("withdrawn"), F.lit(False)))
    return merged_spans(current, ["group_key", "language"])


def spans_as_text(spans: DataFrame) -> DataFrame:
    """The spans with ISO dates; an open end is the word ``open``."""
    return spans.withColumns(
        {"span_from": F.col("span_from").cast("string"), "span_to": F.coalesce(F.col("span_to").cast("string"), F.lit("open"))}
    )
