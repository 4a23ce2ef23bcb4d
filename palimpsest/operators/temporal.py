"""Point-in-time reads: which state of a work is in force on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import FilterSet, apply_filters, contains


def language_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("group_key", "language").agg(F.count(F.lit(1)).alias("in_language"))


def latest_states(eligible: DataFrame) -> DataFrame:
    """The rows of each work that share its latest start; same-day siblings are all kept."""
    latest = eligible.groupBy("group_key").agg(F.max("valid_from").alias("valid_from"))
    return eligible.join(latest, ["group_key", "valid_from"])


def one_expression(states: DataFrame, language: str | None, columns: list[str], by_frequency: DataFrame | None = None) -> DataFrame:
    """One row per version: the expression in the language asked for, else the first.

    ``by_frequency`` puts the language that the work has most rows in before the alphabet.
    A ``min`` over structs: no window, and partial aggregates before the shuffle.
    """
    asked = F.lit(True) if language is None else F.col("language") != language
    order = [F.coalesce(asked, F.lit(True)).alias("not_asked")]
    if by_frequency is not None:
        states = states.join(by_frequency, ["group_key", "language"], "left")
        order.append((-F.coalesce("in_language", F.lit(0))).alias("rarer"))
    picked = F.min(F.struct(*order, "language", "rid", *[c for c in columns if c not in ("language", "rid", "group_key", "key")]))
    rows = states.groupBy("group_key", "key").agg(picked.alias("r"))
    return rows.select("group_key", "key", *[F.col(f"r.{c}").alias(c) for c in columns if c not in ("group_key", "key")])


def in_force_on(docs: DataFrame, date: str, filters: FilterSet = FilterSet(), columns: tuple[str, ...] = ("valid_from", "language", "rid", "title")) -> DataFrame:
    """The state of every work in force on a day, with ``choices`` (more than one: ambiguous).

    The language asked for selects an expression and the works that have one; it never
    prefers one state to a sibling of the same day.
    """
    language = filters.language
    scope = apply_filters(docs, FilterSet(filters.collection, filters.kind, None, filters.works)).where(contains(date))
    states = latest_states(scope)
    if language is not None:
        having = states.where(F.col("language") == language).select("group_key").distinct()
        states = states.join(having, "group_key", "left_semi")
    rows = one_expression(states, language, list(columns))
    choices = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("choices"))
    return rows.join(choices, "group_key")


def effective_on(docs: DataFrame, date: str, language: str | None = None, columns: tuple[str, ...] = ("valid_from", "language", "rid", "withdrawn")) -> DataFrame:
    """As ``in_force_on``, but withdrawn states count and the work's usual language comes next."""
    states = latest_states(docs.where(contains(date)))
    return one_expression(states, language, list(columns), language_counts(docs))


def as_of_join(probes: DataFrame, docs: DataFrame, work: str = "group_key", date: str = "on_date") -> DataFrame:
    """For each distinct (work, date) the latest start among the versions that contain the date.

    Intervals of a work may overlap.  Versions are put into the years that they cover (of
    those that are asked for) and meet the probes by an equi-join on work and year; of a
    start day only the longest interval matters, which bounds both sides by the calendar.
    Probes without a version in force come out with a null ``valid_from``.
    """
    asked = probes.select(F.col(work).alias("group_key"), F.col(date).cast("date").alias("on_date")).where("group_key is not null and on_date is not null").distinct()
    span = asked.agg(F.year(F.min("on_date")).alias("a"), F.year(F.max("on_date")).alias("b")).first()
    if span["a"] is None:
        return asked.withColumn("valid_from", F.lit(None).cast("date"))
    ends = F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    longest = docs.where("not withdrawn and valid_from is not null").groupBy("group_key", "valid_from").agg(F.max(ends).alias("until")).where("until >= valid_from")
    first, last = F.greatest(F.year("valid_from"), F.lit(span["a"])), F.least(F.year("until"), F.lit(span["b"]))
    cells = longest.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    hit = asked.withColumn("y", F.year("on_date")).join(cells, ["group_key", "y"]).where("on_date between valid_from and until")
    found = hit.groupBy("group_key", "on_date").agg(F.max("valid_from").alias("valid_from"))
    return asked.join(found, ["group_key", "on_date"], "left")


def timeline(docs: DataFrame) -> DataFrame:
    """Versions of every work in order of date, with their expressions."""
    expression = F.struct("language", "rid", F.col("valid_to").cast("string").alias("valid_to"))
    return docs.groupBy("group_key", "key", "valid_from").agg(
        F.array_sort(F.collect_set(expression)).alias("expressions"),
        F.count(F.lit(1)).alias("n_expressions"),
        F.max("withdrawn").alias("withdrawn"),
    )


def derived_ends(dates: DataFrame, work: str = "group_key", start: str = "valid_from") -> DataFrame:
    """``valid_to`` as the day before the next strictly later start; same-day siblings share it."""
    days = dates.select(F.col(work), F.col(start)).where(F.col(start).isNotNull()).distinct()
    following = F.lead(start).over(Window.partitionBy(work).orderBy(start))
    return days.withColumn("derived_to", F.date_sub(following, 1))


def rail_positions(docs: DataFrame) -> DataFrame:
    """Where a version stands on the date span of its work, in per cent."""
    spans = docs.groupBy("group_key").agg(F.min("valid_from").alias("a"), F.max("valid_from").alias("b"))
    days = F.datediff("b", "a")
    at = F.when(days > 0, F.round(100 * F.datediff("valid_from", "a") / days, 2)).otherwise(F.lit(0.0))
    return docs.select("group_key", "key", "valid_from").distinct().join(spans, "group_key").select("group_key", "key", at.alias("position"))
