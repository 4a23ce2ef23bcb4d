"""References whose target is missing, withdrawn or received only later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import is_small

#: Distinct collection names up to which they are taken to the plan as literals.
COLLECTIONS = 1_000
_BLANKS = " \t\r\n "


def _tidy(reference: Column) -> Column:
    """Lower case without query, fragment and surrounding blanks."""
    return F.lower(F.btrim(F.regexp_replace(reference, "(?s)[?#].*$", ""), F.lit(_BLANKS)))


def eli_target(path: Column) -> Column:
    """The long-form parent key named by what follows ``/eli/`` in a tidied reference.

    Two segments are passed over, ``jo`` is dropped, ``consolide/<yyyymmdd>`` restricts the
    work to the versions of that day, and the other segments joined by ``-`` are the work.
    """
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    rest = F.slice(segments, F.lit(3), F.size(segments))
    at = F.array_position(rest, "consolide").cast("int")
    head = F.when(at > 0, F.slice(rest, 1, F.greatest(at - 1, F.lit(0)))).otherwise(rest)
    work = F.array_join(F.filter(head, lambda s: s != "jo"), "-")
    day = F.when(at > 0, F.get(rest, at))
    return F.when(day.isNull(), F.concat(F.lit("work|"), work)).otherwise(F.concat(F.lit("day|"), work, F.lit("|"), day))


def citation_targets(citations: DataFrame, collections: DataFrame) -> DataFrame:
    """``parent, ref_table, ref_id, ref_at`` of every href that is a reference."""
    # through a generator, so that no filter evaluates the tidying once more for itself
    tidy = F.explode_outer(F.array(_tidy(F.col("href"))))
    rows = citations.where("href is not null").select(F.col("citation_id").alias("ref_id"), F.col("observed_from").alias("ref_at"), tidy.alias("r")).where("r <> ''")
    eli = F.instr("r", "/eli/")
    parts = F.split("r", ":")
    named = F.when(F.size(parts) > 2, F.concat(F.lit("version|"), F.array_join(F.slice(parts, 1, 3), ":"))).otherwise(F.concat(F.lit("named|"), F.col("r")))
    rows = rows.withColumn("c", F.when(eli == 0, F.substring_index("r", ":", 1)))
    if is_small(collections, COLLECTIONS):
        known = [x[0] for x in collections.collect()]
        held = rows.where(F.col("c").isNull() | (F.contains("r", F.lit(":")) & F.col("c").isin(known)))
    else:
        own = rows.where(F.col("c").isNotNull() & F.contains("r", F.lit(":"))).join(collections.withColumnRenamed("collection", "c"), "c", "left_semi")
        held = rows.where("c is null").unionByName(own)
    target = F.when(eli > 0, eli_target(F.expr("substring(r, instr(r, '/eli/') + 5)"))).otherwise(named)
    # never null: a join would otherwise test for that by parsing twice
    return held.select(F.coalesce(target, F.lit("")).alias("parent"), F.lit("citations").alias("ref_table"), "ref_id", "ref_at")


def observation_targets(observations: DataFrame) -> DataFrame:
    """``parent, ref_table, ref_id, ref_at`` of every observation; its key names a version."""
    key = F.concat(F.lit("version|"), _tidy(F.col("key")))
    return observations.where(F.col("key").isNotNull()).select(
        F.coalesce(key, F.lit("")).alias("parent"), F.lit("obs_history").alias("ref_table"), F.col("obs_id").alias("ref_id"), F.col("observed_from").alias("ref_at")
    )


def held_parents(docs: DataFrame) -> DataFrame:
    """``parent, held_from`` in long form: the four names under which a held rid can be cited.

    A rid is held from its earliest observation unless its last one is withdrawn.
    """
    last = F.max(F.struct("observed_from", F.coalesce("withdrawn", F.lit(False)).alias("gone"), "key", "collection", "group_key", "valid_from"))
    rids = docs.where("rid is not null").groupBy("rid").agg(F.min("observed_from").alias("held_from"), last.alias("l")).where("not l.gone")
    group, collection = _tidy(F.col("l.group_key")), _tidy(F.col("l.collection"))
    names = F.array(
        F.concat(F.lit("version|"), _tidy(F.col("l.key"))),
        F.concat(F.lit("named|"), collection, F.lit(":"), group),
        F.concat(F.lit("work|"), group),
        F.concat(F.lit("day|"), group, F.lit("|"), F.date_format("l.valid_from", "yyyyMMdd")),
    )
    return rids.select(F.explode(names).alias("parent"), "held_from").where("parent is not null")


def orphan_references(docs: DataFrame, citations: DataFrame, observations: DataFrame) -> DataFrame:
    """``ref_table, ref_id, ref_period`` of each reference to which nothing was held in time.

    Parent and child keys are united in long form and grouped by the key of the parent; the
    group tells since when the parent is held and when the first child refers to it, and only
    groups with a child before that are kept.  Both aggregates combine on the map side, so a
    key cited by a third of all rows is one row per task before the shuffle.  The references
    of the kept groups are then looked up by an equi-join whose large side is splittable (AQE
    skew join).  Repeated references count once; nulls, blanks and hrefs that name no work
    are no references; a null time of reference is before everything and has a null period.
    Empty tables give an empty result.
    """
    collections = docs.select(_tidy(F.col("collection")).alias("collection")).where("collection <> ''").distinct()
    children = citation_targets(citations, collections).unionByName(observation_targets(observations))
    early = F.coalesce("ref_at", F.lit("0001-01-01").cast("timestamp"))
    long = held_parents(docs).select("parent", "held_from", F.lit(None).cast("timestamp").alias("ref_at")).unionByName(
        children.select("parent", F.lit(None).cast("timestamp").alias("held_from"), early.alias("ref_at"))
    )
    groups = long.groupBy("parent").agg(F.min("held_from").alias("held_from"), F.min("ref_at").alias("first_ref"))
    lacking = groups.where("first_ref is not null and (held_from is null or held_from > first_ref)").select("parent", "held_from")
    found = children.join(lacking, "parent").where(F.col("held_from").isNull() | F.col("ref_at").isNull() | (F.col("ref_at") < F.col("held_from")))
    return found.select("ref_table", "ref_id", F.date_format("ref_at", "yyyy-MM").alias("ref_period")).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``ref_table, ref_period, orphans``: how many references of each table and month are orphans."""
    return orphans.groupBy("ref_table", "ref_period").agg(F.count(F.lit(1)).alias("orphans"))
