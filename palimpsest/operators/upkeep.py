"""Maintenance of a corpus beside its versions: publisher codes and metadata, scopes, gates and additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a metadata value, and values of a work, at most.
VALUE_LENGTH, VALUES = 1_024, 512


def coded(df: DataFrame, code: str, table: dict[str, dict[str, str]]) -> DataFrame:
    """Attributes that publisher codes stand for, a column each; codes that are not known give nulls."""
    names = sorted({n for attributes in table.values() for n in attributes})

    def pick(name: str) -> Column:
        out = F.lit(None).cast("string")
        for value, attributes in table.items():
            if name in attributes:
                out = F.when(F.col(code) == value, attributes[name]).otherwise(out)
        return out

    return df.withColumns({n: pick(n) for n in names})


def dominant(docs: DataFrame) -> DataFrame:
    """``group_key, kind, title``: the kind most versions of a work have, and its newest title that is not blank.

    Of kinds equally many the smaller; of titles of one day that of the dominant kind.
    """
    kinds = docs.where("kind is not null").groupBy("group_key", "kind").agg(F.countDistinct("key").alias("n"))
    most = kinds.groupBy("group_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).alias("m")).select("group_key", F.col("m.kind").alias("main"))
    rows = docs.join(most, "group_key", "left").where("title <> ''")
    newest = F.max(F.struct("valid_from", F.col("kind").eqNullSafe(F.col("main")).alias("own"), "title")).alias("t")
    titles = rows.groupBy("group_key").agg(newest).select("group_key", F.col("t.title").alias("title"))
    works = docs.select("group_key").distinct()
    return works.join(most.withColumnRenamed("main", "kind"), "group_key", "left").join(titles, "group_key", "left")


def canonical_metadata(metadata: DataFrame) -> DataFrame:
    """``work, identifier, value, place``: metadata of each work trimmed, once and in order.

    Blank and overlong values and identifiers are left out; of a work no more than ``VALUES`` stay.
    """
    value, identifier = F.trim("value"), F.trim("identifier")
    rows = metadata.select("work", identifier.alias("identifier"), value.alias("value")).where("value <> '' and identifier <> ''").where(F.length("value") <= VALUE_LENGTH).distinct()
    place = F.row_number().over(Window.partitionBy("work").orderBy("identifier", "value"))
    return rows.withColumn("place", place).where(F.col("place") <= VALUES)


def scope(works: DataFrame, edges: DataFrame, seeds: list[str], prefixes: list[str], subjects: list[str], most: int) -> DataFrame:
    """``work, reasons``: the works of a scope: seeds, those of a prefix or subject, and what cites or is cited by these.

    ``works`` has work and subject, ``edges`` source and target; the closure is one step
    deep.  A scope of more than ``most`` works is refused, not cut.
    """
    direct = [
        works.where(F.col("work").isin(seeds)).select("work", F.lit("seed").alias("reason")),
        *(works.where(F.startswith("work", F.lit(p))).select("work", F.lit("prefix").alias("reason")) for p in prefixes),
        works.where(F.col("subject").isin(subjects)).select("work", F.lit("subject").alias("reason")),
    ]
    named = direct[0]
    for part in direct[1:]:
        named = named.unionByName(part)
    core = named.select("work").distinct()
    out = edges.join(core, edges["source"] == core["work"]).select(F.col("target").alias("work"), F.lit("cited").alias("reason"))
    back = edges.join(core, edges["target"] == core["work"]).select(F.col("source").alias("work"), F.lit("citing").alias("reason"))
    rows = named.unionByName(out).unionByName(back).join(works.select("work").distinct(), "work", "left_semi")
    found = rows.groupBy("work").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    count = found.limit(most + 1).count()
    if count > most:
        raise ValueError(f"the scope has more than {most} works")
    return found


def added_expressions(before: DataFrame, after: DataFrame, of: str = "key") -> DataFrame:
    """``of, language``: languages that a version (or a work) held before has got since."""
    held = before.select(of, "language").distinct()
    rows = after.where("not withdrawn").select(of, "language").distinct()
    return rows.join(held.select(of).distinct(), of, "left_semi").join(held, [of, "language"], "left_anti")


def acquisition(docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """Per collection how far texts that are said to be available are held; expressions of metadata alone do not count against it."""
    held = provisions.select("rid").distinct().withColumn("held", F.lit(True))
    rows = docs.where("not withdrawn").join(held, "rid", "left").withColumns({"wanted": F.coalesce("text_available", F.lit(False)), "held": F.coalesce("held", F.lit(False))})
    out = rows.groupBy("collection").agg(
        F.count(F.lit(1)).alias("expressions"), F.count_if(~F.col("wanted")).alias("metadata_only"), F.count_if(F.col("wanted") & F.col("held")).alias("acquired"), F.count_if(F.col("wanted") & ~F.col("held")).alias("missing"),
    )
    return out.withColumn("complete", F.col("missing") == 0)


def original_states(docs: DataFrame) -> DataFrame:
    """``group_key, valid_from, derived_to, original``: the states of each work with its publication before them.

    A work published before its first state was in its original state until then.
    """
    days = docs.select("group_key", "valid_from", F.lit(False).alias("original"))
    first = docs.groupBy("group_key").agg(F.min("valid_from").alias("first"), F.min("publication_date").alias("published"))
    began = first.where("published < first").select("group_key", F.col("published").alias("valid_from"), F.lit(True).alias("original"))
    rows = days.unionByName(began).groupBy("group_key", "valid_from").agg(F.min("original").alias("original"))
    following = F.lead("valid_from").over(Window.partitionBy("group_key").orderBy("valid_from"))
    return rows.select("group_key", "valid_from", F.date_sub(following, 1).alias("derived_to"), "original")


def indexed_history(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Runs of wordings of which the state is searchable."""
    return runs.join(states.select("group_key", "language", "anchor", "text_sha").distinct(), ["group_key", "language", "anchor", "text_sha"], "left_semi")


def vectors_without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks: vectors of nothing, or chunks without a vector."""
    return left.where(F.col(key).isNotNull()).select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def vector_coverage(states: DataFrame, cache: DataFrame) -> DataFrame:
    """``state_id, chunks, encoded, whole``: of each state its chunks and those that have a vector."""
    held = cache.where("record is not null").select("chunk_sha").distinct().withColumn("held", F.lit(1))
    rows = states.where("chunk_sha is not null").select("state_id", "chunk_sha").distinct().join(held, "chunk_sha", "left")
    out = rows.groupBy("state_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("held").alias("encoded"))
    return out.withColumn("whole", F.col("chunks") == F.col("encoded"))


def stamp(values: Column) -> Column:
    """The SHA-256 of a map's entries as ``key=value`` lines, in order of the keys."""
    lines = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.sha2(F.array_join(lines, "\n"), 256)
