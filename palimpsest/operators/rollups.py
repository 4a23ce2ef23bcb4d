"""Aggregates over works, versions and expressions: changes, catalogue, coverage, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import FilterSet, apply_filters, contains


#: Provisions whose hashes are put in order in one go.
DIGEST_BLOCK = 1024


def wording_digests(docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """``rid, wording``: one hash per expression over its provisions' hashes in order of seq.

    Blocks of ``DIGEST_BLOCK`` places are hashed first and the blocks' hashes then, so that
    an expression of any length is never gathered in one row.
    """

    def digest(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(order, value)))
        return rows.groupBy(*by).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x[value]), ""), 256).alias(name))

    rows = docs.select("rid").join(provisions, "rid").withColumn("block", F.floor(F.col("seq") / DIGEST_BLOCK))
    return digest(digest(rows, ["rid", "block"], "seq", "text_sha", "part"), ["rid"], "block", "part", "wording")


def changes_in_period(docs: DataFrame, first: str, last: str, filters: FilterSet = FilterSet()) -> DataFrame:
    """Per work: versions that start in the window, first and last of them, total and baseline.

    Only the window respects the filters; title, total and baseline are of all rows.  The
    baseline is the newest start before the first change.
    """
    window = apply_filters(docs, filters).where(F.col("valid_from").between(first, last))
    moved = window.groupBy("group_key").agg(
        F.countDistinct("key").alias("versions"), F.min("valid_from").alias("first_change"), F.max("valid_from").alias("last_change"), F.max("kind").alias("kind")
    )
    titled = F.max(F.struct("valid_from", "key", "language", F.coalesce("title_short", "title").alias("t")))
    whole = docs.join(moved.select("group_key", "first_change"), "group_key").groupBy("group_key").agg(
        F.countDistinct("key").alias("versions_total"), titled["t"].alias("title"), F.max(F.when(F.col("valid_from") < F.col("first_change"), F.col("valid_from"))).alias("baseline")
    )
    return moved.join(whole, "group_key")


def wording_comparison(changes: DataFrame, docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """``distinct_texts`` (0 no text, 1 same, 2 different) and ``text_comparable`` of each change row.

    The states compared are those in force at the baseline (else the first change) and at
    the last change; of siblings of one day the smallest rid.  Provisions are reduced to one
    digest per expression before any join with the report.
    """
    spans = changes.select("group_key", F.coalesce("baseline", "first_change").alias("on_a"), F.col("last_change").alias("on_b"))
    live = docs.where("not withdrawn").select("group_key", "valid_from", "valid_to", "rid").join(spans, "group_key")
    held = lambda on: F.bool_or(contains(F.col(on)))
    days = live.groupBy("group_key", "valid_from").agg(F.min("rid").alias("rid"), held("on_a").alias("a"), held("on_b").alias("b"))
    latest = lambda side: F.max(F.when(F.col(side), F.struct("valid_from", "rid")))["rid"]
    states = days.groupBy("group_key").agg(latest("a").alias("a"), latest("b").alias("b"))
    found = states.select("group_key", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("rid")), F.struct(F.lit("b").alias("side"), F.col("b").alias("rid")))).alias("e")).select("group_key", "e.side", "e.rid")
    digests = wording_digests(found.where("rid is not null").select("rid").distinct(), provisions)
    worded = found.join(digests, "rid").groupBy("group_key").agg(
        F.max(F.when(F.col("side") == "a", F.col("wording"))).alias("wa"), F.max(F.when(F.col("side") == "b", F.col("wording"))).alias("wb")
    )
    joined = changes.join(worded, "group_key", "left")
    n = F.when(F.col("wa").isNull() & F.col("wb").isNull(), 0).when(F.col("wa").isNull() | F.col("wb").isNull(), 2).when(F.col("wa") == F.col("wb"), 1).otherwise(2)
    return joined.withColumns({"distinct_texts": n, "text_comparable": F.col("wa").isNotNull() & F.col("wb").isNotNull()}).drop("wa", "wb")


def change_totals(docs: DataFrame, first: str, last: str, filters: FilterSet = FilterSet()) -> DataFrame:
    window = apply_filters(docs, filters).where(F.col("valid_from").between(first, last))
    return window.agg(F.countDistinct("group_key").alias("works"), F.countDistinct("key").alias("versions"))


def population(docs: DataFrame, filters: FilterSet = FilterSet()) -> DataFrame:
    return apply_filters(docs, filters).agg(F.countDistinct("group_key").alias("works"))


def newest_known(column: str):
    """The newest non-blank value of a column within its group, else null."""
    known = F.col(column).isNotNull() & (F.col(column) != "")
    return F.max(F.when(known, F.struct("valid_from", "key", "language", F.col(column).alias("v"))))["v"].alias(column)


def catalogue(docs: DataFrame, filters: FilterSet = FilterSet(), has_text: bool | None = None) -> DataFrame:
    """One row per work: counts, dates and, field by field, the newest value that is known.

    A kind in the filter admits the whole work if any of its live rows has it.
    """
    rows = apply_filters(docs, FilterSet(filters.collection, None, filters.language, filters.works, filters.as_of))
    if filters.kind is not None:
        rows = rows.join(docs.where((F.col("kind") == filters.kind) & ~F.col("withdrawn")).select("group_key").distinct(), "group_key", "left_semi")
    public = F.coalesce("text_public", F.lit(False))
    out = rows.groupBy("group_key").agg(
        F.max(F.struct("valid_from", "key", "language", "collection"))["collection"].alias("collection"),
        newest_known("title"), newest_known("title_short"), newest_known("kind"),
        F.countDistinct("key").alias("versions"), F.countDistinct(F.when(public, F.col("key"))).alias("text_versions"),
        F.min("valid_from").alias("first_from"), F.max("valid_from").alias("last_from"), F.max(public).alias("has_text"), F.max("observed_from").alias("last_observed"),
    )
    return out if has_text is None else out.where(F.col("has_text") == has_text)


#: Orders of a catalogue page; group_key decides between equals.
ORDERS = {
    "name": lambda: [F.col("group_key")],
    "most_versions": lambda: [F.col("versions").desc(), F.col("group_key")],
    "most_recent": lambda: [F.col("last_from").desc(), F.col("group_key")],
    "oldest": lambda: [F.col("first_from"), F.col("group_key")],
}


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordered result; a bounded top-k, nothing is sorted in full."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def coverage(docs: DataFrame) -> DataFrame:
    """One row: works, expressions, versions, dates and how many have public text."""
    public = F.coalesce("text_public", F.lit(False))
    return docs.where("not withdrawn").agg(
        F.countDistinct("group_key").alias("works"), F.count(F.lit(1)).alias("expressions"), F.countDistinct("key").alias("versions"),
        _min("valid_from"), _max("valid_from"), F.sum(public.cast("long")).alias("with_text"), F.countDistinct(F.when(public, F.col("key"))).alias("text_versions"),
    )


def _min(column: str):
    return F.min(column).cast("string").alias("first_from")


def _max(column: str):
    return F.max(column).cast("string").alias("last_from")


def coverage_by(docs: DataFrame, column: str) -> DataFrame:
    public = F.coalesce("text_public", F.lit(False))
    return docs.where("not withdrawn").groupBy(column).agg(
        F.countDistinct("group_key").alias("works"), F.count(F.lit(1)).alias("expressions"), F.countDistinct("key").alias("versions"), F.countDistinct(F.when(public, F.col("key"))).alias("text_versions")
    )


def multilingual_works(docs: DataFrame) -> DataFrame:
    return docs.where("not withdrawn").groupBy("group_key").agg(F.countDistinct("language").alias("languages")).where("languages > 1")


def usual_language(docs: DataFrame, distinct: bool = True) -> DataFrame:
    """The language that most versions (or rows) of a work are in; the first of equals."""
    n = F.countDistinct("key") if distinct else F.count(F.lit(1))
    counts = docs.groupBy("group_key", "language").agg(n.alias("n"))
    best = counts.groupBy("group_key").agg(F.min(F.struct((-F.col("n")).alias("m"), "language", "n")).alias("b"))
    return best.select("group_key", F.col("b.language").alias("language"), F.col("b.n").alias("n"))


def facets(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct values of the facet columns with the works that have them, from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    rows = docs.where("not withdrawn").select("group_key", pairs.alias("f")).select("group_key", "f.facet", "f.value").where("value is not null and value <> ''")
    return rows.groupBy("facet", "value").agg(F.countDistinct("group_key").alias("works"))


def work_records(docs: DataFrame) -> DataFrame:
    """Per work and language the newest row's metadata and all titles ever borne."""
    newest = F.max(F.struct("valid_from", "key", "title", "kind", "group_identifier"))
    titles = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(F.array("title", "title_short"))))))
    rows = docs.groupBy("group_key", "language").agg(newest.alias("n"), titles.alias("titles"))
    return rows.select("group_key", "language", F.col("n.valid_from").cast("string").alias("valid_from"), "n.title", "n.kind", "n.group_identifier", F.array_join("titles", "|").alias("titles"), F.size("titles").cast("long").alias("n_titles"))


def sitemap(docs: DataFrame) -> DataFrame:
    """Addresses of versions with the time when they were last seen to change."""
    return docs.where("not withdrawn").groupBy("collection", "group_key", "key").agg(F.max("observed_from").cast("string").alias("last_observed"))


def manifest(docs: DataFrame) -> DataFrame:
    """Counters of a collection's build."""
    live = docs.where("not withdrawn")
    public = F.coalesce("text_public", F.lit(False)).cast("long")
    return live.groupBy("collection").agg(
        F.countDistinct("group_key").alias("works"), F.countDistinct("key").alias("versions"), F.countDistinct("kind").alias("kinds"), F.countDistinct("language").alias("languages"),
        _min("valid_from"), _max("valid_from"), F.sum(public).alias("with_text"), F.sum(1 - public).alias("without_text"),
    )


def build_status(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``collection, expected, held, status``: complete, incomplete, overfull or unavailable."""
    rows = expected.join(found, "collection", "left")
    status = F.when(F.col("held").isNull(), "unavailable").when(F.col("held") < F.col("expected"), "incomplete").when(F.col("held") > F.col("expected"), "overfull").otherwise("complete")
    return rows.withColumn("status", status)
