"""Wording histories of provisions, anchor events and comparisons of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.snapshots import snapshot_order

WORK = ["group_key", "language"]


def version_sequence(docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """``group_key, language, rid, key, valid_from, valid_to, ordinal, next_rid`` of versions that have provisions.

    Versions of one day are steps of their own, in order of key.  Numbered over versions
    only, before any provision is joined, and by day within a work, so that a work with a
    third of all versions is not one task.
    """
    held = provisions.select("rid").distinct()
    rows = docs.join(held, "rid", "left_semi").select(*WORK, "rid", "key", "valid_from", "valid_to")
    order = snapshot_order(rows.select("rid", "key", F.struct(*WORK).alias("chain"), F.substring_index("key", "--", 1).alias("day")))
    return rows.join(order.select("rid", (F.col("k") + 1).alias("ordinal"), "next_rid"), "rid")


def wording_runs(docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """Maximal runs of versions in which an anchor keeps its text.

    A run breaks where the hash changes or where the anchor is missing from a version
    between.  Start, version and article date are those of the first version of the run and
    the end that of its last; ``validity_conflict`` marks an article date other than the
    start.  ``provisions`` has rid, anchor, text_sha and article_valid_from.  Partitions are
    (work, language, anchor), so that the work with most rows is spread over its anchors.
    """
    steps = version_sequence(docs, provisions).join(provisions, "rid")
    steps = steps.groupBy(*WORK, "anchor", "ordinal", "key", "valid_from", "valid_to").agg(F.min(F.struct("text_sha", "article_valid_from")).alias("t"))
    steps = steps.withColumns({"text_sha": F.col("t.text_sha"), "article_valid_from": F.col("t.article_valid_from")}).drop("t")
    order = Window.partitionBy(*WORK, "anchor").orderBy("ordinal")
    broken = (F.lag("ordinal").over(order) != F.col("ordinal") - 1) | ~F.lag("text_sha").over(order).eqNullSafe(F.col("text_sha"))
    marked = steps.withColumn("breaks", F.when(F.coalesce(broken, F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("breaks").over(order))
    first = F.min(F.struct("ordinal", "valid_from", "key", "article_valid_from"))
    last = F.max(F.struct("ordinal", "valid_to"))
    runs = marked.groupBy(*WORK, "anchor", "run").agg(first.alias("f"), last.alias("l"), F.min("text_sha").alias("text_sha"), F.count(F.lit(1)).alias("versions"))
    article = F.col("f.article_valid_from")
    return runs.select(
        *WORK, "anchor", F.col("f.valid_from").alias("valid_from"), F.col("l.valid_to").alias("valid_to"), "text_sha", F.col("f.key").alias("in_version"),
        article.alias("article_valid_from"), F.coalesce(article != F.col("f.valid_from"), F.lit(False)).alias("validity_conflict"), "versions",
    )


def anchor_events(docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """``inserted``, ``removed`` and ``renumbered`` anchors between consecutive versions.

    A removed and an inserted anchor of the same text are one renumbering if the text occurs
    once among either.  Every version's anchors meet those of its predecessor by ordinal.
    """
    steps = version_sequence(docs, provisions)
    rows = steps.join(provisions, "rid").groupBy(*WORK, "ordinal", "anchor").agg(F.min("text_sha").alias("text_sha"))
    later = steps.where("ordinal > 1").select(*WORK, "ordinal", F.col("key").alias("at_version"))
    # each anchor of a version speaks for that version and, as its past, for the next one
    sides = F.explode(F.array(F.struct(F.lit("inserted").alias("etype"), F.col("ordinal").alias("ordinal")), F.struct(F.lit("removed").alias("etype"), (F.col("ordinal") + 1).alias("ordinal"))))
    spoken = rows.select(*WORK, "anchor", "text_sha", sides.alias("s")).select(*WORK, "s.ordinal", "anchor", "text_sha", "s.etype")
    single = spoken.groupBy(*WORK, "ordinal", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("etype").alias("etype"), F.min("text_sha").alias("text_sha")).where("n = 1")
    changed = single.drop("n").join(later, [*WORK, "ordinal"])
    by_text = changed.groupBy(*WORK, "ordinal", "at_version", "text_sha").agg(
        F.sum((F.col("etype") == "inserted").cast("int")).alias("ins"), F.sum((F.col("etype") == "removed").cast("int")).alias("rem"),
        F.min(F.when(F.col("etype") == "inserted", F.col("anchor"))).alias("to_anchor"), F.min(F.when(F.col("etype") == "removed", F.col("anchor"))).alias("from_anchor"),
    )
    matched = by_text.where("ins = 1 and rem = 1")
    none = F.lit(None).cast("string")
    moves = matched.select(*WORK, "at_version", F.lit("renumbered").alias("etype"), "from_anchor", "to_anchor", none.alias("anchor"), "text_sha")
    rest = changed.join(matched, [*WORK, "ordinal", "at_version", "text_sha"], "left_anti")
    return moves.unionByName(rest.select(*WORK, "at_version", "etype", none.alias("from_anchor"), none.alias("to_anchor"), "anchor", none.alias("text_sha")))


def consecutive(docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """Pairs ``from_rid, to_rid`` of consecutive versions that have provisions."""
    steps = version_sequence(docs, provisions).where("next_rid is not null")
    return steps.select(*WORK, F.col("rid").alias("from_rid"), F.col("next_rid").alias("to_rid"))


def version_diff(pairs: DataFrame, provisions: DataFrame) -> DataFrame:
    """Anchor by anchor, how two versions compare: equal, changed, only_from or only_to."""
    of = provisions.groupBy("rid", "anchor").agg(F.min("text_sha").alias("text_sha"))
    sides = pairs.select("from_rid", "to_rid", F.explode(F.array(F.struct(F.lit("from").alias("side"), F.col("from_rid").alias("rid")), F.struct(F.lit("to").alias("side"), F.col("to_rid").alias("rid")))).alias("s"))
    rows = sides.select("from_rid", "to_rid", "s.side", "s.rid").join(of, "rid")
    sha = lambda side: F.max(F.when(F.col("side") == side, F.col("text_sha")))
    out = rows.groupBy("from_rid", "to_rid", "anchor").agg(sha("from").alias("from_sha"), sha("to").alias("to_sha"))
    state = F.when(F.col("from_sha").isNull(), "only_to").when(F.col("to_sha").isNull(), "only_from").when(F.col("from_sha") == F.col("to_sha"), "equal").otherwise("changed")
    return out.withColumn("state", state)


def continuity(diff: DataFrame, least: float = 0.5) -> DataFrame:
    """Share of the smaller anchor set that both versions have; comparable from ``least`` on."""
    n = lambda *states: F.sum(F.col("state").isin(*states).cast("long"))
    counts = diff.groupBy("from_rid", "to_rid").agg(n("equal", "changed").alias("shared"), n("equal", "changed", "only_from").alias("a"), n("equal", "changed", "only_to").alias("b"), n("changed").alias("changed"))
    share = F.round(F.col("shared") / F.least("a", "b"), 6)
    return counts.select("from_rid", "to_rid", "shared", "changed", F.coalesce(share, F.lit(0.0)).alias("continuity"), F.coalesce(share >= least, F.lit(False)).alias("comparable"))


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and a digest of a table that no order of its rows can change.

    The sum of the leading 60 bits of each row's SHA-256: associative, so that it is a
    partial aggregate and needs no sort.  Nulls are told apart from empty strings.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(bits).cast("string").alias("digest"))


def document_bodies(provisions: DataFrame, texts: DataFrame) -> DataFrame:
    """``rid, body``: a version's text put together again from its provisions.

    Path headings where the path changes, then ``### num — heading`` and the text.
    """
    order = Window.partitionBy("rid").orderBy("seq", "anchor")
    rows = provisions.join(texts, "text_sha", "left")
    path = F.coalesce("path", F.lit(""))
    moved = (path != "") & ~path.eqNullSafe(F.lag(path).over(order))
    title = F.concat_ws(" — ", F.col("num"), F.col("heading"))
    part = F.concat(F.when(moved, F.concat(F.lit("## "), path, F.lit("\n\n"))).otherwise(""), F.when(title != "", F.concat(F.lit("### "), title, F.lit("\n\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    rows = rows.withColumn("part", part)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "anchor", "part")))
    return rows.groupBy("rid").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("body"))
