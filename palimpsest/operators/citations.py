"""Citation edges: what a work cites, what cites it, and which work an href means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import broadcast_if_small


def href_slug(href):
    """The slug of an ELI href: what follows ``/eli/`` and two segments, joined by hyphens.

    Query, fragment, ``jo`` and the consolidation date are no part of it; null for others.
    """
    tidy = F.lower(F.trim(F.regexp_replace(href, "(?s)[?#].*$", "")))
    after = F.when(F.instr(tidy, "/eli/") > 0, F.substring_index(F.concat(F.lit(" "), tidy), "/eli/", -1))
    segments = F.filter(F.split(after, "/"), lambda s: s != "")
    rest = F.slice(segments, F.lit(3), F.greatest(F.size(segments), F.lit(0)))
    at = F.array_position(rest, "consolide").cast("int")
    head = F.when(at > 0, F.slice(rest, 1, F.greatest(at - 1, F.lit(0)))).otherwise(rest)
    return F.nullif(F.array_join(F.filter(head, lambda s: s != "jo"), "-"), F.lit(""))


def resolved(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """The citations with the work that each means as ``cited_slug``; null if it means none.

    The href decides: an ELI path, or a collection of docs, a colon and the work.  Only where
    it names no work does the slug that an earlier build stored stand in for it.
    """
    tidy = F.lower(F.trim(F.regexp_replace("href", "(?s)[?#].*$", "")))
    parts = F.split(tidy, ":")
    collections = docs.select(F.lower(F.trim("collection")).alias("_collection")).where("_collection <> ''").distinct().withColumn("_known", F.lit(True))
    rows = citations.withColumns({"_collection": F.when(F.size(parts) > 1, parts[0]), "_named": F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit(""))})
    rows = rows.join(broadcast_if_small(collections), "_collection", "left")
    slug = F.coalesce(href_slug(F.col("href")), F.when(F.col("_known"), F.col("_named")), F.lower("cited_slug"))
    return rows.withColumn("cited_slug", slug).select(*citations.columns)


def citation_targets(citations: DataFrame, works: DataFrame) -> DataFrame:
    """``citation_id, slug, target, matched``: the held work that a citation means.

    The slug (of the href, else as stored) is a work, or else the longest work of which it
    is a continuation at a hyphen.  Prefixes are generated from the slug, one per hyphen,
    and looked up by an equi-join: no comparison of every slug with every work.
    """
    slug = F.coalesce(href_slug(F.col("href")), F.lower("cited_slug"))
    rows = citations.select("citation_id", slug.alias("slug")).where("slug is not null")
    slugs = rows.select("slug").distinct()
    parts = F.split("slug", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), "-").alias("target")))
    tried = slugs.select("slug", F.explode(prefixes).alias("p")).select("slug", "p.n", "p.target")
    best = tried.join(works.select(F.lower("group_key").alias("target")).distinct(), "target", "left_semi").groupBy("slug").agg(F.max(F.struct("n", "target"))["target"].alias("target"))
    matched = F.when(F.col("target").isNull(), "none").when(F.col("target") == F.col("slug"), "exact").otherwise("prefix")
    return rows.join(best, "slug", "left").withColumn("matched", matched)


def citations_of(citations: DataFrame) -> DataFrame:
    """Per citing expression how many edges, distinct targets and hrefs it has."""
    return citations.groupBy("rid").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("cited_slug").alias("targets"), F.countDistinct("href").alias("hrefs"))


def cited_by(citations: DataFrame, docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """Distinct citing places of every cited work: version, day, anchor and its number.

    Live citing versions only; the number is null where the anchor is not held.  The cited
    work is what the href means (see ``resolved``).
    """
    edges = resolved(citations, docs).where("cited_slug is not null").select("rid", "anchor", "cited_slug").distinct()
    citing = docs.where("not withdrawn").select("rid", "group_key", "key", "valid_from")
    nums = provisions.select("rid", "anchor", "num").distinct()
    return edges.join(citing, "rid").join(nums, ["rid", "anchor"], "left").select("cited_slug", "group_key", "key", "valid_from", "anchor", "num").distinct()


def most_cited(citations: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """The works cited by most distinct live works."""
    edges = resolved(citations, docs).where("cited_slug is not null").select("rid", "cited_slug").distinct()
    rows = edges.join(docs.where("not withdrawn").select("rid", "group_key"), "rid")
    return rows.groupBy("cited_slug").agg(F.countDistinct("group_key").alias("works")).orderBy(F.col("works").desc(), "cited_slug").limit(limit)


def closure(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """The seeds' neighbours in either direction (depth one), without the seeds themselves."""
    s = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct()
    out = edges.join(s, edges[source] == s["node"]).select(F.col(target).alias("node"))
    back = edges.join(s, edges[target] == s["node"]).select(F.col(source).alias("node"))
    return out.unionByName(back).where("node is not null").distinct().join(s, "node", "left_anti")
