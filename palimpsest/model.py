"""The tables of a corpus with their dirt settled, and the filter that every read applies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.intervals import latest_rows
from palimpsest.session import table


@dataclass
class Corpus:
    """Cleaned views of the tables in a directory; lazy, so that unused columns are never read."""

    spark: SparkSession
    directory: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    @cached_property
    def docs(self) -> DataFrame:
        """One row per rid, the one observed last; 9999-12-31 is no end."""
        raw = self.raw("docs")
        rows = latest_rows(raw, "rid", "observed_from", raw.columns)
        return rows.withColumns(
            {"valid_to": F.when(F.col("valid_to") < F.lit("9999-12-31").cast("date"), F.col("valid_to")), "withdrawn": F.coalesce("withdrawn", F.lit(False))}
        )

    @cached_property
    def live(self) -> DataFrame:
        return self.docs.where("not withdrawn")

    def provisions(self, *columns: str, once: bool = True) -> DataFrame:
        """``rid, seq, anchor, text_sha`` and the named columns, repeated rows once, or as often as they come.

        text_sha is in lower case, or made from the text where it is missing.
        """
        sha = F.coalesce(F.lower("text_sha"), F.sha2("text_md", 256)).alias("text_sha")
        rows = self.raw("provisions").where("rid is not null").select("rid", "seq", "anchor", sha, *columns)
        return rows.distinct() if once else rows

    @cached_property
    def texts(self) -> DataFrame:
        """``text_sha, text``: each distinct text once; the store that provisions point into."""
        raw = self.raw("provisions").where("text_md is not null")
        return raw.select(F.sha2("text_md", 256).alias("text_sha"), F.col("text_md").alias("text")).dropDuplicates(["text_sha"])

    @cached_property
    def citations(self) -> DataFrame:
        raw = self.raw("citations")
        return raw.dropDuplicates(["citation_id"])

    @cached_property
    def observations(self) -> DataFrame:
        return self.raw("obs_history").dropDuplicates(["obs_id"])


@dataclass(frozen=True)
class FilterSet:
    """What a read is restricted to; withdrawn rows are never eligible.

    ``kind`` is a comma-separated list; if every member begins with ``!`` it excludes, and
    rows without a kind pass.
    """

    collection: str | None = None
    kind: str | None = None
    language: str | None = None
    works: tuple[str, ...] = ()
    as_of: str | None = None
    hierarchy: str | None = None
    act_form: str | None = None
    binding_status: str | None = None
    #: A member of the pipe-separated ``domains``.
    domain: str | None = None
    #: A role of the expression, and an identifier in the metadata of its version; see ``apply_filters``.
    document_role: str | None = None
    metadata_identifier: str | None = None

    def condition(self) -> Column:
        out = ~F.col("withdrawn")
        for name in ("hierarchy", "act_form", "binding_status"):
            if getattr(self, name) is not None:
                out &= F.col(name) == getattr(self, name)
        if self.domain is not None:
            out &= F.contains(F.concat(F.lit("|"), "domains", F.lit("|")), F.lit(f"|{self.domain}|"))
        if self.collection is not None:
            out &= F.col("collection") == self.collection
        kinds = [k.strip() for k in (self.kind or "").split(",") if k.strip()]
        if kinds and all(k.startswith("!") for k in kinds):
            out &= F.col("kind").isNull() | ~F.col("kind").isin([k[1:] for k in kinds])
        elif kinds:
            out &= F.col("kind").isin(kinds)
        if self.language is not None:
            out &= F.col("language") == self.language
        if self.works:
            out &= F.col("group_key").isin(list(self.works)) | F.col("group_identifier").isin(list(self.works))
        if self.as_of is not None:
            out &= contains(self.as_of)
        return out


def apply_filters(df: DataFrame, filters: FilterSet, roles: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` that a read may see.

    ``roles`` has rid and role; ``metadata`` group_key, language, valid_from, identifier and
    citation_identity, of which only rows that are no citation identity count, for the
    version of that very start.  A filter on what is not there lets nothing through.
    """
    rows = df.where(filters.condition())
    for value, table, of in ((filters.document_role, roles, ["rid"]), (filters.metadata_identifier, metadata, ["group_key", "language", "valid_from"])):
        if value is None:
            continue
        if table is None:
            return rows.limit(0)
        held = table.where(F.col("role") == value) if of == ["rid"] else table.where((F.col("identifier") == value) & ~F.coalesce("citation_identity", F.lit(False)))
        rows = rows.join(held.select(*of).distinct(), of, "left_semi")
    return rows


def overlong(df: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """``column, bound, rows, longest``: of each column how many values are longer than its bound."""
    length = lambda c: F.length(F.col(c).cast("string"))
    totals = df.agg(*[F.struct(F.count_if(length(c) > n).alias("rows"), F.max(length(c)).alias("longest")).alias(c) for c, n in bounds.items()])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(n).alias("bound"), F.col(f"{c}.rows").alias("rows"), F.col(f"{c}.longest").alias("longest")) for c, n in bounds.items()])
    return totals.select(F.explode(each).alias("x")).select("x.*")


def day(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def contains(value: str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Whether the interval holds the day; both ends are inside, a null end is open."""
    return (F.col(start) <= day(value)) & (F.col(end).isNull() | (F.col(end) >= day(value)))


def overlaps(first: str | Column, last: str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) <= day(last)) & (F.col(end).isNull() | (F.col(end) >= day(first)))
