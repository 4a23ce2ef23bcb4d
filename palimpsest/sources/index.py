"""The tables of a built corpus: written whole, opened only if whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.model import Corpus
from palimpsest.operators import citations, history, retrieval, rollups, search
from palimpsest.sources import files

#: Tables of an index and the columns that each must have.
TABLES = {
    "docs": ("rid", "key", "collection", "group_key", "language", "valid_from", "valid_to", "withdrawn"),
    "provisions": ("rid", "seq", "anchor", "text_sha", "ptype", "num", "heading", "path"),
    "texts": ("text_sha", "text"),
    "citations": ("citation_id", "slug", "target"),
    "provision_states": ("group_key", "language", "anchor", "valid_from", "text_sha", "in_version"),
    "anchor_events": ("group_key", "language", "at_version", "etype"),
    "work_records": ("group_key", "language", "title"),
    "work_names": ("work", "name", "kind"),
    "postings": ("rid", "anchor", "term", "tf", "length"),
}


def index_tables(corpus: Corpus) -> dict[str, DataFrame]:
    """Every table of an index, each a plan of its own."""
    states = retrieval.lexical_states(corpus.docs, corpus.provisions("work_title", "num", "heading")).join(corpus.texts, "text_sha", "left")
    return {
        "docs": corpus.docs,
        "provisions": corpus.provisions("ptype", "num", "heading", "path"),
        "texts": corpus.texts,
        "citations": citations.citation_targets(corpus.citations, corpus.docs),
        "provision_states": history.wording_runs(corpus.docs, corpus.provisions("article_valid_from")),
        "anchor_events": history.anchor_events(corpus.docs, corpus.provisions()),
        "work_records": rollups.work_records(corpus.docs),
        "work_names": search.name_records(corpus.docs),
        "postings": retrieval.postings(states, ["rid", "anchor"], {"work_title": 10.0, "num": 4.0, "heading": 6.0, "text": 1.0}),
    }


def write_index(corpus: Corpus, path: str) -> DataFrame:
    """Writes all tables, and last the manifest that makes them an index; returns the manifest.

    The manifest names the folder of each table with its rows and a digest that does not
    depend on their order; a failure before it leaves the index that was there.
    """
    spark, rows = corpus.spark, []
    for name, df in index_tables(corpus).items():
        folder = files.staged_write(df, f"{path}/{name}")
        held = history.table_digest(spark.read.parquet(folder), sorted(TABLES[name])).first()
        rows.append((name, folder, held["rows"], held["digest"]))
    manifest = spark.createDataFrame(rows, "table string, folder string, rows long, digest string")
    files.staged_write(manifest.coalesce(1), f"{path}/manifest")
    return manifest


def open_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index by name; raises if one is missing, lacks a column or is not what was written."""
    manifest = {r["table"]: r for r in files.read_current(spark, f"{path}/manifest").collect()}  # a row a table
    out = {}
    for name, columns in TABLES.items():
        if name not in manifest:
            raise ValueError(f"the index has no {name}")
        df = spark.read.parquet(manifest[name]["folder"])
        if lacking := set(columns) - set(df.columns):
            raise ValueError(f"{name} lacks {sorted(lacking)}")
        held = history.table_digest(df, sorted(columns)).first()
        if (held["rows"], held["digest"]) != (manifest[name]["rows"], manifest[name]["digest"]):
            raise ValueError(f"{name} is not what was written")
        out[name] = df
    return out


def write_catalog(corpus: Corpus, path: str) -> None:
    """Works, their wording histories and a catalogue of both."""
    works = rollups.catalogue(corpus.docs)
    runs = history.wording_runs(corpus.docs, corpus.provisions("article_valid_from"))
    files.staged_write(works, f"{path}/works")
    files.staged_write(files.nested_history(runs), f"{path}/history")
    counts = runs.groupBy("group_key").agg(F.count(F.lit(1)).alias("states"))
    files.staged_write(works.select("group_key", "versions").join(counts, "group_key", "left"), f"{path}/catalog")


def write_derived(corpus: Corpus, path: str) -> None:
    """Derived documents as compressed JSON lines, and their Markdown beside them, a folder per language."""
    rows = files.derived_documents(corpus.docs, corpus.provisions("ptype", "num", "heading", "path"), corpus.texts).select("document.*")
    rows.withColumn("lang", F.col("language")).write.mode("overwrite").partitionBy("lang").option("compression", "gzip").json(f"{path}/json")
    files.derived_markdown(rows).withColumn("lang", F.col("language")).write.mode("overwrite").partitionBy("lang").parquet(f"{path}/markdown")
