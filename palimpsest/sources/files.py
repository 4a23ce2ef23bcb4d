"""Files of a corpus: nested JSON in, datasets out, commits that are whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DERIVED = T.StructType(
    [
        T.StructField("lex_id", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("valid_from", T.StringType()),
        T.StructField("valid_to", T.StringType()),
        T.StructField(
            "provisions",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("anchor", T.StringType()),
                        T.StructField("type", T.StringType()),
                        T.StructField("num", T.StringType()),
                        T.StructField("heading", T.StringType()),
                        T.StructField("path", T.ArrayType(T.StringType())),
                        T.StructField("article_valid_from", T.StringType()),
                        T.StructField("text_md", T.StringType()),
                        T.StructField("text_sha256", T.StringType()),
                        T.StructField("citations", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))),
                    ]
                )
            ),
        ),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("work", T.StringType()),
        T.StructField(
            "anchors_by_language",
            T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("valid_from", "valid_to", "text_sha256", "in_version")])))),
        ),
    ]
)


def read_derived(spark: SparkSession, path: str) -> DataFrame:
    """Derived documents, one JSON object a file; the schema is given, nothing is inferred."""
    return spark.read.schema(DERIVED).option("multiLine", True).json(path)


def derived_provisions(derived: DataFrame) -> DataFrame:
    """One row per provision that has text; ``seq`` counts after empty ones are left out."""
    kept = F.filter("provisions", lambda p: F.coalesce(p["text_md"], F.lit("")) != "")
    rows = derived.select("lex_id", "language", F.col("valid_from").cast("date").alias("valid_from"), F.posexplode(kept).alias("seq", "p"))
    sha = F.sha2("p.text_md", 256)
    return rows.select("lex_id", "language", "valid_from", "seq", "p.anchor", F.col("p.type").alias("ptype"), "p.num", "p.heading", F.array_join("p.path", " / ").alias("path"), "p.text_md", sha.alias("text_sha"), (F.lower("p.text_sha256") == sha).alias("sha_ok"), "p.citations")


def derived_citations(provisions: DataFrame) -> DataFrame:
    return provisions.select("lex_id", "language", "anchor", F.explode("citations").alias("c")).select("lex_id", "language", "anchor", "c.href", F.col("c.text").alias("label"))


def derived_documents(docs: DataFrame, provisions: DataFrame, texts: DataFrame) -> DataFrame:
    """``rid, document``: every expression with its provisions as a derived document, a struct of ``DERIVED``.

    The text of one expression is one row.
    """
    rows = provisions.join(texts, "text_sha", "left")
    link = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())]))
    one = F.struct(
        "anchor", F.col("ptype").alias("type"), "num", "heading", F.when(F.col("path").isNotNull(), F.split("path", " / ")).alias("path"), F.lit(None).cast("string").alias("article_valid_from"),
        F.col("text").alias("text_md"), F.col("text_sha").alias("text_sha256"), F.array().cast(link).alias("citations"),
    )
    own = rows.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "anchor", one.alias("p")))), lambda x: x["p"]).alias("provisions"))
    head = docs.select("rid", F.col("key").alias("lex_id"), "language", "title", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))
    return head.join(own, "rid").select("rid", F.struct("lex_id", "language", "title", "valid_from", "valid_to", "provisions").alias("document"))


def derived_markdown(derived: DataFrame) -> DataFrame:
    """``lex_id, language, markdown``: a derived document as text with a front matter; headings of a path stand where it changes."""
    changed = lambda p, i: (F.coalesce(F.array_join(p["path"], " / "), F.lit("")) != "") & ((i == 0) | (F.coalesce(F.array_join(p["path"], " / "), F.lit("")) != F.coalesce(F.array_join(F.get("provisions", i - 1)["path"], " / "), F.lit(""))))
    part = F.transform("provisions", lambda p, i: F.concat(F.when(changed(p, i), F.concat(F.lit("## "), F.array_join(p["path"], " / "), F.lit("\n\n"))).otherwise(""), F.when(F.concat_ws(" — ", p["num"], p["heading"]) != "", F.concat(F.lit("### "), F.concat_ws(" — ", p["num"], p["heading"]), F.lit("\n\n"))).otherwise(""), F.coalesce(p["text_md"], F.lit(""))))
    front = F.concat(F.lit("---\nlex_id: "), "lex_id", F.lit("\nlanguage: "), "language", F.lit("\nvalid_from: "), F.coalesce("valid_from", F.lit("")), F.lit("\nvalid_to: "), F.coalesce("valid_to", F.lit("")), F.lit("\n---\n\n"))
    return derived.select("lex_id", "language", F.concat(front, F.array_join(part, "\n\n")).alias("markdown"))


def nested_history(runs: DataFrame) -> DataFrame:
    """``work, anchors_by_language``: wording runs as the nested maps of ``HISTORY``; the runs of one work are one row."""
    state = F.struct(F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), F.col("text_sha").alias("text_sha256"), "in_version")
    anchors = runs.groupBy(F.col("group_key").alias("work"), "language", "anchor").agg(F.array_sort(F.collect_list(state)).alias("states"))
    languages = anchors.groupBy("work", "language").agg(F.map_from_entries(F.collect_list(F.struct("anchor", "states"))).alias("anchors"))
    return languages.groupBy("work").agg(F.map_from_entries(F.collect_list(F.struct("language", "anchors"))).alias("anchors_by_language"))


META = T.StructType(
    [
        T.StructField("lex_id", T.StringType()),
        T.StructField("work", T.StringType()),
        T.StructField("valid_from", T.StringType()),
        T.StructField("valid_to", T.StringType()),
        T.StructField("events", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("event", "at")]))),
        T.StructField("expressions", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("language", "valid_from", "valid_to", "sha256", "source_uri")]))),
    ]
)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The records of a corpus directory, ``works/*/versions/*/meta.json`` under ``path``; the schema is given."""
    return spark.read.schema(META).option("multiLine", True).json(f"{path}/works/*/versions/*/meta.json")


def meta_expressions(meta: DataFrame) -> DataFrame:
    """An expression a row; withdrawn is what the last of withdrawn and resighted says."""
    told = F.filter("events", lambda e: e["event"].isin("withdrawn", "resighted"))
    last = F.element_at(F.array_sort(F.transform(told, lambda e: F.struct(e["at"].alias("at"), e["event"].alias("event")))), -1)["event"]
    gone = F.when(F.size(told) > 0, last == "withdrawn").otherwise(F.lit(False))
    return meta.select("lex_id", "work", gone.alias("withdrawn"), F.explode("expressions").alias("x")).select("lex_id", "work", "withdrawn", "x.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Wording states out of nested maps, a row each."""
    return history_states(spark.read.schema(HISTORY).option("multiLine", True).json(path))


def history_states(rows: DataFrame) -> DataFrame:
    by_language = rows.select("work", F.explode("anchors_by_language").alias("language", "anchors"))
    by_anchor = by_language.select("work", "language", F.explode("anchors").alias("anchor", "states"))
    return by_anchor.select("work", "language", "anchor", F.explode("states").alias("s")).select("work", "language", "anchor", "s.*")


POINTER = "CURRENT"


def _file_context(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf), target.getFileSystem(conf)


def staged_write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """``df`` written as a new version under ``path``, which the pointer then names; returns its folder.

    The pointer is one small file that is replaced in one step, so that readers see the old
    table or the new one and never none; a failure before that leaves the old table.  Folders
    that the pointer does not name stay until ``drop_stale``.
    """
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{folder}")
    jvm, context, fs = _file_context(spark, path)
    new, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f".{POINTER}-{folder}", POINTER))
    out = fs.create(new, True)
    out.write(bytearray(folder, "ascii"))
    out.close()
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, pointer, option)
    return f"{path}/{folder}"


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that is in place."""
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def drop_stale(spark: SparkSession, path: str) -> int:
    """Removes the versions that the pointer does not name; returns how many."""
    jvm, _, fs = _file_context(spark, path)
    kept, n = current(spark, path).rsplit("/", 1)[1], 0
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name != kept:
            fs.delete(status.getPath(), True)
            n += 1
    return n


def export_dataset(provisions: DataFrame, path: str) -> None:
    """Provisions as compressed JSON lines, a directory per publisher."""
    publisher = F.substring_index("rid", ":", 1)
    provisions.withColumn("publisher", publisher).write.mode("overwrite").partitionBy("publisher").option("compression", "gzip").json(path)


def evidence(rows: DataFrame) -> DataFrame:
    """A citation line of each provision, for quoting."""
    line = F.concat_ws(", ", F.col("work_title"), F.when(F.col("num").isNotNull(), F.concat(F.lit("art. "), F.col("num"))), F.concat(F.lit("version "), F.split("rid", "\\|")[2]))
    return rows.select("rid", "anchor", line.alias("citation"))
