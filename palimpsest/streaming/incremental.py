"""Incremental forms: windowed counts with late data, and observations applied batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import scd
from palimpsest.session import checkpoint_dir, exists


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type in tumbling windows; the same plan for streams and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table's file as a stream, with the table's own schema."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def run_available(stream: DataFrame, spark: SparkSession, keys: tuple[str, ...] = ("start", "event_type")) -> DataFrame:
    """All that is there to read, aggregated and written to the shared folder; the newest row of each key.

    Only groups that a batch changed are written, each batch to a folder of its own that it
    replaces if it is run again, so that groups behind the watermark leave the state and
    what they last were stays in the output.
    """
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(changed).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def apply_observations(path: str, fields: list[str], whole: bool = False):
    """A ``foreachBatch`` function that appends what each batch of seen rows means to a table at ``path``.

    Late and repeated rows are new observations, never overwrites: the batch is reconciled
    with the state held so far, and only first sightings, revisions, closures and
    resightings are appended, under the batch's own directory, so that a batch that is run
    again after a failure replaces its own rows.  If a batch lists the ``whole`` source,
    what it does not list is marked as withdrawn at the time of its latest row.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = batch.where("rid is not null")
        columns = seen.columns
        rest = [c for c in columns if c not in ("rid", "observed_from")]
        seen = seen.groupBy("rid").agg(F.max(F.struct("observed_from", *rest)).alias("r")).select("rid", "r.*")
        if exists(spark, path):
            held = spark.read.parquet(path).where(F.col("batch") < number)
        else:
            held = seen.limit(0).withColumn("batch", F.lit(0))
        state = held.groupBy("rid").agg(F.max(F.struct("observed_from", *rest)).alias("r")).select("rid", "r.*")
        state = state.withColumn("withdrawn", F.coalesce("withdrawn", F.lit(False)))
        actions = scd.reconcile(state, seen, fields)
        new = seen.join(actions.where("action in ('first_seen', 'revised', 'interval_closed', 'resighted')"), "rid", "left_semi").select(*columns)
        if whole:
            now = seen.agg(F.max("observed_from").alias("now"))  # one row
            gone = state.join(actions.where("action = 'tombstoned'"), "rid", "left_semi").crossJoin(F.broadcast(now)).where("now is not null")
            new = new.unionByName(gone.withColumns({"withdrawn": F.lit(True), "observed_from": F.col("now")}).select(*columns))
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("batch").option("partitionOverwriteMode", "dynamic").parquet(path)

    return step
