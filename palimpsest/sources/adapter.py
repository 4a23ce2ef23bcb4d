"""Publishers as sources: what an adapter gives, one over recorded pages, and versions out of query results."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "work string, version string, valid_from date, valid_to date, language string, title string, kind string, body string, media string"


class Adapter(Protocol):
    """What a publisher's source must answer; every answer may be asked for again with the same result."""

    def works(self) -> Iterator[str]: ...

    def versions(self, work: str) -> list[dict]:
        """Records with the columns of ``VERSION`` but work; ``body`` names what to fetch, null if there is none."""

    def body(self, name: str) -> bytes: ...

    def alternatives(self, work: str, version: str) -> list[dict]:
        """Other manifestations of a version: format, name and size."""


class Recorded:
    """An adapter over recorded answers: ``works.json`` and a folder of JSON and bodies per work."""

    def __init__(self, folder: str):
        self.folder = folder

    def _json(self, *names: str):
        path = os.path.join(self.folder, *names)
        if not os.path.exists(path):
            return []
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def works(self) -> Iterator[str]:
        yield from self._json("works.json")

    def versions(self, work: str) -> list[dict]:
        return self._json(work, "versions.json")

    def body(self, name: str) -> bytes:
        with open(os.path.join(self.folder, name), "rb") as f:
            return f.read()

    def alternatives(self, work: str, version: str) -> list[dict]:
        return self._json(work, f"{version}.files.json")


def enumerate_versions(spark: SparkSession, adapter: Adapter, tasks: int = 8) -> DataFrame:
    """The versions of all works of an adapter; works are spread over ``tasks`` and each asked for its own.

    The adapter goes to the executors, so that only names of works pass the driver.
    """
    names = spark.createDataFrame(((w,) for w in adapter.works()), "work string").repartition(tasks, "work")
    columns = [c.split()[0] for c in VERSION.split(", ")]

    def fetch(batches):
        import datetime

        import pandas as pd

        for batch in batches:
            rows = []
            for work in batch["work"]:
                for v in adapter.versions(work):
                    rows.append([work, *(datetime.date.fromisoformat(v[c]) if c.startswith("valid_") and v.get(c) else v.get(c) for c in columns[1:])])
            yield pd.DataFrame(rows, columns=columns)

    return names.mapInPandas(fetch, VERSION)


def consolidations(bindings: DataFrame) -> DataFrame:
    """Versions out of the rows of a query: ``work, consolidation, date, language, title, kind``, a binding each.

    The bindings of one consolidation are one version: its date is the least, its titles
    are by language; the kind is the one given most often, the smaller of equals.  A
    consolidation without a date is no version.
    """
    rows = bindings.where("work is not null and consolidation is not null and date is not null").distinct()
    kinds = rows.where("kind is not null").groupBy("work", "consolidation", "kind").agg(F.count(F.lit(1)).alias("n"))
    kind = kinds.groupBy("work", "consolidation").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind"))["kind"].alias("kind"))
    versions = rows.groupBy("work", "consolidation").agg(F.min("date").alias("valid_from"), F.sort_array(F.collect_set(F.struct("language", "title"))).alias("titles"))
    following = Window.partitionBy("work").orderBy("valid_from")
    ends = versions.select("work", "valid_from").distinct().withColumn("valid_to", F.date_sub(F.lead("valid_from").over(following), 1))
    return versions.join(kind, ["work", "consolidation"], "left").join(ends, ["work", "valid_from"])


def acquired(versions: DataFrame, adapter: Adapter) -> DataFrame:
    """The versions with their bodies and what came of each: ok, no body named, empty, or the error.

    An empty body is a failure, not a text; a failure leaves the others as they are.
    """
    schema = T.StructType([*versions.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("outcome", T.StringType())])

    def fetch(batches):
        for batch in batches:
            content, outcome = [], []
            for name in batch["body"]:
                data, said = None, "no body"
                if name:
                    try:
                        data = adapter.body(name)
                        said = "ok" if data else "empty"
                    except OSError as e:
                        said = f"failed: {type(e).__name__}"
                content.append(data or None)
                outcome.append(said)
            yield batch.assign(content=content, outcome=outcome)

    return versions.mapInPandas(fetch, schema)
