"""Change events as a stream into the index.

Watchers append files of events (seq, op, path) to a folder; op is create, change, save or delete. File streams never
report deletions, so these come as events too. One query at a time works on an index: events that arrive during a batch
are taken together by the next.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.sources.ingest import Index

EVENTS = "seq bigint, op string, path string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(folder)


def follow(spark: SparkSession, index: Index, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Apply the events of `folder` to the index: what is there now, or with `every` ('2 seconds') on and on.

    A batch that failed is repeated from the checkpoint; replacing a file's rows by its present state is idempotent.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.apply_changes(batch)

    writer = events(spark, folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def head_of(project: str) -> str:
    """What a project's HEAD names: the commit of its branch, or the commit itself; '' where there is none."""
    try:
        with open(os.path.join(project, ".git", "HEAD")) as f:
            named = f.read().strip()
        if not named.startswith("ref: "):
            return named
        with open(os.path.join(project, ".git", named[5:])) as f:
            return f"{named} {f.read().strip()}"
    except OSError:
        return ""


def follow_head(spark: SparkSession, index: Index, project: str, every: str = "2 seconds") -> StreamingQuery:
    """Look at the project's HEAD again and again, and refresh the index when it names another commit than before.

    A refresh that takes longer than `every` delays the next look; looks that were due meanwhile are one.
    """
    last = [head_of(project)]

    def look(_: DataFrame, __: int) -> None:
        now = head_of(project)
        if now != last[0]:
            index.refresh(project)
            last[0] = now

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(look).trigger(processingTime=every).start()


def event_counts(stream: DataFrame) -> DataFrame:
    """How many events of each kind came in so far, by directory."""
    return stream.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), "op").agg(F.count("*").alias("n_events"))
