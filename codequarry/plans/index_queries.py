"""Queries over an index that is built on disk from the project tables' texts: every text becomes a file of a tree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import storage
from codequarry.plans import text_sql
from codequarry.plans.source_queries import sources
from codequarry.session import workspace
from codequarry.sources.ingest import Index
from codequarry.streaming.changes import follow


def _local(spark: SparkSession, folder: str) -> str:
    fs, path = storage._fs(spark, folder)
    if fs.getScheme() != "file":
        raise RuntimeError("a tree of files can be walked only where the shared folder is mounted: name it file:///...")
    return path.toUri().getPath()


def _tree(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Write every text as a file; the folder of the tree and a folder for what belongs to it."""
    folder = workspace(spark, "tree")
    root = _local(spark, folder) + "/project"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            for path, text in zip(b["path"], b["source_text"], strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "w", newline="", encoding="utf-8") as f:
                    f.write(text)
            yield pd.DataFrame({"path": b["path"]})

    sources(spark, sf_dir).mapInPandas(write, "path string").write.parquet(f"{folder}/written")
    return root, folder


def built(spark: SparkSession, sf_dir: str) -> tuple[Index, str, str]:
    root, folder = _tree(spark, sf_dir)
    index = Index(spark, f"{folder}/index")
    index.build(root)
    return index, root, folder


def _without_root(rows: DataFrame, root: str, column: str = "file_path") -> DataFrame:
    return rows.withColumn(column, F.expr(f"substring({column}, {len(root) + 2})"))


def index_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root, _ = built(spark, sf_dir)
    return _without_root(index.definitions(), root)


def index_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, root, _ = built(spark, sf_dir)
    return _without_root(index.refs(), root).distinct()


def index_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the index with whether they have a modification time; and what the index says of itself."""
    index, root, _ = built(spark, sf_dir)
    rows = _without_root(index.files(), root, "path")
    return rows.select("path", (F.col("mtime") > 0).alias("timed"), F.lit(index.version() > 0 and not index.is_empty()).alias("whole"))


def index_after_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules after all files under `deps` were deleted and every other file got one more module at its end."""
    index, root, _ = built(spark, sf_dir)
    before = index.refresh(root)  # nothing changed

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            for path in b["path"]:
                if "/deps/" in path:
                    os.remove(path)
                else:
                    with open(path, "a", encoding="utf-8") as f:
                        f.write("\ndefmodule Added.Later do\nend\n")
                    os.utime(path, ns=(1, 1))  # another time, though an older one
            yield pd.DataFrame({"path": b["path"]})

    index.files().mapInPandas(change, "path string").write.format("noop").mode("overwrite").save()
    done = index.refresh(root)
    modules = index.definitions().where("function = '' AND kind = 'module'").groupBy("module").agg(F.count("*").alias("n_rows"))
    return modules.select("module", "n_rows", F.lit(before["changed"] + before["removed"]).alias("before"), F.lit(done["changed"]).alias("changed"), F.lit(done["removed"]).alias("removed"))


def index_after_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions after a stream of events that says of every file under `deps` that it was deleted, and of some others that
    they were changed (they were not, so their rows come again)."""
    index, root, folder = built(spark, sf_dir)
    events = index.files().select(
        F.lit(1).cast("bigint").alias("seq"), F.when(F.contains("path", F.lit("/deps/")), "delete").otherwise("change").alias("op"), "path"
    ).where("op = 'delete' OR path LIKE '%/test/%'")
    events.write.json(f"{folder}/events")
    follow(spark, index, f"{folder}/events", f"{folder}/progress").awaitTermination()
    return _without_root(index.definitions(), root)


QUERIES = {f.__name__: f for f in (index_definitions, index_references, index_paths, index_after_refresh, index_after_events)}
SQL = {
    "index_definitions": text_sql.SQL["parse_definitions"],
    "index_references": text_sql.SQL["parse_references"],
    "index_paths": text_sql.TEXTS + "SELECT path, true AS timed, true AS whole FROM S",
    "index_after_refresh": text_sql.DEFINED
    + """, N AS (SELECT count(*) FILTER (WHERE path NOT LIKE '%/deps/%') AS changed, count(*) FILTER (WHERE path LIKE '%/deps/%') AS removed FROM S),
M AS (SELECT module, CAST(count(*) AS BIGINT) AS n_rows FROM PD WHERE function = '' AND kind = 'module' AND file_path NOT LIKE '%/deps/%' GROUP BY module
    UNION ALL SELECT 'Added.Later', changed FROM N)
SELECT module, n_rows, 0 AS before, changed, removed FROM M, N""",
    "index_after_events": text_sql.DEFINED + "SELECT * EXCLUDE (callable) FROM PD WHERE file_path NOT LIKE '%/deps/%'",
}
