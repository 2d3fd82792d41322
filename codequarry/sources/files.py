"""Source files: walking trees, reading texts, buffers that win over the disk, lines, and project roots."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.session import width

# Directories that are never walked, and the endings of source files.
SKIPPED_DIRS = frozenset(("_build", ".git", "node_modules"))
ENDINGS = (".ex", ".exs")
FILES = "path string, mtime bigint, size bigint"
#: Bytes of source text that one task reads.
READ_BYTES = 64 << 20


def _walk(root: str) -> Iterator[tuple[str, int, int]]:
    pending = [root]
    while pending:
        try:
            entries = list(os.scandir(pending.pop()))
        except OSError:
            continue
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in SKIPPED_DIRS:
                        pending.append(e.path)
                elif e.name.endswith(ENDINGS):
                    s = e.stat()
                    yield e.path, s.st_mtime_ns, s.st_size
            except OSError:
                continue


def walk_files(spark: SparkSession, root: str, spread: int = 64) -> DataFrame:
    """path, mtime (nanoseconds), size of every source file under `root`, hidden ones included.

    The driver opens directories only until there are `spread` of them; the trees below are walked by tasks. The
    root must be a path that every executor mounts. Unreadable entries are passed over; a missing root is empty.
    """
    level, files = [root], []
    while level and len(level) < spread:
        deeper: list[str] = []
        for d in level:
            try:
                entries = list(os.scandir(d))
            except OSError:
                continue
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in SKIPPED_DIRS:
                        deeper.append(e.path)
                elif e.name.endswith(ENDINGS):
                    files.append((e.path, e.stat().st_mtime_ns, e.stat().st_size))
        level = deeper

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d in b["path"]:
                yield pd.DataFrame(list(_walk(d)), columns=["path", "mtime", "size"])

    found = spark.createDataFrame(files, FILES)
    if level:
        trees = spark.createDataFrame([(d,) for d in level], "path string").repartition(min(len(level), 4 * width(spark)))
        found = found.unionByName(trees.mapInPandas(walk, FILES))
    return found


def read_texts(spark: SparkSession, files: DataFrame) -> DataFrame:
    """`files` (path, mtime, size) with `source_text`; NULL for what cannot be read. Tasks get about READ_BYTES each."""
    total = files.agg(F.sum("size")).first()[0] or 0
    n = max(1, min(100_000, total // READ_BYTES + 1, 10_000_000))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for p in b["path"]:
                try:
                    with open(p, "rb") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
            b["source_text"] = texts
            yield b

    return files.select("path", "mtime", "size").repartition(int(n), "path").mapInPandas(read, f"{FILES}, source_text string")


def fingerprints(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """path, observed_at, present, size, checksum of `files` (path): a listing for incremental batches, as of now.

    The checksum is that of the whole content, read in pieces. What cannot be read is not present.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                digest, size = hashlib.blake2b(digest_size=16), 0
                try:
                    with open(path, "rb") as f:
                        while piece := f.read(chunk):
                            digest.update(piece)
                            size += len(piece)
                    rows.append((path, True, size, digest.hexdigest()))
                except OSError:
                    rows.append((path, False, None, None))
            yield pd.DataFrame(rows, columns=["path", "present", "size", "checksum"]).astype({"size": "Int64"})

    found = files.select("path").mapInPandas(run, "path string, present boolean, size bigint, checksum string")
    return found.withColumn("observed_at", F.current_timestamp().cast("timestamp_ntz"))


def with_buffers(disk: DataFrame, buffers: DataFrame) -> DataFrame:
    """path, source_text: open buffers (path, source_text) win over the disk.

    Of several of one path the last change counts, by `seq` where buffers have it (equal ones: the greatest text); a change
    with a NULL text closes the buffer, and the disk counts again. Without `seq` the greatest text counts.
    """
    order = F.col("seq") if "seq" in buffers.columns else F.lit(0)
    b = buffers.groupBy("path").agg(F.max(F.struct(order.alias("n"), F.col("source_text").alias("t"))).alias("x"))
    b = b.where("x.t IS NOT NULL").select("path", F.col("x.t").alias("_buffer"), F.lit(True).alias("_open"))
    return disk.select("path", "source_text").join(b, "path", "full_outer").select(
        "path", F.when(F.col("_open"), F.col("_buffer")).otherwise(F.col("source_text")).alias("source_text")
    )


def lines(sources: DataFrame) -> DataFrame:
    """file_path, line (from 1), text of every line; line ends of either kind."""
    split = F.split("source_text", "\r\n|\n")
    return sources.where("source_text IS NOT NULL").select(
        F.col("path").alias("file_path"), F.posexplode(split).alias("_n", "text")
    ).select("file_path", (F.col("_n") + 1).alias("line"), "text")


def line_of(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """`keys` (file_path, line) with the text of the line; '' beyond the end of the file, NULL without a file."""
    s = sources.select(F.col("path").alias("file_path"), F.split("source_text", "\r\n|\n").alias("_lines"))
    return keys.join(s, "file_path", "left_outer").withColumn(
        "text", F.when(F.col("_lines").isNotNull(), F.coalesce(F.get("_lines", F.col("line") - 1), F.lit("")))
    ).drop("_lines")


def _ancestors(paths: DataFrame) -> DataFrame:
    """path, root: each distinct path with every directory above it; as many rows as a path has segments."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return paths.select("path").distinct().select("path", F.explode(above).alias("root"))


def nearest_roots(paths: DataFrame, markers: DataFrame, name: str = "mix.exs") -> DataFrame:
    """path, root: for each path the nearest directory above it that holds a marker of this name, '' without one."""
    where = markers.where(F.substring_index("path", "/", -1) == name).select(F.regexp_replace("path", "/?[^/]*$", "").alias("root")).distinct()
    best = _ancestors(paths).join(where, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(best, "path", "left_outer").select("path", F.coalesce("root", F.lit("")).alias("root"))


def dependency_files(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """Those paths that lie under the `deps` folder of a directory above them that holds a `mix.exs`."""
    where = markers.where(F.substring_index("path", "/", -1) == "mix.exs").select(F.regexp_replace("path", "/?[^/]*$", "").alias("root")).distinct()
    return _ancestors(paths).join(where, "root").where(F.startswith("path", F.concat("root", F.lit("/deps/")))).select("path").distinct()


def project_roots(paths: DataFrame, markers: DataFrame, names: list[str]) -> DataFrame:
    """path, root: for each path the nearest directory with the first of the marker `names` that any of its
    ancestors has; without one the path itself. `markers` has the path of every marker file or directory."""
    order = F.create_map(*[x for i, m in enumerate(names) for x in (F.lit(m), F.lit(i))])
    where = markers.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("root"), F.try_element_at(order, F.substring_index("path", "/", -1)).alias("rank")
    ).where("rank IS NOT NULL")
    parts = F.split("path", "/")
    up = paths.select("path").distinct().withColumn(
        "root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    )
    best = up.join(where, "root").groupBy("path").agg(F.min(F.struct("rank", (-F.length("root")).alias("near"), "root")).alias("x"))
    return paths.select("path").distinct().join(best, "path", "left_outer").select("path", F.coalesce("x.root", "path").alias("root"))
