"""The index on disk: files, definitions and references, replaced file by file.

Rows are dealt to buckets by the hash of their file. A write makes new folders for the touched buckets only and then one
small commit file that names the folder of every bucket; readers see the last commit, a failed write leaves nothing that
they see. Removing or replacing a file rewrites its bucket; the first write of an index reads nothing (bulk load).

A write begins from the commit that is the last then and takes the number after it. If another writer took that number in
the meantime, the write begins anew from what that one left, so that neither is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import storage
from codequarry.sources.facts import parse_facts, parsed_definitions, parsed_edges, parsed_references
from codequarry.sources.files import read_texts, walk_files

#: Raised whenever the stored tables would come out differently; another version's index is built anew.
INDEX_VERSION = 2
#: Source text for which a bucket is made, and how much larger buckets may grow before they are dealt anew.
BUCKET_BYTES, GROWTH = 64 << 20, 4
SCHEMAS = {
    "files": "path string, mtime bigint",
    "definitions": (
        "module string, function string, arity int, kind string, line int, file_path string, delegate_to string, "
        "delegate_as string, params string"
    ),
    "refs": "module string, function string, line int, file_path string, kind string",
    "edges": "module string, kind string, ordinal int, target string, function string, arity int, option string, file_path string",
}
_FILE_OF = {"files": "path", "definitions": "file_path", "refs": "file_path", "edges": "file_path"}
_SORTED_BY = {"files": ["path"], "definitions": ["file_path", "line"], "refs": ["file_path", "line"], "edges": ["file_path", "module"]}


def changed_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Files seen whose modification time is not exactly the stored one, or that are not stored."""
    s = stored.select("path", F.col("mtime").alias("_stored"))
    return (
        seen.join(s, "path", "left_outer")
        .where(F.col("_stored").isNull() | (F.col("_stored") != F.col("mtime")))
        .select(*seen.columns)
    )


class Conflict(RuntimeError):
    """Another writer committed first."""


class Index:
    """A stored index under `root`. `n_buckets` holds for its first write; 0 lets `build` choose by the size of the tree."""

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 0):
        self.spark, self.root, self._wanted = spark, root.rstrip("/"), n_buckets

    @property
    def n_buckets(self) -> int:
        return self._last()[1].get("n_buckets", self._wanted or 16)

    # -------------------------------------------------------- reading

    def _commits(self) -> list[str]:
        return [n for n in storage.names(self.spark, f"{self.root}/commits") if n.endswith(".json") and not n.startswith("_")]

    def _last(self) -> tuple[int, dict]:
        """Number and content of the last commit; one that cannot be read counts as empty, so that the index is built anew."""
        commits = self._commits()
        if not commits:
            return 0, {}
        try:
            return int(commits[-1].removesuffix(".json")), json.loads(storage.read_text(self.spark, f"{self.root}/commits/{commits[-1]}"))
        except ValueError:
            return int(commits[-1].removesuffix(".json")), {}

    def _read(self, table: str, state: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        state = self._last()[1] if state is None else state
        folders = {int(b): f for b, f in state.get("buckets", {}).items()}
        paths = [f"{self.root}/data/{f}/{table}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths)

    def files(self) -> DataFrame:
        return self._read("files")

    def definitions(self) -> DataFrame:
        return self._read("definitions")

    def refs(self) -> DataFrame:
        return self._read("refs")

    def edges(self) -> DataFrame:
        """What using each module brings (rows of `text_tables.using_edges`), worked out anew for changed files only."""
        return self._read("edges")

    def is_empty(self) -> bool:
        return self.files().isEmpty()

    def metadata(self, key: str) -> str:
        """A stored value, '' if there is none."""
        return self._last()[1].get("metadata", {}).get(key, "")

    def version(self) -> int:
        """0 if none is stored or it is no number."""
        value = self.metadata("index_version")
        return int(value) if value.isdigit() else 0

    # -------------------------------------------------------- writing

    def _commit(self, base: tuple[int, dict], change: dict) -> None:
        """Make `change` of the state that the write began from the next commit."""
        seq, state = base
        if not storage.write_text(self.spark, f"{self.root}/commits/{seq + 1:08d}.json", json.dumps(state | change)):
            raise Conflict(f"another writer committed number {seq + 1}")

    def _attempt(self, write: Callable[[tuple[int, dict]], None], attempts: int = 5) -> None:
        """Run `write` from the last commit; anew from the one that another writer made first."""
        for left in range(attempts - 1, -1, -1):
            try:
                return write(self._last())
            except Conflict:
                if not left:
                    raise

    def set_metadata(self, key: str, value: str) -> None:
        self._set_metadata({key: value})

    def _set_metadata(self, values: dict[str, str]) -> None:
        self._attempt(lambda base: self._commit(base, {"metadata": base[1].get("metadata", {}) | values}))

    def clear(self) -> None:
        storage.delete(self.spark, self.root)

    def replace(
        self,
        files: DataFrame,
        definitions: DataFrame,
        refs: DataFrame,
        remove: DataFrame | None = None,
        edges: DataFrame | None = None,
    ) -> None:
        """Put the rows of `files` (path, mtime) in place of what is stored of these paths, and take out the paths
        of `remove`. All of it becomes visible at once, or nothing does."""
        edges = self.spark.createDataFrame([], SCHEMAS["edges"]) if edges is None else edges
        new = {"files": files, "definitions": definitions, "refs": refs, "edges": edges}
        self._attempt(lambda base: self._replace(base, new, remove))

    def _replace(self, base: tuple[int, dict], new: dict[str, DataFrame], remove: DataFrame | None) -> None:
        state = base[1]
        n = state.get("n_buckets", self._wanted or 16)
        touched_paths = new["files"].select("path")
        if remove is not None:
            touched_paths = touched_paths.union(remove.select("path"))
        bucket = lambda table: F.pmod(F.xxhash64(_FILE_OF[table]), F.lit(n)).cast("int")
        # The numbers of the touched buckets: at most n small rows.
        touched = {r[0] for r in touched_paths.select(bucket("files")).distinct().collect()}
        if not touched:
            return
        tables = {}
        for table, rows in new.items():
            columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
            whole = rows.select(*columns)
            if state.get("buckets"):  # a first write replaces nothing
                gone = touched_paths.withColumnRenamed("path", _FILE_OF[table])
                whole = whole.unionByName(self._read(table, state, touched).join(gone, _FILE_OF[table], "left_anti").select(*columns))
            tables[table] = whole.withColumn("bucket", bucket(table))
        named = self._write(tables, touched)
        self._commit(base, {"n_buckets": n, "buckets": state.get("buckets", {}) | named})

    def _write(self, tables: dict[str, DataFrame], touched: set[int]) -> dict[str, str]:
        """Write the tables' rows of the touched buckets (column `bucket`), at the same time; the folder of each bucket."""
        write = uuid.uuid4().hex

        def one(table: str) -> None:
            (
                tables[table]
                .repartition(len(touched), "bucket")
                .sortWithinPartitions("bucket", *_SORTED_BY[table])
                .write.partitionBy("bucket")
                .parquet(f"{self.root}/data/{write}/{table}")
            )

        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(one, tables))
        # A bucket's folder is written/<table>/bucket=<b>: make one folder per bucket so that a commit can name it.
        named = {}
        for b in touched:
            for table in tables:
                self._move(f"{self.root}/data/{write}/{table}/bucket={b}", f"{self.root}/data/{write}-{b}/{table}")
            named[str(b)] = f"{write}-{b}"
        storage.delete(self.spark, f"{self.root}/data/{write}")
        return named

    def resize(self, n_buckets: int) -> None:
        """Deal all rows to another number of buckets."""

        def write(base: tuple[int, dict]) -> None:
            bucket = {t: F.pmod(F.xxhash64(_FILE_OF[t]), F.lit(n_buckets)).cast("int") for t in SCHEMAS}
            tables = {t: self._read(t, base[1]).withColumn("bucket", bucket[t]) for t in SCHEMAS}
            self._commit(base, {"n_buckets": n_buckets, "buckets": self._write(tables, set(range(n_buckets)))})

        self._attempt(write)

    def vacuum(self) -> int:
        """Delete folders that the last commit does not name, once no reader uses older ones; how many. Not while others write."""
        live = set(self._last()[1].get("buckets", {}).values())
        old = [n for n in storage.names(self.spark, f"{self.root}/data") if n not in live]
        for name in old:
            storage.delete(self.spark, f"{self.root}/data/{name}")
        return len(old)

    def _move(self, source: str, target: str) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, path = storage._fs(self.spark, source)
        to = jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(to.getParent())
        if fs.exists(path):
            fs.rename(path, to)
        else:
            fs.mkdirs(to)

    def remove(self, paths: DataFrame) -> None:
        """Take the files (path) out of all tables."""
        self.replace(
            self.spark.createDataFrame([], SCHEMAS["files"]),
            self.spark.createDataFrame([], SCHEMAS["definitions"]),
            self.spark.createDataFrame([], SCHEMAS["refs"]),
            paths,
        )

    # -------------------------------------------------------- whole runs

    def _take_in(self, files: DataFrame, texts: DataFrame, with_refs: bool = True, remove: DataFrame | None = None) -> None:
        """Parse the texts once, into a folder, and store files, definitions and references from there."""
        folder = f"{self.root}/data/parse-{uuid.uuid4().hex}"
        parse_facts(texts, edges=True).write.parquet(folder)
        parsed = self.spark.read.parquet(folder)
        refs = parsed_references(parsed) if with_refs else self.spark.createDataFrame([], SCHEMAS["refs"])
        edges = parsed_edges(parsed)
        readable = texts.where("source_text IS NOT NULL").select("path")
        self.replace(files.join(readable, "path", "left_semi").select("path", "mtime"), parsed_definitions(parsed), refs, remove, edges)
        storage.delete(self.spark, folder)

    def build(self, project_root: str, stdlib_root: str = "", force: bool = False) -> None:
        """Index a tree from nothing. An index that is there is an error without `force`.

        Of the shared library under `stdlib_root` only the definitions are stored.
        """
        if self._commits():
            if not force and self.version() == INDEX_VERSION:
                raise FileExistsError(f"there is an index under {self.root}; force=True builds it anew")
            self.clear()
        self.refresh(project_root, stdlib_root, prune=False)
        self._set_metadata({"index_version": str(INDEX_VERSION), "stdlib_root": stdlib_root})

    def refresh(self, project_root: str, stdlib_root: str = "", prune: bool = True) -> dict[str, int]:
        """Take in what changed since the last run, and with `prune` take out what is gone; the numbers of both.

        A file is changed if its modification time is not the stored one, later or not.
        """
        done = {"changed": 0, "removed": 0}
        if self._commits() and self.version() not in (0, INDEX_VERSION):
            self.clear()
        seen_all, walks = None, []
        for root, with_refs in ((stdlib_root, False), (project_root, True)):
            if not root:
                continue
            seen = walk_files(self.spark, root).persist()
            walks.append(seen)
            seen_all = seen if seen_all is None else seen_all.unionByName(seen)
            changed = changed_files(self.files(), seen).persist()
            n, size = changed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            if not self._commits() and not self._wanted:
                self._wanted = max(16, -(-size // BUCKET_BYTES))
            if n:
                self._take_in(changed, read_texts(self.spark, changed), with_refs)
            done["changed"] += n
            changed.unpersist()
        if prune and seen_all is not None:
            gone = self.files().join(seen_all.select("path"), "path", "left_anti").persist()
            done["removed"] = gone.count()
            if done["removed"]:
                self.remove(gone)
            gone.unpersist()
        if seen_all is not None:
            whole = seen_all.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            if whole > GROWTH * BUCKET_BYTES * self.n_buckets:
                self.resize(-(-whole // BUCKET_BYTES))
        for seen in walks:
            seen.unpersist()
        return done

    def apply_changes(self, changes: DataFrame) -> None:
        """Create, change and delete events (op, path): the last state on disk counts, deleted files are taken out."""
        paths = changes.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("seq", "op")).alias("x")).select("path", "x.op")
        paths = paths.where(F.col("path").rlike(r"\.exs?$")).persist()
        deleted = paths.where("op = 'delete'").select("path")
        changed = _stat(paths.where("op <> 'delete'").select("path")).persist()
        vanished = changed.where("mtime IS NULL").select("path")
        there = changed.where("mtime IS NOT NULL")
        self._take_in(there, read_texts(self.spark, there), True, deleted.union(vanished))
        paths.unpersist()
        changed.unpersist()


def _stat(paths: DataFrame) -> DataFrame:
    """path, mtime, size as they are now; NULL for what is not there."""
    import os

    import pandas as pd

    def stat(batches):
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    s = os.stat(p)
                    rows.append((p, s.st_mtime_ns, s.st_size))
                except OSError:
                    rows.append((p, None, None))
            yield pd.DataFrame(rows, columns=["path", "mtime", "size"]).astype({"mtime": "Int64", "size": "Int64"})

    return paths.mapInPandas(stat, "path string, mtime bigint, size bigint")
