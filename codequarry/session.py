"""Session settings and the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_workspaces: dict[str, list[str]] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codequarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where the session names none, a temporary folder is made, but only for a single-machine session: on a
    cluster a machine-local folder would be unreadable for the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="codequarry-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dirs[app] = f"file://{path}"
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder. Results may read from it lazily; `clear_workspaces` takes all away, at the latest
    when the driver ends."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _workspaces:
        _workspaces[app] = []
        atexit.register(_clear_at_exit, spark)
    _workspaces[app].append(folder)
    return folder


def _clear_at_exit(spark: SparkSession) -> None:
    """What a driver leaves behind goes with it; a context that was stopped before cannot be asked any more."""
    try:
        clear_workspaces(spark)
    except Exception:  # noqa: BLE001
        pass


def written(rows: DataFrame, path: str) -> int:
    """Write a table; how many rows it has, counted by the write itself."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return int(seen.get["n"])


def clear_workspaces(spark: SparkSession) -> int:
    """Delete what this application's operators left in the shared folder, once their results are written elsewhere."""
    from codequarry import storage

    folders = _workspaces.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        storage.delete(spark, folder)
    return len(folders)


def width(spark: SparkSession) -> int:
    """Tasks of a wide stage: the session's number of shuffle partitions, which grows with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` in at least as many partitions as there are cores, for what takes long by row: a small input that lies in fewer
    files is dealt out, a large one stays where its files are read."""
    sc = rows.sparkSession.sparkContext
    return rows.repartition(width(rows.sparkSession)) if rows.rdd.getNumPartitions() < sc.defaultParallelism else rows


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application: they need not have it installed, and workers find
    it whatever folder the driver was started in."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="codequarry-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "codequarry_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.join("codequarry", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)  # Spark serves it from the driver to every executor
    _shipped.add(app)
