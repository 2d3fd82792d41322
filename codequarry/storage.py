"""Small files on any Hadoop file system: listing, atomic text files, deletion."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if the folder is not there."""
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(target))


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _fs(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file so that it is there whole or not at all; False if it was there before, also if another writer was
    faster. Each writer prepares a file of its own; giving it its name is one step of the file system, which fails if the
    name is taken: a hard link on local disks (where renaming would replace), renaming elsewhere."""
    fs, target = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/_writing-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.getScheme() == "file":
        try:
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            done = True
        except FileExistsError:
            done = False
        fs.delete(aside, False)
        return done
    try:
        done = not fs.exists(target) and bool(fs.rename(aside, target))
    finally:
        fs.delete(aside, False)
    return done


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)
