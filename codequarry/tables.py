"""The relations: how they are read and how dirty names are cleaned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODULE_KINDS = ("module", "defprotocol")
MODULE_KINDS_IMPL = (*MODULE_KINDS, "defimpl")
CALLBACK_KINDS = ("callback", "macrocallback")
NON_FUNCTION_KINDS = (*MODULE_KINDS_IMPL, *CALLBACK_KINDS)
TYPE_KINDS = ("type", "opaque")
PUBLIC_KINDS = ("def", "defmacro", "defguard", "defdelegate", "type", "opaque")

FACT_COLUMNS = ("module", "function", "arity", "kind", "line", "file_path", "delegate_to", "delegate_as", "params")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strip(name: Column) -> Column:
    """White space at both ends removed, NULL being ''."""
    return F.btrim(F.coalesce(name, F.lit("")), F.lit(" \t\n\r\f\x0b"))


def clean_module(name: Column) -> Column:
    """The one spelling of a module name: stripped, without a leading `Elixir.`."""
    bare = strip(name)
    return F.when(F.startswith(bare, F.lit("Elixir.")), F.substring(bare, 8, 2**31 - 1)).otherwise(bare)


def clean_path(path: Column) -> Column:
    """A path without empty and `.` segments; NULL stays NULL."""
    return F.regexp_replace(F.regexp_replace(path, r"(^|/)(\.?/)+", "$1"), r"(^|/)\.?$", "")


def definitions(spark: SparkSession, sf_dir: str, *, current: bool = True) -> DataFrame:
    """Cleaned definitions, each delivered row once; with `current`, without removed rows.

    Deliveries of one row are equal in all columns once these are clean, so a hash aggregation over all of them takes out
    the copies; filters on any column reach the scan through it.
    """
    d = read(spark, sf_dir, "definitions")
    if current:
        d = d.where(F.col("removed_at").isNull())
    return (
        d.select(
            "def_id",
            clean_module(F.col("module")).alias("module"),
            strip(F.col("function")).alias("function"),
            F.coalesce("arity", F.lit(0)).alias("arity"),
            F.coalesce("kind", F.lit("")).alias("kind"),
            "line",
            F.coalesce("file_path", F.lit("")).alias("file_path"),
            clean_module(F.col("delegate_to")).alias("delegate_to"),
            strip(F.col("delegate_as")).alias("delegate_as"),
            F.coalesce("params", F.lit("")).alias("params"),
        )
        .distinct()
    )


def stdlib(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "stdlib_definitions")
    return d.select(
        clean_module(F.col("module")).alias("module"),
        strip(F.col("function")).alias("function"),
        F.coalesce("arity", F.lit(0)).alias("arity"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        "line",
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        clean_module(F.col("delegate_to")).alias("delegate_to"),
        strip(F.col("delegate_as")).alias("delegate_as"),
        F.coalesce("params", F.lit("")).alias("params"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned references, each delivered row once."""
    return (
        read(spark, sf_dir, "refs")
        .select(
            "ref_id",
            clean_module(F.col("module")).alias("module"),
            strip(F.col("function")).alias("function"),
            "line",
            F.coalesce("file_path", F.lit("")).alias("file_path"),
            F.coalesce("kind", F.lit("")).alias("kind"),
        )
        .distinct()
    )
