"""Nearest preceding row: as-of joins by line within a file.

Probes are reduced to their distinct (file, line) before they are merged with the anchors in one sorted pass; what a
file's window holds is bounded by its lines, however many rows point to it. Joining the answer back is an ordinary
equi-join that adaptive execution splits where one file's rows are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.lookup import module_rows


def asof_last(probes: DataFrame, anchors: DataFrame) -> DataFrame:
    """file_path, line of each distinct probe with the payload of the last anchor at or before it; probes without
    one are left out. Anchors: file_path, line, payload; of several on one line the greatest payload counts.
    Rows with a NULL file or line have no answer."""
    a = (
        anchors.where("file_path IS NOT NULL AND line IS NOT NULL")
        .groupBy("file_path", "line")
        .agg(F.max("payload").alias("payload"))
        .withColumn("is_probe", F.lit(0))
    )
    p = (
        probes.where("file_path IS NOT NULL AND line IS NOT NULL")
        .select("file_path", "line")
        .distinct()
        .withColumn("payload", F.lit(None).cast(a.schema["payload"].dataType))
        .withColumn("is_probe", F.lit(1))
    )
    w = Window.partitionBy("file_path").orderBy("line", "is_probe").rowsBetween(Window.unboundedPreceding, 0)
    return (
        a.unionByName(p)
        .withColumn("payload", F.last("payload", ignorenulls=True).over(w))
        .where((F.col("is_probe") == 1) & F.col("payload").isNotNull())
        .select("file_path", "line", "payload")
    )


def enclosing_module(probes: DataFrame, d: DataFrame) -> DataFrame:
    """`probes` (file_path, line, ...) with `enclosing_module`: the module or protocol that starts last at or before the
    line. Where a module ends is not looked at, and implementations are passed over. Without one: ''."""
    anchors = module_rows(d, impl=False).select("file_path", "line", F.col("module").alias("payload"))
    found = asof_last(probes, anchors).withColumnRenamed("payload", "enclosing_module")
    return probes.join(found, ["file_path", "line"], "left_outer").withColumn(
        "enclosing_module", F.coalesce("enclosing_module", F.lit(""))
    )


def enclosing_block(probes: DataFrame, scopes: DataFrame) -> DataFrame:
    """file_path, line of each distinct probe with the module whose block holds it, '' outside of all: right after a nested
    module's `end` it is the outer one again. `scopes`: file_path, module, first_line, last_line, depth, parent.

    A block changes what encloses a line where it starts and after it ends, so this is an as-of join over these places; of
    several on one line a start counts before an end, the innermost start and the outermost end.
    """
    starts = scopes.select("file_path", F.col("first_line").alias("line"), F.struct(F.lit(1).alias("p"), "depth", F.col("module").alias("m")).alias("payload"))
    ends = scopes.select("file_path", (F.col("last_line") + 1).alias("line"), F.struct(F.lit(0).alias("p"), (-F.col("depth")).alias("depth"), F.col("parent").alias("m")).alias("payload"))
    found = asof_last(probes, starts.unionByName(ends))
    asked = probes.where("file_path IS NOT NULL AND line IS NOT NULL").select("file_path", "line").distinct()
    return asked.join(found, ["file_path", "line"], "left_outer").select("file_path", "line", F.coalesce("payload.m", F.lit("")).alias("module"))


def function_anchors(d: DataFrame) -> DataFrame:
    """All rows with a function name (types, callbacks and structs too); of those on one line the highest arity."""
    return d.where("function <> ''").select(
        "file_path", "line", F.struct("arity", "module", "function", "kind", F.col("line").alias("def_line")).alias("payload")
    )


def enclosing_function(probes: DataFrame, d: DataFrame) -> DataFrame:
    """`probes` with the function that starts last at or before the line, in columns caller_*; none: left out."""
    found = asof_last(probes, function_anchors(d))
    return probes.join(found, ["file_path", "line"]).select(
        *[probes[c] for c in probes.columns],
        F.col("payload.module").alias("caller_module"),
        F.col("payload.function").alias("caller_function"),
        F.col("payload.arity").alias("caller_arity"),
        F.col("payload.def_line").alias("caller_line"),
    )


def next_function_line(d: DataFrame) -> DataFrame:
    """file_path, line, next_line of each line with a function; 0 after the last."""
    lines = d.where("function <> ''").select("file_path", "line").distinct()
    w = Window.partitionBy("file_path").orderBy("line")
    return lines.withColumn("next_line", F.coalesce(F.lead("line").over(w), F.lit(0)))


def function_ranges(d: DataFrame, open_end: int = 500) -> DataFrame:
    """file_path, first_line, last_line of each function: up to the line before the next one, or `open_end` lines."""
    return next_function_line(d).select(
        "file_path",
        F.col("line").alias("first_line"),
        F.when(F.col("next_line") == 0, F.col("line") + (open_end - 1)).otherwise(F.col("next_line") - 1).alias("last_line"),
    )


def resolve_nested(refs: DataFrame, d: DataFrame) -> DataFrame:
    """The module that a relative name means: `enclosing.name` for the enclosing module, then for each module
    around it, the innermost that exists. `refs`: enclosing, name (distinct); unresolved ones are left out."""
    parts = F.split("enclosing", r"\.")
    tried = refs.select("enclosing", "name").distinct().where("enclosing <> '' AND name <> ''").select(
        "enclosing",
        "name",
        F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"),
    )
    candidates = tried.withColumn(
        "candidate", F.concat_ws(".", F.array_join(F.slice(F.split("enclosing", r"\."), F.lit(1), F.col("depth")), "."), "name")
    )
    known = module_rows(d).select(F.col("module").alias("candidate")).distinct()
    return (
        candidates.join(known, "candidate", "left_semi")
        .groupBy("enclosing", "name")
        .agg(F.max(F.struct("depth", "candidate")).alias("x"))
        .select("enclosing", "name", F.col("x.candidate").alias("module"))
    )


def behaviour_implementors(d: DataFrame, r: DataFrame) -> DataFrame:
    """behaviour, module, file_path: the modules that declare each behaviour, by `@behaviour` or `use`."""
    declared = r.where("kind IN ('behaviour', 'use')").select(F.col("module").alias("behaviour"), "file_path", "line")
    anchors = module_rows(d, impl=False).select("file_path", "line", F.col("module").alias("payload"))
    found = asof_last(declared, anchors)
    return (
        declared.distinct()
        .join(found, ["file_path", "line"])
        .select("behaviour", F.col("payload").alias("module"), "file_path")
        .distinct()
    )
