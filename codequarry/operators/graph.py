"""Bounded and transitive walks over delegation, use and call edges."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.asof import enclosing_module
from codequarry.operators.lookup import function_rows, is_type
from codequarry.session import workspace, written

MAX_HOPS = 5


def delegate_hops(d: DataFrame) -> DataFrame:
    """module, function, all_delegate, next_module, next_function of every function.

    A function is followed only if every one of its rows is a delegate with a target; the target is that of the first
    row (functions before types, lowest line, file, arity).
    """
    rows = function_rows(d).where("function <> ''")
    delegates = (F.col("kind") == "defdelegate") & (F.col("delegate_to") != "")
    first = F.min(F.struct(is_type(F.col("kind")).alias("t"), "line", "file_path", "arity", "delegate_to", "delegate_as"))
    return (
        rows.groupBy("module", "function")
        .agg(F.min(delegates.cast("int")).alias("all_delegate"), first.alias("x"))
        .select(
            "module",
            "function",
            (F.col("all_delegate") == 1).alias("all_delegate"),
            F.col("x.delegate_to").alias("next_module"),
            F.when(F.col("x.delegate_as") == "", F.col("function")).otherwise(F.col("x.delegate_as")).alias("next_function"),
        )
    )


def follow_delegates(d: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """For each (module, function) that exists: where its definition is after following delegates, and in how many hops.

    At most MAX_HOPS hops, so that cycles end; a target that is not there ends the walk before it. Chains are walked over
    the delegates alone, one table a hop, and only as long as any goes on; all other functions answer for themselves.
    """
    spark = d.sparkSession
    folder = workspace(spark, "hops")
    names = function_rows(d).where("function <> ''").select("module", "function").distinct()
    # An edge counts only if its target exists.
    edges = delegate_hops(d).where("all_delegate").select("module", "function", "next_module", "next_function")
    edges = edges.join(names.select(F.col("module").alias("next_module"), F.col("function").alias("next_function")), ["next_module", "next_function"], "left_semi")
    schema = "module string, function string, target_module string, target_function string, n_hops int"
    first = edges.select(
        "module", "function", F.col("next_module").alias("target_module"), F.col("next_function").alias("target_function"), F.lit(1).alias("n_hops")
    )
    levels = [f"{folder}/1"]
    n = written(first, levels[0])
    step = spark.read.schema(schema).parquet(levels[0]).select(
        F.col("module").alias("target_module"), F.col("function").alias("target_function"), F.col("target_module").alias("_m"), F.col("target_function").alias("_f")
    )
    while n and len(levels) < MAX_HOPS:
        at = spark.read.schema(schema).parquet(levels[-1])
        moved = at.join(step, ["target_module", "target_function"]).select(
            "module", "function", F.col("_m").alias("target_module"), F.col("_f").alias("target_function"), (F.col("n_hops") + 1).alias("n_hops")
        )
        levels.append(f"{folder}/{len(levels) + 1}")
        n = written(moved, levels[-1])
    ends = spark.read.schema(schema).parquet(*levels).groupBy("module", "function").agg(
        F.max(F.struct("n_hops", "target_module", "target_function")).alias("x")
    )
    if keys is not None:
        names = names.join(keys.select("module", "function").distinct(), ["module", "function"], "left_semi")
    return names.join(ends, ["module", "function"], "left_outer").select(
        "module",
        "function",
        F.coalesce("x.target_module", "module").alias("target_module"),
        F.coalesce("x.target_function", "function").alias("target_function"),
        F.coalesce("x.n_hops", F.lit(0)).alias("n_hops"),
    )


def use_edges(d: DataFrame, r: DataFrame) -> DataFrame:
    """module, used: which module uses which, by the module that encloses the `use`."""
    uses = r.where("kind = 'use'").select("file_path", "line", F.col("module").alias("used")).distinct()
    return (
        enclosing_module(uses, d)
        .where("enclosing_module <> ''")
        .select(F.col("enclosing_module").alias("module"), "used")
        .where("module <> used")
        .distinct()
    )


def reachable(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, node, depth: every node from which a seed is reached, with the least number of edges.

    `edges`: module, used; `seeds`: seed. Breadth first: each round joins the frontier with the edges and takes
    out what is known. Rounds are written to the shared folder, which cuts the lineage and survives lost executors.
    Rounds go on until nothing is new; cycles end by themselves.
    """
    folder = workspace(spark, "reach")
    edges.select("module", "used").distinct().write.parquet(f"{folder}/edges")
    table = spark.read.parquet(f"{folder}/edges")
    seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct().write.parquet(f"{folder}/level=0")
    schema = "seed string, node string, depth int"
    levels = [f"{folder}/level=0"]
    for depth in itertools.count(1):
        frontier = spark.read.schema(schema).parquet(levels[-1])
        known = spark.read.schema(schema).parquet(*levels).select("seed", "node")
        found = (
            frontier.select("seed", F.col("node").alias("used"))
            .join(table, "used")
            .select("seed", F.col("module").alias("node"))
            .distinct()
            .join(known, ["seed", "node"], "left_anti")
            .select("seed", "node", F.lit(depth).alias("depth"))
        )
        if not written(found, f"{folder}/level={depth}"):
            break
        levels.append(f"{folder}/level={depth}")
    return spark.read.schema(schema).parquet(*levels)
