"""Walks along what `use` brings into a module.

`edges` are the rows of `text_tables.using_edges`. A walk is depth first: inline functions before imports (last first)
before options before further uses (last first). It runs for all seeds at once, breadth first, with the path of each
visit as an array of numbers; the least path, compared element by element, is the one that the depth-first walk would
have met first. Options of the consumer count for the first module only.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.graph import reachable
from codequarry.operators.lookup import callback_rows, function_rows
from codequarry.operators.search import first_functions
from codequarry.session import workspace, written

_VISITS = "seed string, module string, options map<string,string>, path array<int>"


def visits(spark: SparkSession, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, module, options, path: the modules whose `__using__` takes part, each with its least path.

    `seeds`: seed, module, ordinal, options; the uses of a text are seeds with one name and rising ordinals, walked
    last to first. A module that a seed has reached on a lesser path is not entered again, so cycles end, and the walk
    goes on until nothing is new, however long a chain is.
    """
    folder = workspace(spark, "visits")
    first = seeds.select("seed", "module", "options", F.array((-F.col("ordinal")).cast("int")).alias("path"))
    first.write.parquet(f"{folder}/0")
    steps = edges.where("kind IN ('use', 'option_use')").select(
        F.col("module"), F.col("kind").alias("_k"), F.col("ordinal").alias("_o"), F.col("target").alias("_t"), F.col("option").alias("_opt")
    )
    steps.write.parquet(f"{folder}/steps")
    steps = spark.read.parquet(f"{folder}/steps")
    levels = [f"{folder}/0"]
    for depth in itertools.count(1):
        frontier = spark.read.schema(_VISITS).parquet(levels[-1])
        chosen = F.when(F.col("_k") == "use", F.col("_t")).otherwise(F.coalesce(F.try_element_at("options", F.col("_opt")), F.col("_t")))
        priority = F.when(F.col("_k") == "use", F.array(F.lit(3), -F.col("_o"))).otherwise(F.array(F.lit(2), F.col("_o")))
        found = (
            frontier.join(steps, "module")
            .select("seed", chosen.alias("module"), F.create_map().cast("map<string,string>").alias("options"), F.concat("path", priority).alias("path"))
            .where("module <> ''")
            .groupBy("seed", "module")
            .agg(F.min("path").alias("path"))
        )
        known = spark.read.schema(_VISITS).parquet(*levels).groupBy("seed", "module").agg(F.min("path").alias("_known"))
        new = found.join(known, ["seed", "module"], "left_outer").where(F.col("_known").isNull() | (F.col("path") < F.col("_known")))
        if not written(new.select("seed", "module", F.create_map().cast("map<string,string>").alias("options"), "path"), f"{folder}/{depth}"):
            break
        levels.append(f"{folder}/{depth}")
    every = spark.read.schema(_VISITS).parquet(*levels)
    # Maps cannot be compared, so the least visit is chosen by its path alone.
    return every.groupBy("seed", "module").agg(F.min_by("options", "path").alias("options"), F.min("path").alias("path"))


def providers(edges: DataFrame, seen: DataFrame, inline: bool = True) -> DataFrame:
    """seed, provider, function, arity, origin, path: what each seed is offered; function is NULL where a whole module
    is imported."""
    e = edges.where("kind IN ('inline', 'import', 'option_import')" if inline else "kind IN ('import', 'option_import')").select(
        "module", F.col("kind").alias("origin"), "ordinal", "target", F.col("function").alias("_f"), F.col("arity").alias("_a"), "option"
    )
    rank = (
        F.when(F.col("origin") == "inline", F.array(F.lit(0), F.col("ordinal")))
        .when(F.col("origin") == "import", F.array(F.lit(1), -F.col("ordinal")))
        .otherwise(F.array(F.lit(2), F.col("ordinal")))
    )
    provider = (
        F.when(F.col("origin") == "inline", F.col("module"))
        .when(F.col("origin") == "import", F.col("target"))
        .otherwise(F.coalesce(F.try_element_at("options", F.col("option")), F.col("target")))
    )
    own = F.col("origin") == "inline"
    return (
        seen.join(e, "module")
        .select(
            "seed", provider.alias("provider"), F.when(own, F.col("_f")).alias("function"), F.when(own, F.col("_a")).alias("arity"),
            "origin", F.concat("path", rank).alias("path"),
        )
        .where("provider <> ''")
    )


def lookup_through_use(d: DataFrame, offered: DataFrame, asked: DataFrame) -> DataFrame:
    """seed, function, provider, origin: where each asked (seed, function) comes from; not found: left out."""
    wanted = asked.select("seed", "function").distinct()
    inline = offered.where("origin = 'inline'").join(wanted, ["seed", "function"]).select("seed", "function", "provider", "origin", "path")
    defines = function_rows(d).select(F.col("module").alias("provider"), "function").distinct()
    imported = (
        offered.where("origin <> 'inline'").drop("function", "arity").join(wanted, "seed").join(defines, ["provider", "function"], "left_semi")
        .select("seed", "function", "provider", "origin", "path")
    )
    best = inline.unionByName(imported).groupBy("seed", "function").agg(F.min(F.struct("path", "provider", "origin")).alias("x"))
    return best.select("seed", "function", "x.provider", "x.origin")


def injected_aliases(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """seed, short, full: aliases that using brings; the first binding along the walk stays."""
    a = edges.where("kind = 'alias'").select("module", F.col("option").alias("short"), F.col("target").alias("full"), "ordinal")
    rows = seen.join(a, "module").select("seed", "short", F.struct("path", "ordinal", "full").alias("x"))
    return rows.groupBy("seed", "short").agg(F.min("x").alias("x")).select("seed", "short", "x.full")


def merged_aliases(own: DataFrame, injected: DataFrame) -> DataFrame:
    """Own aliases (seed, short, full) and, for names that they lack, injected ones."""
    rest = injected.join(own.select("seed", "short"), ["seed", "short"], "left_anti")
    return own.select("seed", "short", "full").unionByName(rest.select("seed", "short", "full"))


def callbacks_in_chain(d: DataFrame, seen: DataFrame) -> DataFrame:
    """seed, module, function, arity, file_path, line: callbacks of every module of the walk."""
    c = callback_rows(d).select("module", "function", "arity", "file_path", "line")
    return seen.select("seed", "module").join(c, "module").select("seed", "module", "function", "arity", "file_path", "line")


def completions_from_using(d: DataFrame, offered: DataFrame) -> DataFrame:
    """seed, function, arity, provider: inline functions and the public functions of imports, once by name and arity."""
    inline = offered.where("origin = 'inline'").select("seed", "function", "arity", "provider", "path")
    public = first_functions(d).select(F.col("module").alias("provider"), F.col("function"), F.col("arity"))
    imported = offered.where("origin <> 'inline'").drop("function", "arity").join(public, "provider").select("seed", "function", "arity", "provider", "path")
    best = inline.unionByName(imported).groupBy("seed", "function", "arity").agg(F.min(F.struct("path", "provider")).alias("x"))
    return best.select("seed", "function", "arity", "x.provider")


def injecting_modules(spark: SparkSession, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """seed, node, depth: the modules whose use makes each target (seed) available, directly (depth 1) or through
    further uses."""
    imports = edges.where("kind IN ('import', 'option_import') AND target <> ''").select("module", F.col("target").alias("used"))
    up = edges.where("kind IN ('use', 'option_use') AND target <> ''").select("module", F.col("target").alias("used"))
    asked = targets.select("seed").distinct()
    first = imports.join(asked.withColumnRenamed("seed", "used"), "used").select(F.col("used").alias("seed"), F.col("module").alias("via")).distinct()
    above = reachable(spark, up, first.select(F.col("via").alias("seed")).distinct())
    joined = first.join(above.withColumnRenamed("seed", "via"), "via")
    return joined.groupBy("seed", "node").agg((F.min("depth") + 1).alias("depth"))


def bare_function_module(
    d: DataFrame, asked: DataFrame, in_file: DataFrame, imports: DataFrame, through_use: DataFrame, default: str = "Kernel"
) -> DataFrame:
    """seed, function, module: what a name without a module means.

    The file's own module, then its imports in order, then its use chains, then the default module. `asked`: seed,
    function; `in_file`: seed, function, module; `imports`: seed, imported, ordinal; `through_use`: seed, function,
    provider.
    """
    wanted = asked.select("seed", "function").distinct()
    defines = function_rows(d).select("module", "function").distinct()
    by_import = (
        wanted.join(imports.select("seed", F.col("imported").alias("module"), "ordinal"), "seed")
        .join(defines, ["module", "function"], "left_semi")
        .select("seed", "function", F.lit(1).alias("p"), "ordinal", "module")
    )
    own = in_file.select("seed", "function", F.lit(0).alias("p"), F.lit(0).alias("ordinal"), "module")
    used = through_use.select("seed", "function", F.lit(2).alias("p"), F.lit(0).alias("ordinal"), F.col("provider").alias("module"))
    kernel = wanted.join(defines.where(F.col("module") == default), "function").select(
        "seed", "function", F.lit(3).alias("p"), F.lit(0).alias("ordinal"), "module"
    )
    every = own.unionByName(by_import).unionByName(used).unionByName(kernel).join(wanted, ["seed", "function"], "left_semi")
    return every.groupBy("seed", "function").agg(F.min(F.struct("p", "ordinal", "module")).alias("x")).select("seed", "function", "x.module")
