"""Joins of definitions with references, and the reductions that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.asof import (
    asof_last,
    behaviour_implementors,
    enclosing_function,
    enclosing_module,
    function_anchors,
    next_function_line,
)
from codequarry.operators.lookup import callback_rows, delegates_to, function_rows, is_type, module_rows


def behaviours_for_file(d: DataFrame, r: DataFrame) -> DataFrame:
    """file_path, behaviour: declared behaviours, and used modules that have a callback."""
    declared = r.where("kind = 'behaviour'").select("file_path", F.col("module").alias("behaviour"))
    used = r.where("kind = 'use'").select("file_path", F.col("module").alias("behaviour"))
    with_callbacks = callback_rows(d).select(F.col("module").alias("behaviour")).distinct()
    return declared.union(used.join(with_callbacks, "behaviour", "left_semi").select("file_path", "behaviour")).distinct()


def missing_paths(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored paths that a walk no longer found."""
    return stored.select("path").distinct().join(seen.select("path"), "path", "left_anti")


def implementations(d: DataFrame, r: DataFrame) -> DataFrame:
    """For each callback the functions of the same name and arity in the modules that implement its behaviour.

    The arity is that of the callback's first row; the behaviour itself is always among the candidates.
    """
    first = callback_rows(d).groupBy("module", "function").agg(F.min(F.struct("line", "arity")).alias("x"))
    callbacks = first.select(F.col("module").alias("behaviour"), "function", F.col("x.arity").alias("arity"))
    candidates = (
        behaviour_implementors(d, r)
        .select("behaviour", "module")
        .union(callbacks.select("behaviour", F.col("behaviour").alias("module")))
        .distinct()
    )
    wanted = callbacks.join(candidates, "behaviour")
    return (
        function_rows(d)
        .join(wanted, ["module", "function", "arity"])
        .select("behaviour", "module", "function", "arity", "file_path", "line")
        .distinct()
    )


def injected_references(r: DataFrame, injectors: DataFrame) -> DataFrame:
    """References to a function through the modules that inject it. `injectors`: module, function, injector."""
    asked = injectors.select(F.col("module").alias("_m"), "function", F.col("injector").alias("module")).distinct()
    return r.join(asked, ["module", "function"]).select(F.col("_m").alias("module"), "function", F.col("module").alias("injector"), "file_path", "line", "kind")


def reverse_delegate_references(d: DataFrame, r: DataFrame) -> DataFrame:
    """References to each delegated function through the facades that delegate to it."""
    targets = d.where("kind = 'defdelegate' AND delegate_to <> ''").select(
        F.col("delegate_to").alias("module"),
        F.when(F.col("delegate_as") == "", F.col("function")).otherwise(F.col("delegate_as")).alias("function"),
    )
    facades = delegates_to(d, targets).select(
        F.col("module").alias("target_module"), F.col("function").alias("target_function"),
        F.col("facade").alias("module"), F.col("facade_function").alias("function"),
    ).distinct()
    return r.join(facades, ["module", "function"]).select(
        "target_module", "target_function", "module", "function", "file_path", "line", "kind"
    )


def incoming_calls(d: DataFrame, r: DataFrame) -> DataFrame:
    """Every call of a named function with the function it stands in; one row for each callee, file and line."""
    calls = r.where("kind = 'call' AND function <> ''").select("module", "function", "file_path", "line").distinct()
    return enclosing_function(calls, d).select(
        "module", "function", "file_path", "line", "caller_module", "caller_function", "caller_arity", "caller_line"
    )


def outgoing_calls(d: DataFrame, r: DataFrame, open_end: int = 500) -> DataFrame:
    """For each calling function the functions it calls, with the lines of the calls and the first definition.

    A function ends where the next one starts, however far that is; the last of a file ends after `open_end` lines. Lines
    are counted here, with the first and last of them; `outgoing_call_sites` has a row for each.
    """
    edges = _calls_inside(d, r, open_end).groupBy("file_path", "caller_line", "caller_module", "caller_function", "module", "function").agg(
        F.count("*").alias("n_calls"), F.min("line").alias("first_call"), F.max("line").alias("last_call")
    )
    return edges.join(_first_definitions(d), ["module", "function"])


def outgoing_call_sites(d: DataFrame, r: DataFrame, open_end: int = 500) -> DataFrame:
    """The ranges of `outgoing_calls`: one row for each caller, callee and line of a call, callees without a definition
    left out. Rows rather than an array, so that a callee with very many calls is no large row."""
    sites = _calls_inside(d, r, open_end).distinct()
    return sites.join(_first_definitions(d), ["module", "function"]).select(
        "file_path", "caller_line", "caller_module", "caller_function", "module", "function", "line"
    )


def _calls_inside(d: DataFrame, r: DataFrame, open_end: int) -> DataFrame:
    """Calls of named functions with the function whose lines they stand on."""
    calls = r.where("kind = 'call' AND function <> ''").select("module", "function", "file_path", "line")
    anchors = function_anchors(d).join(next_function_line(d), ["file_path", "line"])
    anchors = anchors.select("file_path", "line", F.col("payload").withField("next_line", F.col("next_line")).alias("payload"))
    return (
        calls.join(asof_last(calls, anchors), ["file_path", "line"])
        .where((F.col("payload.next_line") > 0) | (F.col("line") < F.col("payload.def_line") + open_end))
        .select(
            "file_path",
            F.col("payload.def_line").alias("caller_line"),
            F.col("payload.module").alias("caller_module"),
            F.col("payload.function").alias("caller_function"),
            "module",
            "function",
            "line",
        )
    )


def _first_definitions(d: DataFrame) -> DataFrame:
    first = F.min(F.struct(is_type(F.col("kind")).alias("t"), "line", F.col("file_path").alias("f")))
    targets = function_rows(d).groupBy("module", "function").agg(first.alias("x"))
    return targets.select("module", "function", F.col("x.f").alias("target_file"), F.col("x.line").alias("target_line"))


def call_edges(d: DataFrame, r: DataFrame) -> DataFrame:
    """The call graph: caller, callee and how many lines call."""
    return (
        incoming_calls(d, r)
        .groupBy("caller_module", "caller_function", "module", "function")
        .agg(F.count("*").alias("n_lines"))
    )


def declarations(d: DataFrame, r: DataFrame) -> DataFrame:
    """For each function the callback it implements: of its own module or of a behaviour of its file."""
    functions = function_rows(d).where("function <> ''").select("module", "function", "arity", "file_path").distinct()
    own = functions.withColumn("behaviour", F.col("module"))
    of_file = functions.join(behaviours_for_file(d, r), "file_path")
    callbacks = callback_rows(d).select(
        F.col("module").alias("behaviour"), "function", "arity", F.col("file_path").alias("callback_file"), F.col("line").alias("callback_line")
    )
    return (
        own.unionByName(of_file)
        .distinct()
        .join(callbacks, ["behaviour", "function", "arity"])
        .select("module", "function", "arity", "behaviour", "callback_file", "callback_line")
        .distinct()
    )


def rename_sites(d: DataFrame, r: DataFrame, renames: DataFrame) -> DataFrame:
    """Places where a module under a renamed prefix is named. `renames`: old_prefix, new_prefix.

    One row for each file, line and module name, definitions before references.
    """
    from codequarry.operators.lookup import under_prefix

    asked = renames.select(F.col("old_prefix").alias("prefix"))
    defined = under_prefix(module_rows(d).select("module", "file_path", "line"), asked).withColumn("origin", F.lit("definition"))
    named = under_prefix(r.select("module", "file_path", "line"), asked).withColumn("origin", F.lit("reference"))
    sites = defined.unionByName(named).groupBy("prefix", "module", "file_path", "line").agg(F.min("origin").alias("origin"))
    return sites.join(renames.withColumnRenamed("old_prefix", "prefix"), "prefix").select(
        F.col("module").alias("old_module"),
        F.expr("concat(new_prefix, substring(module, length(prefix) + 1))").alias("new_module"),
        "file_path",
        "line",
        "origin",
    )


def rename_map(d: DataFrame, renames: DataFrame) -> DataFrame:
    """Old and new name of each module under a renamed prefix."""
    from codequarry.operators.lookup import under_prefix

    rows = under_prefix(module_rows(d).select("module").distinct(), renames.select(F.col("old_prefix").alias("prefix")))
    return rows.join(renames.withColumnRenamed("old_prefix", "prefix"), "prefix").select(
        F.col("module").alias("old_module"), F.expr("concat(new_prefix, substring(module, length(prefix) + 1))").alias("new_module")
    )


def rename_collisions(d: DataFrame, renames: DataFrame) -> DataFrame:
    """New names that a module outside the moved files already has."""
    modules = module_rows(d).select("module", "file_path").distinct()
    new_names = rename_map(d, renames)
    moved = modules.join(new_names.select(F.col("old_module").alias("module")), "module", "left_semi").select("file_path").distinct()
    return (
        modules.join(moved, "file_path", "left_anti")
        .join(new_names, F.col("module") == F.col("new_module"))
        .select("old_module", "new_module", "file_path")
        .distinct()
    )


def import_lines(r: DataFrame, lines: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Imports with the text of their line. `lines`: file_path, line, text.

    With `keys` (module, function) only imports of these modules whose line names the function as a whole word, as in
    `only:` and `except:`; the function is a further column then.
    """
    rows = r.where("kind = 'import'").select("module", "file_path", "line").distinct().join(lines, ["file_path", "line"])
    if keys is None:
        return rows.select("module", "file_path", "line", "text")
    asked = keys.where("function <> ''").select("module", "function").distinct()
    whole = F.concat(F.lit(r"(?<![\w?!])\Q"), F.col("function"), F.lit(r"\E(?![\w?!])"))
    return rows.join(asked, "module").where(F.regexp_like("text", whole)).select("module", "function", "file_path", "line", "text")


def dedup_locations(rows: DataFrame, keys: list[str], stdlib_prefix: str = "") -> DataFrame:
    """One row for each of `keys`, file and line; files under `stdlib_prefix` are left out."""
    if stdlib_prefix:
        rows = rows.where(~F.startswith(F.col("file_path"), F.lit(stdlib_prefix)))
    return rows.select(*keys, "file_path", "line").distinct()


def functions_over_types(d: DataFrame) -> DataFrame:
    """Rows by (module, function), types only where no function has the name."""
    rows = function_rows(d).where("function <> ''").select("module", "function", "arity", "kind", "file_path", "line")
    has_function = rows.where(is_type(F.col("kind")) == 0).select("module", "function").distinct()
    types = rows.where(is_type(F.col("kind")) == 1).join(has_function, ["module", "function"], "left_anti")
    return rows.where(is_type(F.col("kind")) == 0).unionByName(types.select(*rows.columns))


def function_module_in_file(d: DataFrame, probes: DataFrame) -> DataFrame:
    """Which module a bare name in a file means. `probes`: file_path, line, function.

    The enclosing module if it defines the function anywhere, else the first module of the file (by line, then
    name) that does; otherwise the probe is left out.
    """
    asked = probes.select("file_path", "line", "function").distinct()
    placed = enclosing_module(asked, d)
    defines = function_rows(d).where("function <> ''").select("module", "function").distinct()
    here = placed.join(
        defines.withColumnRenamed("module", "enclosing_module"), ["enclosing_module", "function"], "left_semi"
    ).select("file_path", "line", "function", F.col("enclosing_module").alias("module"))
    rest = placed.join(here, ["file_path", "line", "function"], "left_anti").select("file_path", "line", "function")
    in_file = (
        function_rows(d).where("function <> ''").groupBy("file_path", "function").agg(F.min(F.struct("line", "module")).alias("x"))
        .select("file_path", "function", F.col("x.module").alias("module"))
    )
    return here.unionByName(rest.join(in_file, ["file_path", "function"]).select("file_path", "line", "function", "module"))


def index_totals(d: DataFrame, r: DataFrame) -> DataFrame:
    """Numbers of files, definitions and references."""
    rows = d.select("file_path", F.lit(1).alias("d")).unionByName(r.select(F.lit(None).cast("string").alias("file_path"), F.lit(0).alias("d")))
    return rows.agg(
        F.countDistinct("file_path").alias("n_files"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("n_definitions"),
        F.coalesce(F.sum(1 - F.col("d")), F.lit(0)).alias("n_references"),
    )


def sites_by_file(sites: DataFrame) -> DataFrame:
    """How many sites each file has, with the first and last line."""
    return sites.groupBy("file_path").agg(F.count("*").alias("n_sites"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
