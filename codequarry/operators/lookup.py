"""Lookups by exact key, in batch form: `keys` names what is asked for, every answer carries its key.

A point lookup is the same call with one key. All operators take definitions `d` and references `r` in cleaned form
(`codequarry.tables`), read no text and keep the bag semantics of the relations: what is stored twice comes out
twice. A NULL in a key matches nothing. Empty inputs give empty results. Extra columns of `keys` are dropped.

Order: answers are tables and have none. Where an operator names an order, that is the order of a point lookup, which
the caller asks for with `orderBy` over the columns named; a global sort here would run the joins before it twice (to
sample ranges) and be lost with the next shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry import tables as T
from codequarry.session import width, workspace

LOCATION = ("file_path", "line", "kind", "arity", "delegate_to", "delegate_as")


def is_module(kind: Column, impl: bool = True) -> Column:
    return kind.isin(*(T.MODULE_KINDS_IMPL if impl else T.MODULE_KINDS))


def module_rows(d: DataFrame, impl: bool = True) -> DataFrame:
    """The rows that stand for modules themselves."""
    return d.where((F.col("function") == "") & is_module(F.col("kind"), impl))


def function_rows(d: DataFrame) -> DataFrame:
    """Functions, macros, guards, delegates, structs and types, without modules and callbacks."""
    return d.where(~F.col("kind").isin(*T.NON_FUNCTION_KINDS))


def callback_rows(d: DataFrame) -> DataFrame:
    return d.where(F.col("kind").isin(*T.CALLBACK_KINDS))


def is_type(kind: Column) -> Column:
    """0 for functions, 1 for types: functions come before types of the same name."""
    return F.when(kind.isin(*T.TYPE_KINDS), 1).otherwise(0)


def distinct_keys(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """The distinct keys of `rows`, grouped more finely than a join on them.

    Adaptive execution splits a key that holds a large part of the other side only if both sides of the join are sorted
    right after their shuffles; keys that were made distinct by themselves would be aggregated in between.
    """
    keys = rows.select(*columns)
    return keys.groupBy(*keys.columns, F.xxhash64(*keys.columns).alias("_finer")).agg(F.lit(1).alias("_one")).select(*keys.columns)


def all_pairs(left: DataFrame, right: DataFrame, on: list[str], cell: int = 1_000) -> DataFrame:
    """The inner join of two tables whose keys repeat on both sides, which has the product of the repeats as rows.

    Of a key's product every task gets cells of about `cell` by `cell` rows, so one key's rows are dealt to many tasks and
    each side travels once for every `cell` repeats of the other. Nothing is shuffled after the join: if the rows of each
    side are distinct, so are the answers. Rows of one side that are equal stay in one cell.
    """
    n = width(left.sparkSession)
    sizes = left.groupBy(*on).agg(F.count("*").alias("_left")).join(right.groupBy(*on).agg(F.count("*").alias("_right")), on)
    parts = sizes.select(*on, F.ceil(F.col("_left") / cell).alias("_rows"), F.ceil(F.col("_right") / cell).alias("_columns"))

    def dealt(rows: DataFrame, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*rows.columns), F.col(own_parts)).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_parts) - 1)).alias(other)
        return rows.join(parts, on).select(*rows.columns, at, every).repartition(n, *on, "_row", "_column")

    cells = [*on, "_row", "_column"]
    pairs = dealt(left, "_row", "_rows", "_column", "_columns").join(dealt(right, "_column", "_columns", "_row", "_rows"), cells)
    return pairs.drop("_row", "_column")


def lookup_module(d: DataFrame, keys: DataFrame) -> DataFrame:
    """Where each module of `keys` (module) is defined."""
    return module_rows(d).join(distinct_keys(keys, "module"), "module").select("module", *LOCATION)


def modules_in_file(d: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Modules and protocols of each file (all files without `keys`), by line."""
    rows = module_rows(d, impl=False)
    if keys is not None:
        rows = rows.join(distinct_keys(keys, "file_path"), "file_path", "left_semi")
    return rows.select("file_path", "line", "module")


def lookup_function(d: DataFrame, keys: DataFrame) -> DataFrame:
    """Definitions of each (module, function): functions before types, then by line."""
    asked = distinct_keys(keys, "module", "function")
    return (
        function_rows(d)
        .join(asked, ["module", "function"])
        .select("module", "function", is_type(F.col("kind")).alias("type_rank"), *LOCATION, "params")
    )


def functions_in_modules(d: DataFrame, scopes: DataFrame, names: DataFrame) -> DataFrame:
    """For each scope the functions of its modules that it asks for by name, and by arity where that is >= 0.

    `scopes`: scope, module (several modules for each scope); `names`: scope, function, arity.
    """
    spark, folder = d.sparkSession, workspace(d.sparkSession, "offered")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    functions = kept(function_rows(d).select("module", "function", "arity", "kind", "line", "file_path").distinct(), "functions")
    defined = functions.select("module", "function").distinct()
    arities = F.sort_array(F.collect_set("arity")).alias("_arities")
    asked = kept(names.groupBy("scope", "function").agg(F.max(F.col("arity") < 0).alias("_any"), arities), "asked")
    # A scope's modules meet its names, or the names of each module, whichever are fewer; definitions, which may be many
    # for one name, only meet the names that were found.
    pairs = scopes.select("scope", "module").distinct()
    sized = pairs.join(asked.groupBy("scope").agg(F.count("*").alias("_asked")), "scope").join(
        defined.groupBy("module").agg(F.count("*").alias("_defined")), "module"
    )
    fewer = F.col("_asked") <= F.col("_defined")
    sized = kept(sized, "sized")
    by_scope = sized.where(fewer).select("scope", "module").join(asked, "scope").join(defined, ["module", "function"], "left_semi")
    by_module = sized.where(~fewer).select("scope", "module").join(defined, "module").join(asked, ["scope", "function"])
    found = kept(by_scope.unionByName(by_module), "found")
    return (
        all_pairs(found, functions, ["module", "function"])
        .where(F.col("_any") | F.array_contains("_arities", F.col("arity")))
        .select("scope", "module", "function", "arity", "kind", "line", "file_path")
    )


def callback_definitions(d: DataFrame, keys: DataFrame) -> DataFrame:
    """Callbacks of each (module, function), by line."""
    asked = distinct_keys(keys, "module", "function")
    return (
        callback_rows(d)
        .join(asked, ["module", "function"])
        .select("module", "function", "arity", "kind", "line", "file_path")
    )


def callback_definitions_anywhere(d: DataFrame, keys: DataFrame) -> DataFrame:
    """Callbacks of any module for each (function, arity); a negative arity asks for all."""
    asked = distinct_keys(keys, "function", F.col("arity").alias("asked_arity"))
    return (
        callback_rows(d)
        .join(asked, "function")
        .where((F.col("asked_arity") < 0) | (F.col("asked_arity") == F.col("arity")))
        .select("function", "asked_arity", "module", "arity", "kind", "line", "file_path")
    )


def references(r: DataFrame, keys: DataFrame) -> DataFrame:
    """References to each (module, function), with '' for those to the module as such; duplicates stay."""
    asked = distinct_keys(keys, "module", "function")
    return (
        r.join(asked, ["module", "function"], "left_semi")
        .select("module", "function", "file_path", "line", "kind")
    )


def ancestors(module: Column) -> Column:
    """The dotted prefixes of a module name that are shorter than itself."""
    parts = F.split(module, r"\.")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")),
    ).otherwise(F.array().cast("array<string>"))


def under_prefix(rows: DataFrame, prefixes: DataFrame, include_self: bool = True) -> DataFrame:
    """Each row of `rows` (module, ...) once for each prefix of `prefixes` (prefix) that it equals or lies under.

    Equality is exact; what follows a dot is compared without regard to case, as LIKE does. A row meets its own
    ancestors only, so the work grows with the depth of names, not with the number of prefixes.
    """
    asked = prefixes.select("prefix").where("prefix <> ''").distinct()
    below = (
        rows.withColumn("_at", F.explode(F.transform(ancestors(F.col("module")), F.lower)))
        .join(asked.withColumn("_at", F.lower("prefix")), "_at")
        .drop("_at")
    )
    if not include_self:
        return below
    return below.unionByName(rows.join(asked.withColumn("module", F.col("prefix")), "module"))


def submodules(d: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Distinct modules below each prefix, of whatever kind, without the prefix itself."""
    return under_prefix(d.where("function = ''").select("module"), prefixes, False).distinct()


def modules_by_prefix(d: DataFrame, prefixes: DataFrame) -> DataFrame:
    return under_prefix(module_rows(d).select("module", "file_path", "line", "kind"), prefixes)


def references_by_prefix(r: DataFrame, prefixes: DataFrame) -> DataFrame:
    return under_prefix(r.select("module", "function", "file_path", "line", "kind"), prefixes)


def using_modules(d: DataFrame) -> DataFrame:
    """Modules that can be used, with their files."""
    return d.where("function = '__using__'").select("module", "file_path").distinct()


def calls_in_ranges(r: DataFrame, ranges: DataFrame) -> DataFrame:
    """Calls of named functions within each range (file_path, first_line, last_line) of disjoint ranges.

    Ranges of a file must not overlap: each call then finds its range as the last one that starts before it.
    """
    from codequarry.operators.asof import asof_last

    calls = r.where("kind = 'call' AND function <> ''")
    starts = ranges.select("file_path", F.col("first_line").alias("line"), F.struct("first_line", "last_line").alias("payload"))
    found = asof_last(calls.select("file_path", "line"), starts)
    return (
        calls.join(found, ["file_path", "line"])
        .where(F.col("line") <= F.col("payload.last_line"))
        .select("file_path", F.col("payload.first_line").alias("first_line"), "module", "function", "line")
    )


def delegates_to(d: DataFrame, keys: DataFrame) -> DataFrame:
    """Delegating functions whose target is each (module, function)."""
    rows = d.where("kind = 'defdelegate'").select(
        F.col("delegate_to").alias("module"),
        F.when(F.col("delegate_as") == "", F.col("function")).otherwise(F.col("delegate_as")).alias("function"),
        F.col("module").alias("facade"),
        F.col("function").alias("facade_function"),
        "arity",
        "file_path",
        "line",
    )
    return rows.join(distinct_keys(keys, "module", "function"), ["module", "function"], "left_semi")


def file_paths(files: DataFrame) -> DataFrame:
    return files.select("path").distinct()


def file_mtime(files: DataFrame, keys: DataFrame) -> DataFrame:
    return files.join(distinct_keys(keys, "path"), "path", "left_semi").select("path", "mtime")
