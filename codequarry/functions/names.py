"""Functions over names, paths and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never a bare call.
KEYWORDS = (
    "after and case catch cond def defdelegate defexception defguard defguardp defimpl defmacro defmacrop defmodule defp "
    "defprotocol defstruct do else end false fn for if import in nil not or quote receive rescue true try unless "
    "unquote use when with alias require raise reraise throw super"
).split()
# What kinds of definitions are called in completion lists and in outlines.
COMPLETION_LABELS = {
    "module": "module", "defprotocol": "interface", "defimpl": "module", "def": "function", "defp": "function",
    "defmacro": "function", "defmacrop": "function", "defguard": "function", "defguardp": "function",
    "defdelegate": "function", "defstruct": "struct", "defexception": "struct", "type": "typeparameter",
    "opaque": "typeparameter", "callback": "event", "macrocallback": "event",
}


def last_segment(module: Column) -> Column:
    return F.substring_index(module, ".", -1)


def camel_to_snake(name: Column) -> Column:
    """`HTTPClient` gives http_client: a boundary is before an upper-case letter after another character, or before the
    last upper-case letter of a run that a lower-case letter follows."""
    once = F.regexp_replace(name, r"([^A-Z])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(once, r"([A-Z])([A-Z][^A-Z])", "$1_$2"))


def is_function_name(name: Column) -> Column:
    return name.rlike(r"^[a-z_][a-z0-9_?!]*$")


def is_module_name(name: Column) -> Column:
    return name.rlike(r"^[A-Z][A-Za-z0-9_]*(\.[A-Z][A-Za-z0-9_]*)*$")


def is_keyword(name: Column) -> Column:
    return name.isin(*KEYWORDS)


def is_source_file(path: Column) -> Column:
    return path.rlike(r"\.exs?$")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def expected_base(module: Column) -> Column:
    """The file name that a module has by convention, without its ending."""
    return camel_to_snake(last_segment(module))


def follows_convention(module: Column, path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.exs?$", "") == expected_base(module)


def conventional_path(module: Column, path: Column) -> Column:
    """The path of a file after its module got the name `module`."""
    end = F.regexp_extract(path, r"(\.exs?)$", 1)
    name = F.concat(expected_base(module), end)
    return F.when(F.contains(path, F.lit("/")), F.concat(dir_name(path), F.lit("/"), name)).otherwise(name)


def label(function: Column, arity: Column) -> Column:
    return F.concat(function, F.lit("/"), arity.cast("string"))


def call_text(function: Column, params: Column, arity: Column, piped: bool = False) -> Column:
    """`name(a, b)` from comma-separated names; after a pipe the first one is left out."""
    names = F.filter(F.split(params, ","), lambda p: p != "")
    filled = F.transform(
        F.when(arity > 0, F.sequence(F.lit(1), arity)).otherwise(F.array().cast("array<int>")),
        lambda i: F.coalesce(F.get(names, i - 1), F.concat(F.lit("arg"), i.cast("string"))),
    )
    shown = F.slice(filled, F.lit(2), F.greatest(F.size(filled) - 1, F.lit(0))) if piped else filled
    return F.concat(function, F.lit("("), F.array_join(shown, ", "), F.lit(")"))


def completion_label(kind: Column) -> Column:
    pairs = [F.lit(x) for item in COMPLETION_LABELS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("text"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def location(path: Column, line: Column) -> Column:
    """`path:line`, as the command line prints it."""
    return F.concat(path, F.lit(":"), line.cast("string"))


def completion_data(path: Column, line: Column) -> Column:
    """The payload with which a completion item can be asked about again: where its definition is."""
    return F.to_json(F.struct(path.alias("filePath"), line.alias("line")))


def normal_path(path: Column) -> Column:
    """A path without empty, `.` and `..` segments; a leading slash stays."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .when((x == "..") & F.startswith(path, F.lit("/")), acc)
        .otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))
