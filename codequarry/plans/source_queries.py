"""Queries that read source texts: tokens and facts, and how they agree with the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import tables as T
from codequarry.operators.asof import enclosing_block
from codequarry.plans import text_sql
from codequarry.sources.facts import latest_texts, parse_facts, parsed_definitions, parsed_references, token_counts
from codequarry.sources import text_tables as X
from codequarry.sources.files import lines


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_texts(T.read(spark, sf_dir, "sources"))


def parse_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_definitions(parse_facts(sources(spark, sf_dir)))


def parse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that the texts hold, each once."""
    return parsed_references(parse_facts(sources(spark, sf_dir))).distinct()


_DEF_KEY = ["module", "function", "arity", "kind", "line", "file_path"]
_REF_KEY = ["module", "function", "line", "file_path", "kind"]


def parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored definitions that parsing the text of their file gives again."""
    stored = T.definitions(spark, sf_dir, current=False).select(*_DEF_KEY).distinct()
    return stored.join(parse_definitions(spark, sf_dir).select(*_DEF_KEY).distinct(), _DEF_KEY, "left_semi")


def parse_refs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored references that parsing the text of their file gives again."""
    stored = T.refs(spark, sf_dir).select(*_REF_KEY).distinct()
    return stored.join(parse_references(spark, sf_dir).select(*_REF_KEY).distinct(), _REF_KEY, "left_semi")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each file, and how many of them are blank."""
    rows = lines(sources(spark, sf_dir))
    return rows.groupBy("file_path").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("text") == "").alias("n_blank"))


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import references with the text of their line."""
    from codequarry.operators.links import import_lines as joined

    return joined(T.refs(spark, sf_dir), lines(sources(spark, sf_dir)))


def enclosing_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each referenced place the module whose block holds it, '' outside of all: right after a nested `end`, too."""
    readable = T.read(spark, sf_dir, "sources").where("path IS NOT NULL AND source_text IS NOT NULL").select(F.col("path").alias("file_path"))
    places = T.refs(spark, sf_dir).select("file_path", "line").join(readable, "file_path", "left_semi")
    return enclosing_block(places, X.scopes(sources(spark, sf_dir)))


def workspace_of(spark: SparkSession, sf_dir: str):
    from codequarry.operators.handlers import Workspace, stored
    from codequarry.plans.core_queries import facts

    d, r = facts(spark, sf_dir)
    return Workspace(spark, stored(spark, d), r, sources(spark, sf_dir))


def call_places(spark: SparkSession, sf_dir: str, inside: bool = False) -> DataFrame:
    """Where the functions of qualified calls stand, from 0: one place for each call reference whose line names it; with
    `inside`, where their arguments start."""
    calls = T.refs(spark, sf_dir).where("kind = 'call' AND function <> ''").select("file_path", "line", "function").distinct()
    found = calls.join(lines(sources(spark, sf_dir)), ["file_path", "line"])
    at = F.expr("instr(text, concat('.', function, '('))")
    col = at + F.length("function") + 1 if inside else at
    return found.where(at > 0).select("file_path", (F.col("line") - 1).alias("line"), col.cast("int").alias("col")).distinct()


def module_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last characters of the module names of aliases, imports and uses that are written out on their lines."""
    named = T.refs(spark, sf_dir).where("kind IN ('alias', 'import', 'use')").select("file_path", "line", "module", "kind").distinct()
    found = named.join(lines(sources(spark, sf_dir)), ["file_path", "line"])
    whole = F.concat(F.lit(r"^\s*"), "kind", F.lit(r"\s+\Q"), "module", F.lit(r"\E(?:$|[^\w.])"))
    col = F.expr("instr(text, module) + length(module) - 2")
    return found.where(F.regexp_like("text", whole)).select("file_path", (F.col("line") - 1).alias("line"), col.cast("int").alias("col")).distinct()


def definition_at_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.operators.handlers import definition

    return definition(workspace_of(spark, sf_dir), module_places(spark, sf_dir))


def variable_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the argument of every qualified call that has just a name for one, all places of that variable."""
    from codequarry.operators.rename import variable_occurrences

    texts = sources(spark, sf_dir)
    rows = lines(texts).where(F.col("text").rlike(r"^\s+(v\d+ = )?[A-Z][\w.]*\.[a-z_]\w*[?!]?\([a-z_]\w*\)$"))
    name = F.regexp_extract("text", r"\(([a-z_]\w*)\)$", 1)
    places = rows.select("file_path", (F.col("line") - 1).alias("line"), (F.length("text") - F.length(name) - 1).alias("col"))
    return variable_occurrences(texts, places)


def _handler(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from codequarry.operators import handlers

        return getattr(handlers, name)(workspace_of(spark, sf_dir), call_places(spark, sf_dir, name == "signature_help"))

    return run


def _texts(table):
    return lambda spark, sf_dir: table(sources(spark, sf_dir))


QUERIES = {
    "text_scopes": lambda spark, sf_dir: X.scopes(sources(spark, sf_dir)).select("file_path", "module", "kind", "first_line"),
    "text_aliases": lambda spark, sf_dir: X.aliases(sources(spark, sf_dir)).select("file_path", "short", "full", "line").distinct(),
    "text_imports": lambda spark, sf_dir: X.imports(sources(spark, sf_dir)).select("file_path", "imported", "line").distinct(),
    "text_uses": lambda spark, sf_dir: X.uses(sources(spark, sf_dir)).select("file_path", "used", "line").distinct(),
    "text_functions": lambda spark, sf_dir: X.functions(sources(spark, sf_dir)).select("file_path", "module", "function", "kind", "line").distinct(),
    "text_function_bodies": _texts(X.functions),
    "text_docs": _texts(X.docs),
    "text_symbols": _texts(X.symbols),
    "text_folds": _texts(X.folds),
    "text_bare_calls": _texts(X.bare_calls),
    "text_buffer_functions": _texts(X.buffer_functions),
    "text_impl_annotations": _texts(X.impl_annotations),
    "text_using_edges": _texts(X.using_edges),
    "enclosing_by_block": enclosing_by_block,
    "definition_at": _handler("definition"),
    "hover_at": _handler("hover"),
    "signature_at": _handler("signature_help"),
    "definition_at_modules": definition_at_modules,
    "variable_places": variable_places,
    "parse_definitions": parse_definitions,
    "parse_references": parse_references,
    "parse_roundtrip": parse_roundtrip,
    "parse_refs_roundtrip": parse_refs_roundtrip,
    "token_counts": lambda spark, sf_dir: token_counts(sources(spark, sf_dir)),
    "line_counts": line_counts,
    "import_lines": import_lines,
}

_TEXTS = r"""
WITH S AS (SELECT path, arg_max(source_text, (read_at, source_text)) AS t FROM sources WHERE path IS NOT NULL AND source_text IS NOT NULL GROUP BY path),
L AS (SELECT path, string_split(replace(ltrim(t, chr(65279)), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM S)
"""
_WORD = """CASE kind WHEN 'module' THEN 'defmodule' WHEN 'type' THEN '@type' WHEN 'opaque' THEN '@opaque' WHEN 'callback' THEN '@callback'
    WHEN 'macrocallback' THEN '@macrocallback' ELSE kind END"""


def _sql() -> dict[str, str]:
    from codequarry.plans.core_queries import _D
    from codequarry.plans.data_queries import sql_module, sql_strip

    return {
        # A stored definition comes back if its line starts with the word of its kind.
        "parse_roundtrip": rf"""{_TEXTS}, D AS (SELECT DISTINCT {_D} FROM definitions)
SELECT DISTINCT module, function, arity, kind, line, file_path FROM D JOIN L ON L.path = file_path
WHERE regexp_matches(ltrim(ls[line]), '^' || {_WORD} || '( |\()')""",
        "parse_refs_roundtrip": f"""{_TEXTS}
SELECT DISTINCT {sql_module('module')} AS module, {sql_strip('function')} AS function, line, file_path, kind FROM refs JOIN L ON L.path = file_path
WHERE kind IN ('call', 'alias', 'import', 'use', 'require', 'behaviour')""",
        "text_aliases": f"""{_TEXTS} SELECT DISTINCT file_path, regexp_extract({sql_module('module')}, '[^.]*$') AS short, {sql_module('module')} AS full, line
FROM refs JOIN L ON L.path = file_path WHERE kind = 'alias'""",
        "text_imports": f"{_TEXTS} SELECT DISTINCT file_path, {sql_module('module')} AS imported, line FROM refs JOIN L ON L.path = file_path WHERE kind = 'import'",
        "text_uses": f"{_TEXTS} SELECT DISTINCT file_path, {sql_module('module')} AS used, line FROM refs JOIN L ON L.path = file_path WHERE kind = 'use'",
        # What a line-by-line reading finds outside of literals: the source tables quote such heads only within heredocs.
        "text_scopes": rf"""{_TEXTS}, D AS (SELECT DISTINCT {_D} FROM definitions)
SELECT DISTINCT file_path, module, kind, line AS first_line FROM D JOIN L ON L.path = file_path
WHERE kind IN ('module', 'defprotocol', 'defimpl') AND regexp_matches(ltrim(ls[line]), '^' || {_WORD} || ' ')""",
        "line_counts": f"""{_TEXTS}, X AS (SELECT path AS file_path, unnest(ls) AS l FROM L)
SELECT file_path, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE trim(l) = '') AS n_blank FROM X GROUP BY file_path""",
        "import_lines": f"""WITH S AS (SELECT path, arg_max(source_text, (read_at, source_text)) AS t FROM sources WHERE source_text IS NOT NULL GROUP BY path)
SELECT DISTINCT {sql_module('module')} AS module, file_path, line, string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10))[line] AS text
FROM refs JOIN S ON path = file_path WHERE kind = 'import' AND line <= len(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10)))""",
    }


SQL = _sql() | text_sql.SQL
