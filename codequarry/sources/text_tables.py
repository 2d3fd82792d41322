"""Tables of what source texts say about themselves.

Each table can be had from texts (path, source_text): one pass over each text, no shuffle. Where several are asked for,
`outlines` reads every text once and keeps all of them, a row for each file; stored, a table is then a scan of its own
column, since the others are not read. An array in such a row is no longer than its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.lang.outline import Outline
from codequarry.lang.using import using_bodies


def per_text(sources: DataFrame, rows_of: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """file_path and the rows that `rows_of` finds in each text of `sources` (path, source_text); NULL texts: none."""
    whole = f"file_path string, {schema}"
    names = [c.split()[0] for c in whole.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *r) for path, text in zip(b["path"], b["source_text"], strict=True) for r in rows_of(text)]
            yield pd.DataFrame(rows, columns=names)

    return sources.where("source_text IS NOT NULL").select("path", "source_text").mapInPandas(run, whole)


# ---------------------------------------------------------------- rows of one text


def _named(o: Outline, scope: int) -> str:
    return o.scopes[scope].name if scope >= 0 else ""


def _depth(o: Outline, s) -> int:
    n = 0
    while s.parent >= 0:
        n, s = n + 1, o.scopes[s.parent]
    return n


def _bodies(o: Outline):
    """What using the modules of a text brings; few texts say so, and only these are read for it."""
    return using_bodies(o.text) if "using" in o.text else []


def _docs(o: Outline):
    first: dict[str, int] = {}
    for n, s in enumerate(o.scopes):
        if doc := o.moduledocs.get(first.setdefault(s.name, n), ""):
            yield s.name, "", 0, s.first_line, doc, ""
    above = o.docs_above([f.line for f in o.functions])
    for f in o.functions:
        doc, spec = above[f.line]
        if doc or spec:
            yield f.module, f.name, len(f.params), f.line, doc, spec


def _impls(o: Outline):
    for f in o.functions:
        if value := o.impl_above(f.line):
            yield f.module, f.name, len(f.params), f.line, value


#: Each table: the rows of an outline, and their columns after file_path.
TABLES: dict[str, tuple[Callable[[Outline], Iterable[tuple]], str]] = {
    "scopes": (
        lambda o: [(s.name, s.kind, s.first_line, s.last_line, _depth(o, s), _named(o, s.parent)) for s in o.scopes],
        "module string, kind string, first_line int, last_line int, depth int, parent string",
    ),
    "aliases": (lambda o: [(_named(o, a.scope), a.short, a.full, a.line) for a in o.aliases], "module string, short string, full string, line int"),
    "imports": (
        lambda o: [(_named(o, s), m, line, n) for n, (m, line, s) in enumerate(o.imports)],
        "module string, imported string, line int, ordinal int",
    ),
    "uses": (
        lambda o: [(_named(o, u.scope), u.module, u.options, u.line, n) for n, u in enumerate(o.resolved_uses())],
        "module string, used string, options map<string,string>, line int, ordinal int",
    ),
    "using_edges": (
        lambda o: [(module, *e) for module, body in _bodies(o) for e in body.edges()],
        "module string, kind string, ordinal int, target string, function string, arity int, option string",
    ),
    "inline_functions": (
        lambda o: [(module, f[0], f[-1]) for module, body in _bodies(o) for f in body.functions],
        "module string, function string, line int",
    ),
    "functions": (
        lambda o: [(f.module, f.name, len(f.params), f.kind, f.line, f.last_line) for f in o.functions],
        "module string, function string, arity int, kind string, line int, last_line int",
    ),
    "buffer_functions": (lambda o: o.buffer_functions(), "function string, arity int, kind string, params string, line int"),
    "docs": (_docs, "module string, function string, arity int, line int, doc string, spec string"),
    "impl_annotations": (_impls, "module string, function string, arity int, line int, impl string"),
    "bare_calls": (
        lambda o: [(name, line) for name, lines in sorted(o.bare_calls().items()) for line in lines],
        "function string, line int",
    ),
    "symbols": (lambda o: o.symbols(), "index int, parent int, kind string, label string, first_line int, last_line int"),
    "folds": (lambda o: o.folds(), "first_line int, last_line int, kind string"),
}
#: What answers for places read; outlines of whole files (symbols, folds) are asked for by themselves.
FOR_PLACES = ("scopes", "aliases", "imports", "uses", "using_edges", "inline_functions", "functions", "buffer_functions", "docs", "impl_annotations", "bare_calls")


def _columns(schema: str) -> list[tuple[str, str]]:
    # A map's comma is followed by no blank.
    return [tuple(c.split(" ", 1)) for c in schema.split(", ")]


def outlines(sources: DataFrame, tables: tuple[str, ...] = FOR_PLACES) -> DataFrame:
    """path and, for each of `tables`, the array of its rows in that text: every text is read once. NULL texts: none."""
    kinds = {t: ", ".join(f"{c}:{k}" for c, k in _columns(TABLES[t][1])) for t in tables}
    schema = ", ".join(["path string", *[f"{t} array<struct<{k}>>" for t, k in kinds.items()]])
    fields = {t: [c for c, _ in _columns(TABLES[t][1])] for t in tables}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["source_text"], strict=True):
                o = Outline(text)
                rows.append((path, *[[dict(zip(fields[t], r, strict=True)) for r in TABLES[t][0](o)] for t in tables]))
            yield pd.DataFrame(rows, columns=["path", *tables])

    return sources.where("source_text IS NOT NULL").select("path", "source_text").mapInPandas(run, schema)


def table(name: str, texts: DataFrame) -> DataFrame:
    """A table, of texts or of their `outlines`."""
    rows_of, schema = TABLES[name]
    if name in texts.columns:
        return texts.select(F.col("path").alias("file_path"), F.explode(name).alias("_x")).select("file_path", "_x.*")
    return per_text(texts, lambda text: rows_of(Outline(text)), schema)


# ---------------------------------------------------------------- the tables


def scopes(texts: DataFrame) -> DataFrame:
    """Modules with the lines of their blocks: where a line belongs after a nested module's `end`."""
    return table("scopes", texts)


def aliases(texts: DataFrame) -> DataFrame:
    return table("aliases", texts)


def imports(texts: DataFrame) -> DataFrame:
    """Imports as written, in order."""
    return table("imports", texts)


def uses(texts: DataFrame) -> DataFrame:
    """Uses resolved through aliases, in order, with those options whose values are modules."""
    return table("uses", texts)


def using_edges(texts: DataFrame) -> DataFrame:
    """What using each module brings: kind (inline, import, use, option_import, option_use, alias), in order."""
    return table("using_edges", texts)


def inline_functions(texts: DataFrame) -> DataFrame:
    """Functions that using each module writes into the text, with the lines that they are written on."""
    return table("inline_functions", texts)


def functions(texts: DataFrame) -> DataFrame:
    """Functions with the lines of their bodies."""
    return table("functions", texts)


def buffer_functions(texts: DataFrame) -> DataFrame:
    return table("buffer_functions", texts)


def docs(texts: DataFrame) -> DataFrame:
    """Documentation and spec of each function that has either, and of modules (with an empty function)."""
    return table("docs", texts)


def impl_annotations(texts: DataFrame) -> DataFrame:
    return table("impl_annotations", texts)


def bare_calls(texts: DataFrame) -> DataFrame:
    """Lines with calls of each name without a module, for all names that a file calls so."""
    return table("bare_calls", texts)


def symbols(texts: DataFrame) -> DataFrame:
    """Outline rows with the index of their parent, -1 at the top."""
    return table("symbols", texts)


def folds(texts: DataFrame) -> DataFrame:
    return table("folds", texts)
