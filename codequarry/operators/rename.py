"""Renames as tables of edits: file_path, line (from 1), col and length (bytes), new_text. Nothing is written here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import names as N
from codequarry.functions.edits import delegate_span, replace_at, with_delegate_as
from codequarry.lang.cursor import function_token_columns, token_columns
from codequarry.lang.variables import Variables, token_occurrences
from codequarry.operators import injection
from codequarry.operators.handlers import KEY, Workspace, resolved, stored, texts_with_places
from codequarry.operators.links import rename_collisions, rename_map, rename_sites
from codequarry.operators.lookup import delegates_to, function_rows, module_rows
from codequarry.sources import text_tables as X
from codequarry.sources.files import lines

EDITS = "file_path string, line int, col int, length int, new_text string"
_EDIT_NAMES = [x.split()[0] for x in EDITS.split(", ")]


def per_place(sources: DataFrame, places: DataFrame, rows_of, schema: str) -> DataFrame:
    """file_path and what `rows_of(variables, line, col)` gives for each place; a text is read once for all of its places."""
    names = ["file_path", "line", "col", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, found in zip(b["file_path"], b["source_text"], b["places"], strict=True):
                v = Variables(text)
                for p in found:
                    rows += [(path, p["line"], p["col"], *r) for r in rows_of(v, p["line"], p["col"])]
            yield pd.DataFrame(rows, columns=names)

    return texts_with_places(sources, places).mapInPandas(run, f"file_path string, line int, col int, {schema}")


def variable_occurrences(sources: DataFrame, places: DataFrame) -> DataFrame:
    """file_path, line, col of each place with every occurrence (at_line, at_col, at_end, from 0) of its variable."""
    return per_place(sources, places, lambda v, line, col: v.occurrences(line, col), "at_line int, at_col int, at_end int")


def variables_in_scope(sources: DataFrame, places: DataFrame) -> DataFrame:
    return per_place(sources, places, lambda v, line, col: [(n,) for n in v.names_at(line, col)], "name string")


def highlights(w: Workspace, places: DataFrame) -> DataFrame:
    """What to highlight with each place: the occurrences of its variable, else equal tokens of the same text."""

    def rows(v: Variables, line: int, col: int):
        found = v.occurrences(line, col)
        if not found:
            i = v._token(line, col)
            if i >= 0 and v.t.kind(i) in ("ident", "module"):
                found = token_occurrences(v.text, v.t.word(i))
        return found

    return per_place(w.sources, places, rows, "at_line int, at_col int, at_end int")


def rename_variables(sources: DataFrame, renames: DataFrame) -> DataFrame:
    """Edits that give the variable at each place (file_path, line, col, new_name) its new name; none where the name is
    not valid or would collide with another variable of the definition."""
    found = variable_occurrences(sources, renames)
    taken = per_place(
        sources,
        renames,
        lambda v, line, col: [(n,) for n in {v.t.word(i) for i, k in enumerate(v.t.all) if k.kind == "ident"} if v.name_exists(line, col, n)],
        "new_name string",
    )
    allowed = renames.where(N.is_function_name(F.col("new_name"))).join(taken, [*KEY, "new_name"], "left_anti")
    # Occurrences count characters; edits count bytes.
    text = lines(sources).select("file_path", (F.col("line") - 1).alias("at_line"), "text")
    rows = found.join(allowed, KEY).join(text, ["file_path", "at_line"])
    before = F.octet_length(F.expr("substring(text, 1, at_col)"))
    length = F.octet_length(F.expr("substring(text, at_col + 1, at_end - at_col)"))
    return rows.select("file_path", (F.col("at_line") + 1).alias("line"), before.alias("col"), length.alias("length"), F.col("new_name").alias("new_text")).distinct()


def _token_edits(sites: DataFrame, sources: DataFrame, keys_too: bool = False) -> DataFrame:
    """Edits of the whole token `token` on the lines of `sites` (file_path, line, token, new_text)."""
    text = lines(sources)
    joined = sites.select("file_path", "line", "token", "new_text").distinct().join(text, ["file_path", "line"])

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = token_columns if keys_too else function_token_columns
        for b in batches:
            rows = [
                (path, line, col, len(token.encode()), new)
                for path, line, token, new, t in zip(b["file_path"], b["line"], b["token"], b["new_text"], b["text"], strict=True)
                for col in columns(t, token)
            ]
            yield pd.DataFrame(rows, columns=_EDIT_NAMES)

    return joined.mapInPandas(edit, EDITS)


def rename_functions(w: Workspace, renames: DataFrame) -> DataFrame:
    """Edits that rename functions (module, function, new_name) wherever they are defined, specified, imported and
    called; facades that delegate to them get `as:`."""
    asked = renames.where(N.is_function_name(F.col("new_name"))).select("module", "function", "new_name").distinct()
    token = [F.col("function").alias("token"), F.col("new_name").alias("new_text")]
    defined = function_rows(w.d).join(asked, ["module", "function"])
    called = w.r.where("kind NOT IN ('alias', 'use')").join(asked, ["module", "function"])
    injectors = injection.injecting_modules(w.spark, w.using_edges(), asked.select(F.col("module").alias("seed")))
    through = asked.join(injectors.select(F.col("seed").alias("module"), F.col("node").alias("_i")), "module").select("_i", "function", "new_name")
    injected = w.r.withColumnRenamed("module", "_i").join(through, ["_i", "function"])
    homes = defined.select("file_path", "function", "new_name").distinct()
    bare = X.bare_calls(w.texts).join(homes, ["file_path", "function"])
    named = r"^\s*@(?:spec|callback|macrocallback)\s+([a-z_]\w*[?!]?)"
    specs = lines(w.sources).withColumn("function", F.regexp_extract("text", named, 1)).where("function <> ''").join(homes, ["file_path", "function"])
    sites = None
    for rows in (defined, called, injected, bare, specs):
        one = rows.select("file_path", "line", *token)
        sites = one if sites is None else sites.unionByName(one)
    imported = w.r.where("kind = 'import'").select("module", "file_path", "line").join(asked.withColumnRenamed("module", "_m"), F.col("module") == F.col("_m"))
    edits = _token_edits(sites, w.sources).unionByName(_token_edits(imported.select("file_path", "line", *token), w.sources, keys_too=True))
    return edits.unionByName(_facade_edits(w, asked)).distinct()


def _facade_edits(w: Workspace, asked: DataFrame) -> DataFrame:
    facades = delegates_to(w.d, asked).join(asked, ["module", "function"])
    per_file = facades.select("file_path", "line", "facade_function", "new_name").distinct().groupBy("file_path")
    per_file = per_file.agg(F.collect_list(F.struct("line", "facade_function", "new_name")).alias("delegates"))
    texts = w.sources.where("source_text IS NOT NULL").select(F.col("path").alias("file_path"), "source_text")

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, delegates in zip(b["file_path"], b["source_text"], b["delegates"], strict=True):
                text = text.replace("\r\n", "\n")
                for x in delegates:
                    lo, hi = delegate_span(text, x["line"])
                    if hi > lo:
                        old = text[lo:hi]
                        new = with_delegate_as(old, "" if x["facade_function"] == x["new_name"] else x["new_name"])
                        start = text.rfind("\n", 0, lo) + 1
                        if new != old:
                            rows.append((path, x["line"], len(text[start:lo].encode()), len(old.encode()), new))
            yield pd.DataFrame(rows, columns=_EDIT_NAMES)

    return texts.join(per_file, "file_path").mapInPandas(edit, EDITS)


def rename_modules(w: Workspace, renames: DataFrame) -> DataFrame:
    """Edits that rename modules and what is under them (old_prefix, new_prefix); none for a prefix that would collide
    with a module that stays. On each line the full name is looked for, else ever shorter ends of it."""
    valid = renames.where(N.is_module_name(F.col("new_prefix")))
    clashes = rename_collisions(w.d, valid).select("new_module").distinct()
    hit = rename_map(w.d, valid).join(clashes, "new_module", "left_semi").select("old_module")
    blocked = hit.join(valid, (F.col("old_module") == F.col("old_prefix")) | F.startswith(F.col("old_module"), F.concat("old_prefix", F.lit("."))))
    allowed = valid.join(blocked.select("old_prefix").distinct(), "old_prefix", "left_anti")
    sites = rename_sites(w.d, w.r, allowed).select("file_path", "line", "old_module", "new_module").distinct()
    joined = sites.join(lines(w.sources), ["file_path", "line"])

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, line, old, new, text in zip(b["file_path"], b["line"], b["old_module"], b["new_module"], b["text"], strict=True):
                was, now = old.split("."), new.split(".")
                for n in range(len(was)):
                    token = ".".join(was[n:])
                    columns = token_columns(text, token)
                    if columns:
                        # The same number of leading segments is left out of the new name.
                        short = ".".join(now[min(n, len(now) - 1) :])
                        rows += [(path, line, c, len(token.encode()), short) for c in columns if short != token]
                        break
            yield pd.DataFrame(rows, columns=_EDIT_NAMES)

    return joined.mapInPandas(edit, EDITS).distinct()


def file_moves(w: Workspace, renames: DataFrame) -> DataFrame:
    """old_path, new_path of files named after a module that is renamed."""
    moved = rename_map(w.d, renames)
    rows = module_rows(w.d).select(F.col("module").alias("old_module"), "file_path").distinct().join(moved, "old_module")
    fits = rows.where(N.follows_convention(F.col("old_module"), F.col("file_path")))
    return fits.select(F.col("file_path").alias("old_path"), N.conventional_path(F.col("new_module"), F.col("file_path")).alias("new_path")).where(
        "old_path <> new_path"
    )


def prepare_rename(w: Workspace, places: DataFrame, foreign: str = r"(^|/)(deps|stdlib)/", foreign_files: DataFrame | None = None) -> DataFrame:
    """file_path, line, col, target, name of what can be renamed at each place: a variable, an alias (a short name of the
    file's own that `as:` gave), a function or a module; what is only defined in files that match `foreign`, or that are among
    `foreign_files` (path, as of `sources.files.dependency_files`), cannot."""
    variables = variable_occurrences(w.sources, places).select(*KEY).distinct().withColumn("target", F.lit("variable")).withColumn("name", F.lit(""))
    at = stored(w.spark, resolved(w, places).where("module <> ''").join(variables.select(*KEY), KEY, "left_anti"))
    short = (F.col("function") == "") & F.col("own_alias") & (F.substring_index("module", ".", -1) != F.col("written"))
    aliases = at.where(short).select(*KEY, F.lit("alias").alias("target"), F.col("written").alias("name"))
    at = at.where(~short)
    own = w.d.where(~F.col("file_path").rlike(foreign))
    if foreign_files is not None:
        own = own.join(foreign_files.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    functions = function_rows(own).select("module", "function").distinct()
    modules = module_rows(own).select("module").distinct()
    f = at.where("function <> ''").join(functions, ["module", "function"], "left_semi").select(*KEY, F.lit("function").alias("target"), F.concat_ws(".", "module", "function").alias("name"))
    m = at.where("function = ''").join(modules, "module", "left_semi").select(*KEY, F.lit("module").alias("target"), F.col("module").alias("name"))
    return variables.unionByName(aliases).unionByName(f).unionByName(m)


def rename_aliases(sources: DataFrame, renames: DataFrame) -> DataFrame:
    """Edits that give the short name `name` of a file (file_path, name, new_name) its new one, wherever it stands in it as
    the first segment of a module's name; strings and comments are passed over."""
    asked = renames.where(N.is_module_name(F.col("new_name")) & ~F.contains("new_name", F.lit("."))).select("file_path", "name", "new_name").distinct()
    # Short names of one file are at most as many as its text has words.
    per_file = asked.groupBy("file_path").agg(F.collect_list(F.struct("name", "new_name")).alias("names"))
    texts = sources.where("source_text IS NOT NULL").select(F.col("path").alias("file_path"), "source_text")

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, names in zip(b["file_path"], b["source_text"], b["names"], strict=True):
                text = text.replace("\r\n", "\n")
                lines = text.split("\n")
                for x in names:
                    for line, col, end in token_occurrences(text, x["name"]):
                        before = lines[line][:col]
                        if not before.endswith("."):
                            rows.append((path, line + 1, len(before.encode()), len(lines[line][col:end].encode()), x["new_name"]))
            yield pd.DataFrame(rows, columns=_EDIT_NAMES)

    return texts.join(per_file, "file_path").mapInPandas(edit, EDITS)


def rename(w: Workspace, requests: DataFrame, foreign: str = r"(^|/)(deps|stdlib)/") -> DataFrame:
    """Edits for each request (file_path, line, col, new_name), whatever stands at its place; none where it cannot be renamed
    or the new name is not valid for it."""
    asked = stored(w.spark, requests.select(*KEY, "new_name").distinct())
    found = stored(w.spark, prepare_rename(w, asked, foreign).join(asked, KEY))
    variables = rename_variables(w.sources, found.where("target = 'variable'").select(*KEY, "new_name"))
    aliases = rename_aliases(w.sources, found.where("target = 'alias'").select("file_path", "name", "new_name"))
    functions = found.where("target = 'function'").select(
        F.expr("substring(name, 1, length(name) - length(substring_index(name, '.', -1)) - 1)").alias("module"), F.substring_index("name", ".", -1).alias("function"), "new_name"
    )
    modules = found.where("target = 'module'").select(F.col("name").alias("old_prefix"), F.col("new_name").alias("new_prefix"))
    return variables.unionByName(aliases).unionByName(rename_functions(w, functions)).unionByName(rename_modules(w, modules)).distinct()


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """path, source_text after the edits; texts without edits are left out. The edits of a file come to its text as one
    array. Line ends are kept."""
    per_file = edits.groupBy(F.col("file_path").alias("path")).agg(F.collect_set(F.struct("line", "col", "length", "new_text")).alias("edits"))
    texts = sources.where("source_text IS NOT NULL").select("path", "source_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text, found in zip(b["path"], b["source_text"], b["edits"], strict=True):
                end = "\r\n" if "\r\n" in text else "\n"
                rows = text.replace("\r\n", "\n").split("\n")
                by_line: dict[int, list] = {}
                for e in found:
                    by_line.setdefault(e["line"], []).append((e["col"], e["length"], e["new_text"]))
                for line, changes in sorted(by_line.items(), reverse=True):
                    longest = max(c + n for c, n, _ in changes)
                    last = line - 1
                    joined = rows[last]
                    while len(joined.encode()) < longest and last + 1 < len(rows):  # a statement over several lines
                        last += 1
                        joined += "\n" + rows[last]
                    # An edit within one that replaces more is part of it.
                    kept = [x for x in changes if not any(y != x and y[0] <= x[0] and x[0] + x[1] <= y[0] + y[1] for y in changes)]
                    rows[line - 1 : last + 1] = replace_at(joined, kept).split("\n")
                out.append((path, end.join(rows)))
            yield pd.DataFrame(out, columns=["path", "source_text"])

    return texts.join(per_file, "path").mapInPandas(run, "path string, source_text string")


def write_texts(texts: DataFrame, moves: DataFrame | None = None) -> int:
    """The explicit step that changes files: write each text (path, source_text), then move files; how many were written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            done = []
            for path, text in zip(b["path"], b["source_text"], strict=True):
                aside = f"{path}.writing"
                with open(aside, "w", newline="") as f:
                    f.write(text)
                os.replace(aside, path)
                done.append(path)
            yield pd.DataFrame({"path": done})

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            for old, new in zip(b["old_path"], b["new_path"], strict=True):
                if os.path.exists(old) and not os.path.exists(new):
                    os.makedirs(os.path.dirname(new) or ".", exist_ok=True)
                    os.replace(old, new)
            yield pd.DataFrame({"path": b["new_path"]})

    n = texts.select("path", "source_text").mapInPandas(write, "path string").count()
    if moves is not None:
        moves.select("old_path", "new_path").mapInPandas(move, "path string").count()
    return n
