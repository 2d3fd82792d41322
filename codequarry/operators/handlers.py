"""Answers for places in source texts, for any number of places at once.

`places` are file_path, line and col (both from 0, as editors count). Every handler resolves all of them in one pass
over the texts and answers with joins; a place without an answer is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.edits import hover_text, signature_line
from codequarry.functions.names import call_text, completion_data, normal_path
from codequarry.lang import cursor as C
from codequarry.lang.outline import Outline
from codequarry.lang.parser import resolve_alias
from codequarry.lang.variables import Variables
from codequarry.operators import injection
from codequarry.operators.asof import behaviour_implementors, enclosing_function, resolve_nested
from codequarry.operators.composite import lookup_rows
from codequarry.operators.graph import follow_delegates
from codequarry.operators.links import behaviours_for_file, function_module_in_file, implementations
from codequarry.operators.lookup import all_pairs, callback_rows, delegates_to, function_rows, is_type, module_rows, references
from codequarry.session import width, workspace
from codequarry.sources import text_tables as X

_AT = (
    "file_path string, line int, col int, written string, module string, function string, enclosing string, attribute_line int, "
    "variable_line int, aliased boolean, own_alias boolean, callee_module string, callee_function string, argument int"
)
_NAMES = [x.split()[0] for x in _AT.split(", ")]
KEY = ["file_path", "line", "col"]


@dataclass
class Workspace:
    """The tables that handlers read: definitions, references and texts (path, source_text).

    `edges`: what using each module brings, where an index keeps it (`Index.edges`, worked out anew for changed files only);
    otherwise it is read from the texts.
    """

    spark: SparkSession
    d: DataFrame
    r: DataFrame
    sources: DataFrame
    edges: DataFrame | None = None

    def __post_init__(self):
        self._chains: DataFrame | None = None
        self._outlines: DataFrame | None = None

    @property
    def texts(self) -> DataFrame:
        """What all text tables read: the outlines of the texts, each read once."""
        if self._outlines is None:
            self._outlines = stored(self.spark, X.outlines(self.sources))
        return self._outlines

    def using_edges(self) -> DataFrame:
        """Rows of `text_tables.using_edges`, worked out once."""
        if self.edges is None:
            self.edges = stored(self.spark, X.using_edges(self.texts))
        return self.edges

    def offered(self) -> DataFrame:
        """What use chains offer each file (seed is the path); walked once."""
        if self._chains is None:
            uses = X.uses(self.texts).select(F.col("file_path").alias("seed"), F.col("used").alias("module"), "ordinal", "options")
            edges = self.using_edges()
            self._seen = stored(self.spark, injection.visits(self.spark, edges, uses))
            self._chains = stored(self.spark, injection.providers(edges, self._seen))
        return self._chains

    def aliases(self) -> DataFrame:
        """For each file the aliases that its use chains bring: file_path, injected (short, full)."""
        injected = injection.injected_aliases(self.using_edges(), self.seen())
        return injected.groupBy(F.col("seed").alias("file_path")).agg(F.collect_list(F.struct("short", "full")).alias("injected"))

    def seen(self) -> DataFrame:
        self.offered()
        return self._seen


def expressions(sources: DataFrame, places: DataFrame, injected: DataFrame | None = None) -> DataFrame:
    """What stands at each place: module (aliases of the enclosing module resolved, then those of `Workspace.aliases`),
    function, the enclosing module, the lines of the attribute and of the variable under the cursor (0: none), and the call around the place with its argument's number.

    All places of a file are answered with one reading of its text, which travels once: the places of a file come to
    it as one array.
    """
    rows = texts_with_places(sources, places)
    if injected is None:
        rows = rows.withColumn("injected", F.lit(None).cast("array<struct<short:string,full:string>>"))
    else:
        rows = rows.join(injected, "file_path", "left_outer")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, found, brought in zip(b["file_path"], b["source_text"], b["places"], b["injected"], strict=True):
                text = text.replace("\r\n", "\n")
                o, variables = Outline(text), None
                aliases_of: dict[int, dict[str, str]] = {}
                lent = {} if brought is None else {x["short"]: x["full"] for x in brought}
                rows_of_text = text.split("\n")
                for p in found:
                    line, col = p["line"], p["col"]
                    if not 0 <= line < len(rows_of_text):
                        continue
                    e = C.expression_at(o.t, line, col)
                    own = o.module_at(line + 1)
                    scope = o.scope_at(line + 1)
                    if scope not in aliases_of:
                        aliases_of[scope] = o.alias_map(line + 1)
                    own_aliases = aliases_of[scope]
                    aliases = lent | own_aliases if lent else own_aliases
                    group = C.alias_group_parent(o.t, line, col)
                    name = f"{group}.{e.module}" if group and e.module else e.module
                    full = resolve_alias(name, {} if group else aliases, own) if name else ""
                    call, argument = C.call_at(o.t, line, col)
                    cm, cf = C.module_and_function(call)
                    attribute = C.attribute_at(rows_of_text[line], col)
                    variable = 0
                    if e.function and not e.module and not attribute:
                        variables = variables or Variables(text)
                        variable = min((x.line + 1 for x in variables.occurrences(line, col)), default=0)
                    rows.append(
                        (path, line, col, e.module, full, e.function, own, o.attribute_line(attribute) if attribute else 0, variable,
                         full != name, name in own_aliases, resolve_alias(cm, aliases, own) if cm else "", cf, argument)
                    )
            yield pd.DataFrame(rows, columns=_NAMES)

    return rows.mapInPandas(resolve, _AT)


def places_by_file(places: DataFrame) -> DataFrame:
    """file_path, places: the distinct places of each file. A text has no more of them than characters (places beyond its
    ends have no answer), so the array is bounded by the text that it is joined with, however often a place is asked for."""
    asked = places.where("line >= 0 AND col >= 0").select(*KEY).distinct()
    return asked.groupBy("file_path").agg(F.collect_list(F.struct("line", "col")).alias("places"))


def texts_with_places(sources: DataFrame, places: DataFrame) -> DataFrame:
    """file_path, source_text, places. Texts travel once, and to a fixed number of tasks: what follows takes time by place."""
    n = width(sources.sparkSession)
    texts = sources.where("source_text IS NOT NULL").select(F.col("path").alias("file_path"), "source_text").repartition(n, "file_path")
    return texts.join(places_by_file(places).repartition(n, "file_path"), "file_path")


def stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder: what is read several times is worked out once."""
    folder = workspace(spark, "places")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def resolved(w: Workspace, places: DataFrame) -> DataFrame:
    """`expressions` with the module that bare functions and relative module names mean."""
    at = stored(w.spark, expressions(w.sources, places, w.aliases()))
    named = at.where("module <> ''")
    relative = resolve_nested(
        named.where("NOT aliased").select("enclosing", F.col("module").alias("name")), w.d
    ).withColumnRenamed("module", "_nested").withColumnRenamed("name", "module")
    known = module_rows(w.d).select("module").distinct().withColumn("_known", F.lit(True))
    full = (
        named.join(known, "module", "left_outer")
        .join(relative, ["enclosing", "module"], "left_outer")
        .withColumn("module", F.when(F.col("_known").isNull(), F.coalesce("_nested", "module")).otherwise(F.col("module")))
        .select(*_NAMES)
    )
    bare = at.where("module = '' AND function <> ''").withColumn("_probe", F.col("line") + 1)
    asked = bare.select(F.col("file_path").alias("seed"), "function").distinct()
    here = function_module_in_file(w.d, bare.select("file_path", F.col("_probe").alias("line"), "function"))
    here = here.groupBy(F.col("file_path").alias("seed"), "function").agg(F.min("module").alias("module"))
    imports = X.imports(w.texts).select(F.col("file_path").alias("seed"), "imported", "ordinal")
    used = injection.lookup_through_use(w.d, w.offered(), asked)
    meaning = stored(w.spark, injection.bare_function_module(w.d, asked, here, imports, used))
    # Last, the imports' own use chains: the name means the first import that brings it.
    unmeant = asked.join(meaning, ["seed", "function"], "left_anti").join(imports, "seed").withColumnRenamed("imported", "module")
    brought = use_chain_of(w, unmeant).select("module", "function")
    last = unmeant.join(brought, ["module", "function"]).groupBy("seed", "function").agg(F.min(F.struct("ordinal", "module")).alias("x"))
    meaning = meaning.unionByName(last.select("seed", "function", F.col("x.module").alias("module")))
    meaning = meaning.select(F.col("seed").alias("file_path"), "function", F.col("module").alias("_meant"))
    found = bare.join(meaning, ["file_path", "function"], "left_outer").withColumn("module", F.coalesce("_meant", F.lit(""))).select(*_NAMES)
    return full.unionByName(found).unionByName(at.where("module = '' AND function = ''"))


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, "target_path", "target_line").where("target_line > 0").distinct()


def use_chain_of(w: Workspace, keys: DataFrame) -> DataFrame:
    """module, function, provider, origin: what the use chain of the module's file brings under the function's name."""
    home = module_rows(w.d).groupBy("module").agg(F.min(F.struct("line", "file_path")).alias("x")).select("module", F.col("x.file_path").alias("seed"))
    asked = stored(w.spark, keys.select("module", "function").distinct().join(home, "module"))
    found = injection.lookup_through_use(w.d, w.offered(), asked).join(asked, ["seed", "function"])
    return stored(w.spark, found.select("module", "function", "provider", "origin"))


def through_use_of(w: Workspace, keys: DataFrame, follow: bool = True) -> DataFrame:
    """module, function, file_path, line: where functions come from that the use chain of the module's file brings."""
    found = use_chain_of(w, keys)
    imported = found.where("origin <> 'inline'")
    rows = lookup_rows(w.d, imported.select(F.col("provider").alias("module"), "function"), follow, strict=True).withColumnRenamed("module", "provider")
    inline = X.inline_functions(w.texts).withColumnRenamed("module", "provider")
    columns = ["module", "function", "file_path", "line"]
    hits = imported.join(rows, ["provider", "function"]).select(*columns)
    return hits.unionByName(found.where("origin = 'inline'").join(inline, ["provider", "function"]).select(*columns)).distinct()


def definition(w: Workspace, places: DataFrame, follow: bool = True, in_text: bool = True) -> DataFrame:
    """Where what stands at each place is defined: an attribute's value, a variable, a function (delegates followed; then
    through the use chain of its module; then its module), or a module. Types only where no function has the name. Without
    `in_text` neither variables nor the use chains of called modules count."""
    found, joins = _defined(w, places, follow, in_text)
    # A place is in one part only, and places and targets are distinct: so are the answers, as many as they are.
    for rows, targets, on in joins:
        found = found.unionByName(all_pairs(rows, targets, on).select(*KEY, "target_path", "target_line"))
    return found


def _defined(w: Workspace, places: DataFrame, follow: bool, in_text: bool) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame, list[str]]]]:
    """The answers of `definition` before places meet their targets, whose number is the product of both: answers within
    the text, and parts (places, targets, the key that joins them), with distinct rows and each place in one of them."""
    at = stored(w.spark, resolved(w, places))
    attributes = at.where("attribute_line > 0").withColumn("target_path", F.col("file_path")).withColumn("target_line", F.col("attribute_line"))
    rest = at.where("attribute_line = 0")
    found = _answers(attributes)
    if in_text:
        found = found.unionByName(_answers(rest.withColumn("target_path", F.col("file_path")).withColumn("target_line", F.col("variable_line"))))
        rest = rest.where("variable_line = 0")
    asked = rest.where("function <> '' AND module <> ''")
    hits = lookup_rows(w.d, asked, follow, strict=True)
    if in_text:
        hits = stored(w.spark, hits)
        missed = asked.select("module", "function").distinct().join(hits, ["module", "function"], "left_anti")
        hits = hits.unionByName(through_use_of(w, missed, follow))
    kinds = function_rows(w.d).select("file_path", "line", is_type(F.col("kind")).alias("t")).groupBy("file_path", "line").agg(F.min("t").alias("t"))
    ranked = stored(w.spark, hits.join(kinds, ["file_path", "line"], "left_outer").withColumn("t", F.coalesce("t", F.lit(0))))
    best = ranked.groupBy("module", "function").agg(F.min("t").alias("_best"))
    chosen = ranked.join(best, ["module", "function"]).where(F.col("t") == F.col("_best"))
    chosen = chosen.select("module", "function", F.col("file_path").alias("target_path"), F.col("line").alias("target_line"))
    # What a use chain writes into the text itself is no definition of the provider; only bare names mean it.
    left = asked.join(best, ["module", "function"], "left_anti")
    inline = X.inline_functions(w.texts).select("module", "function", F.col("file_path").alias("target_path"), F.col("line").alias("target_line"))
    written = stored(w.spark, _answers(left.where("written = ''").join(inline, ["module", "function"])))
    modules = module_rows(w.d).select("module", F.col("file_path").alias("target_path"), F.col("line").alias("target_line"))
    named = rest.where("function = '' AND module <> ''").unionByName(left.join(written, KEY, "left_anti"))
    return found.unionByName(written), [
        (asked.select(*KEY, "module", "function").distinct(), chosen.where("target_line > 0").distinct(), ["module", "function"]),
        (named.select(*KEY, "module").distinct(), modules.where("target_line > 0").distinct(), ["module"]),
    ]


def type_definition(w: Workspace, places: DataFrame) -> DataFrame:
    """Where the type at each place is defined."""
    types = function_rows(w.d).where("kind IN ('type', 'opaque')").select(
        "module", "function", F.col("file_path").alias("target_path"), F.col("line").alias("target_line")
    )
    return _answers(resolved(w, places).join(types, ["module", "function"]))


def declaration(w: Workspace, places: DataFrame) -> DataFrame:
    """The callbacks that the function around each place implements: those of its own module and of the behaviours of its
    file together; only if there are none those of the modules of its use chains, and at last, for one marked
    `@impl true`, every callback of its name and arity (for `@impl Module` that module's)."""
    probes = places.select("file_path", (F.col("line") + 1).alias("line"), "col").distinct()
    inside = enclosing_function(probes, w.d).withColumn("line", F.col("line") - 1)
    inside = inside.withColumnsRenamed({"caller_function": "function", "caller_arity": "arity", "caller_module": "own"})
    callbacks = callback_rows(w.d).select(
        F.col("module").alias("behaviour"), "function", "arity", F.col("file_path").alias("target_path"), F.col("line").alias("target_line")
    )
    own = inside.withColumn("behaviour", F.col("own")).withColumn("p", F.lit(0))
    declared = inside.join(behaviours_for_file(w.d, w.r), "file_path").withColumn("p", F.lit(0))
    chain = w.seen().select(F.col("seed").alias("file_path"), F.col("module").alias("behaviour")).distinct()
    through = inside.join(chain, "file_path").withColumn("p", F.lit(2))
    found = own.unionByName(declared).unionByName(through).join(callbacks, ["behaviour", "function", "arity"])
    marked = X.impl_annotations(w.texts).select("file_path", F.col("line").alias("caller_line"), "impl")
    anywhere = inside.join(marked, ["file_path", "caller_line"]).join(callbacks, ["function", "arity"])
    anywhere = anywhere.where("impl = 'true' OR impl = behaviour").withColumn("p", F.lit(3))
    every = found.select(*KEY, "p", "target_path", "target_line").unionByName(anywhere.select(*KEY, "p", "target_path", "target_line"))
    best = every.groupBy(*KEY).agg(F.min("p").alias("_best"))
    return _answers(every.join(best, KEY).where(F.col("p") == F.col("_best")))


def implementation(w: Workspace, places: DataFrame) -> DataFrame:
    """Functions that implement the callback at each place; for a behaviour's name the modules that declare it."""
    at = stored(w.spark, resolved(w, places))
    functions = implementations(w.d, w.r).select(
        F.col("behaviour").alias("module"), "function", F.col("file_path").alias("target_path"), F.col("line").alias("target_line")
    )
    modules = behaviour_implementors(w.d, w.r).select(F.col("behaviour"), F.col("module").alias("_m"), "file_path")
    where = module_rows(w.d).select(F.col("module").alias("_m"), F.col("file_path").alias("target_path"), F.col("line").alias("target_line"))
    declared = modules.drop("file_path").join(where, "_m").select(F.col("behaviour").alias("module"), "target_path", "target_line")
    # A callback's own head is a bare name; it is a callback of the module that it stands in.
    asked = at.where("function <> ''")
    asked = asked.unionByName(asked.where("written = ''").withColumn("module", F.col("enclosing")))
    found = _answers(asked.join(functions, ["module", "function"]))
    return found.unionByName(_answers(at.where("function = '' AND module <> ''").join(declared, "module")))


def references_at(w: Workspace, places: DataFrame, declarations: bool = False, stdlib_prefix: str = "") -> DataFrame:
    """References to what stands at each place: for a variable its occurrences; else direct ones, those through modules that
    inject it, bare calls in its own file, and those through facades that delegate to it; for `__using__` the places that
    use its module. Each file and line once."""
    from codequarry.operators.rename import variable_occurrences

    every_place = stored(w.spark, resolved(w, places).select(*KEY, "module", "function", "variable_line"))
    variables = variable_occurrences(w.sources, every_place.where("variable_line > 0"))
    variables = variables.select(*KEY, F.col("file_path").alias("target_path"), (F.col("at_line") + 1).alias("target_line"))
    of_names = every_place.where("variable_line = 0 AND module <> ''")
    using = of_names.where("function = '__using__'").join(
        w.r.where("kind = 'use'").select("module", F.col("file_path").alias("target_path"), F.col("line").alias("target_line")), "module"
    )
    at = of_names.where("function <> '__using__'").select(*KEY, "module", "function")
    keys = at.select("module", "function").distinct()
    direct = references(w.r, keys).select("module", "function", F.col("file_path").alias("target_path"), F.col("line").alias("target_line"))
    named = keys.where("function <> ''")
    injectors = injection.injecting_modules(w.spark, w.using_edges(), named.select(F.col("module").alias("seed")))
    asked = named.join(injectors.select(F.col("seed").alias("module"), F.col("node").alias("_i")), "module")
    through = w.r.withColumnRenamed("module", "_i").join(asked, ["_i", "function"]).select(
        "module", "function", F.col("file_path").alias("target_path"), F.col("line").alias("target_line")
    )
    facades = delegates_to(w.d, named).select("module", "function", F.col("facade").alias("_f"), F.col("facade_function").alias("_ff")).distinct()
    delegated = w.r.withColumnsRenamed({"module": "_f", "function": "_ff"}).join(facades, ["_f", "_ff"]).select(
        "module", "function", F.col("file_path").alias("target_path"), F.col("line").alias("target_line")
    )
    homes = function_rows(w.d).select("module", "function", "file_path").distinct().join(named, ["module", "function"])
    bare = X.bare_calls(w.texts).join(homes, ["file_path", "function"]).select(
        "module", "function", F.col("file_path").alias("target_path"), F.col("line").alias("target_line")
    )
    every = direct.unionByName(through).unionByName(delegated).unionByName(bare)
    if declarations:
        own = lookup_rows(w.d, named, follow=False, strict=True).withColumnsRenamed({"file_path": "target_path", "line": "target_line"})
        every = every.unionByName(own.select(*every.columns))
    if stdlib_prefix:
        every = every.where(~F.startswith(F.col("target_path"), F.lit(stdlib_prefix)))
    found = _answers(at.join(every.distinct(), ["module", "function"]))
    return found.unionByName(_answers(variables)).unionByName(_answers(using)).distinct()


def hover(w: Workspace, places: DataFrame) -> DataFrame:
    """file_path, line, col, signature, spec, doc of what stands at each place."""
    found, joins = _defined(w, places, follow=True, in_text=False)
    docs = X.docs(w.texts).select(F.col("file_path").alias("target_path"), F.col("line").alias("target_line"), "doc", "spec")
    heads = X.functions(w.texts).select(F.col("file_path").alias("target_path"), F.col("line").alias("target_line"), "function", "arity", "kind")
    scopes = X.scopes(w.texts).select(
        F.col("file_path").alias("target_path"), F.col("first_line").alias("target_line"), F.col("module").alias("function"), F.lit(-1).alias("arity"), "kind"
    )
    label = F.concat_ws(" ", "kind", F.when(F.col("arity") < 0, F.col("function")).otherwise(F.concat_ws("/", "function", "arity")))
    signatures = heads.unionByName(scopes).select("target_path", "target_line", label.alias("signature"))
    row = F.struct((F.coalesce("doc", F.lit("")) == "").alias("bare"), "target_path", "target_line", "signature", F.coalesce("spec", F.lit("")).alias("spec"), F.coalesce("doc", F.lit("")).alias("doc"))

    def said(targets: DataFrame, by: list[str]) -> DataFrame:
        rows = targets.join(signatures, ["target_path", "target_line"]).join(docs, ["target_path", "target_line"], "left_outer")
        return rows.groupBy(*by).agg(F.min(row).alias("x")).select(*by, "x.signature", "x.spec", "x.doc")

    # Each name's definitions are looked through once, not once for each place that it stands at.
    answers = said(found, KEY)
    for asked, targets, on in joins:
        answers = answers.unionByName(asked.join(said(targets, on), on).select(*KEY, "signature", "spec", "doc"))
    return answers


def signature_help(w: Workspace, places: DataFrame) -> DataFrame:
    """The signatures of the function called around each place, and which parameter the place is at."""
    at = stored(w.spark, expressions(w.sources, places, w.aliases()).where("callee_function <> ''"))
    named = at.where("callee_module <> ''").select(*KEY, "argument", F.col("callee_module").alias("module"), F.col("callee_function").alias("function"))
    bare = at.where("callee_module = ''").select(*KEY, "argument", F.col("callee_function").alias("function"))
    asked = bare.select(F.col("file_path").alias("seed"), "function").distinct()
    probes = bare.select("file_path", (F.col("line") + 1).alias("line"), "function")
    here = function_module_in_file(w.d, probes).groupBy(F.col("file_path").alias("seed"), "function").agg(F.min("module").alias("module"))
    imports = X.imports(w.texts).select(F.col("file_path").alias("seed"), "imported", "ordinal")
    meaning = injection.bare_function_module(w.d, asked, here, imports, injection.lookup_through_use(w.d, w.offered(), asked))
    meant = bare.join(meaning.withColumnRenamed("seed", "file_path"), ["file_path", "function"]).select(*KEY, "argument", "module", "function")
    signatures = function_rows(w.d).select("module", "function", "arity", "params").distinct()
    return (
        named.unionByName(meant)
        .join(signatures, ["module", "function"])
        .where(F.col("arity") > F.col("argument"))
        .select(*KEY, "module", "function", "arity", "params", "argument", F.get(F.split("params", ","), F.col("argument")).alias("parameter"))
    )


def call_hierarchy_items(w: Workspace, places: DataFrame) -> DataFrame:
    """The function at each place: its first definition."""
    at = resolved(w, places).where("function <> '' AND module <> ''")
    first = function_rows(w.d).groupBy("module", "function").agg(F.min(F.struct(is_type(F.col("kind")).alias("t"), "line", "file_path", "arity")).alias("x"))
    return at.join(first, ["module", "function"]).select(
        *KEY, "module", "function", F.col("x.arity").alias("arity"), F.col("x.file_path").alias("target_path"), F.col("x.line").alias("target_line")
    )


def alias_suggestions(w: Workspace, places: DataFrame, limit: int = 5) -> DataFrame:
    """Modules that an unknown module name at each place may mean, for adding an alias; at most `limit` for each."""
    from codequarry.operators.search import top

    known = module_rows(w.d).select("module").distinct()
    unknown = resolved(w, places).where("module <> ''").join(known, "module", "left_anti")
    asked = unknown.select(*KEY, F.col("module").alias("name"), F.lower(F.substring_index("module", ".", -1)).alias("_s"))
    modules = module_rows(w.d, False).select("module").distinct().withColumn("_s", F.lower(F.substring_index("module", ".", -1)))
    fits = asked.join(modules, "_s").where((F.col("module") == F.col("name")) | F.endswith(F.col("module"), F.concat(F.lit("."), F.col("name"))))
    return top(fits.select(*KEY, "name", "module"), [*KEY, "name"], ["module"], limit)


def completion(w: Workspace, places: DataFrame, limit: int = 100) -> DataFrame:
    """What can be typed at each place: functions and segments of a module after a dot, else modules and aliases for upper
    case, and functions of the file, its imports and use chains for lower case.

    label, kind, detail; `insert_text` is the call with its parameters, after a pipe without the first one; `data` says
    where the definition is (NULL where that is not known), for `completion_resolve`.
    """
    from codequarry.operators.search import first_functions, starting_with, top

    typed = stored(w.spark, _prefixes(w.sources, places, w.aliases()))
    functions = first_functions(w.d).select("module", "function", "arity", "kind", "params", F.col("file_path").alias("_at"), F.col("line").alias("_on"))
    callable_ = [F.concat_ws("/", "function", "arity").alias("label"), "kind", "function", "arity", "params", "_at", "_on"]
    named = [F.lit("module").alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("function", "string"), ("arity", "int"), ("params", "string"), ("_at", "string"), ("_on", "int"))]]
    dotted = typed.where("module <> ''")
    of_module = dotted.join(functions, "module").where(F.startswith("function", "prefix")).select(*KEY, *callable_, F.col("module").alias("detail"))
    names = module_rows(w.d, False).select("module").distinct()
    parents = names.select(F.col("module").alias("_full"), F.regexp_replace("module", r"\.?[^.]+$", "").alias("module"), F.substring_index("module", ".", -1).alias("segment"))
    segments = dotted.join(parents, "module").where(F.startswith(F.lower("segment"), F.lower("prefix"))).select(
        *KEY, F.col("segment").alias("label"), *named, F.col("_full").alias("detail")
    )
    upper = typed.where("module = '' AND prefix RLIKE '^[A-Z]'")
    modules = upper.join(starting_with(names, upper).withColumnRenamed("module", "_full"), "prefix").select(
        *KEY, F.col("_full").alias("label"), *named, F.col("_full").alias("detail")
    )
    # Short names that the text has for modules, its own ones and those that use chains bring.
    short = upper.select(*KEY, "prefix", F.explode("aliases").alias("a")).where(F.startswith(F.lower("a.short"), F.lower("prefix"))).select(
        *KEY, F.col("a.short").alias("label"), *named, F.col("a.full").alias("detail")
    )
    lower = typed.where("module = '' AND prefix RLIKE '^[a-z_]'")
    own = X.buffer_functions(w.texts).select("file_path", "function", "arity", "kind", "params", F.col("file_path").alias("_at"), F.col("line").alias("_on"), F.lit("").alias("detail"))
    brought = injection.completions_from_using(w.d, w.offered()).select(F.col("seed").alias("file_path"), "function", "arity", F.col("provider").alias("module"))
    used = brought.join(functions, ["module", "function", "arity"], "left_outer").select(
        "file_path", "function", "arity", F.coalesce("kind", F.lit("def")).alias("kind"), F.coalesce("params", F.lit("")).alias("params"), "_at", "_on", F.col("module").alias("detail")
    )
    imported = X.imports(w.texts).select("file_path", F.col("imported").alias("module")).distinct().join(functions, "module").select(
        "file_path", "function", "arity", "kind", "params", "_at", "_on", F.col("module").alias("detail")
    )
    bare = lower.join(own.unionByName(used).unionByName(imported), "file_path").where(F.startswith("function", "prefix")).select(*KEY, *callable_, "detail")
    every = of_module.unionByName(segments).unionByName(modules).unionByName(short).unionByName(bare)
    row = F.struct("kind", "detail", "function", "arity", "params", "_at", "_on")
    best = top(every.groupBy(*KEY, "label").agg(F.min(row).alias("x")), KEY, ["label"], limit)
    f, p, a = F.col("x.function"), F.coalesce("x.params", F.lit("")), F.col("x.arity")
    text = F.when(f.isNull(), F.col("label")).when(F.col("piped"), call_text(f, p, a, True)).otherwise(call_text(f, p, a))
    return best.join(typed.select(*KEY, "piped"), KEY).select(
        *KEY, "label", "x.kind", "x.detail", text.alias("insert_text"), F.when(F.col("x._at").isNotNull(), completion_data(F.col("x._at"), F.col("x._on"))).alias("data"), "position"
    )


def completion_resolve(w: Workspace, items: DataFrame, roots: list[str]) -> DataFrame:
    """data, documentation: what a hover would show of the definition that each item (data) names. Items whose file lies
    under none of the `roots`, or that name no line of a text, are left out; '' stands for a root of all relative paths."""
    at = F.from_json("data", "filePath string, line int")
    named = items.where("data IS NOT NULL").select("data", at.alias("x")).distinct().select("data", normal_path(F.col("x.filePath")).alias("file_path"), "x.line")
    under = F.lit(False)
    for root in roots:
        under = under | F.startswith(F.col("file_path"), F.lit(f"{root.rstrip('/')}/" if root else ""))
    named = named.where(under & (F.col("line") >= 1))
    # The lines asked for are at most as many as the text has.
    asked = named.groupBy("file_path").agg(F.collect_set("line").alias("lines"))
    texts = w.sources.where("source_text IS NOT NULL").select(F.col("path").alias("file_path"), "source_text").join(asked, "file_path")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, asked_lines in zip(b["file_path"], b["source_text"], b["lines"], strict=True):
                o = Outline(text)
                heads = o.text.split("\n")
                for line, (doc, spec) in o.docs_above([int(x) for x in asked_lines]).items():
                    if shown := hover_text(signature_line(heads, line), spec, doc):
                        rows.append((path, line, shown))
            yield pd.DataFrame(rows, columns=["file_path", "line", "documentation"])

    shown = texts.mapInPandas(describe, "file_path string, line int, documentation string")
    return named.join(shown, ["file_path", "line"]).select("data", "documentation")


def _prefixes(sources: DataFrame, places: DataFrame, injected: DataFrame) -> DataFrame:
    """file_path, line, col, module (before the last dot, aliases resolved), prefix, whether it comes after a pipe, and the
    aliases that the place sees (short, full), its own ones before injected ones."""
    rows = texts_with_places(sources, places).join(injected, "file_path", "left_outer")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, found, brought in zip(b["file_path"], b["source_text"], b["places"], b["injected"], strict=True):
                text = text.replace("\r\n", "\n")
                o, lines = Outline(text), text.split("\n")
                lent = {} if brought is None else {x["short"]: x["full"] for x in brought}
                for p in found:
                    if not 0 <= p["line"] < len(lines):
                        continue
                    typed, dot, start = C.completion_prefix(lines[p["line"]], p["col"])
                    head, _, last = (typed, "", "") if dot else typed.rpartition(".")
                    own = o.module_at(p["line"] + 1)
                    group = C.alias_group_parent(o.t, p["line"], p["col"])
                    aliases = lent | o.alias_map(p["line"] + 1)
                    module = resolve_alias(head, aliases, own) if head else group
                    rows.append(
                        (path, p["line"], p["col"], module, last if head or not dot else "", C.after_pipe(lines[p["line"]], start),
                         [{"short": k, "full": v} for k, v in aliases.items()])
                    )
            yield pd.DataFrame(rows, columns=[*KEY, "module", "prefix", "piped", "aliases"])

    schema = "file_path string, line int, col int, module string, prefix string, piped boolean, aliases array<struct<short:string,full:string>>"
    return rows.mapInPandas(run, schema)


def delegates_resolved(w: Workspace, places: DataFrame) -> DataFrame:
    """The function at each place and where its delegation ends."""
    at = resolved(w, places).where("function <> '' AND module <> ''")
    return at.join(follow_delegates(w.d, at), ["module", "function"]).select(*KEY, "module", "function", "target_module", "target_function", "n_hops")
