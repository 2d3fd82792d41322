"""Queries of the relational operators over the project tables, and their SQL.

Every query answers for all keys of the tables at once. `D` below is the current definitions with the shared
library, `R` the references, both cleaned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry import tables as T
from codequarry.functions import names as N
from codequarry.operators import asof, graph, links, lookup, search
from codequarry.plans.data_queries import sql_module, sql_strip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = T.definitions(spark, sf_dir).drop("def_id").unionByName(T.stdlib(spark, sf_dir))
    return d, T.refs(spark, sf_dir)


_D = ", ".join(
    [
        f"{sql_module('module')} AS module",
        f"{sql_strip('function')} AS function",
        "coalesce(arity, 0) AS arity",
        "coalesce(kind, '') AS kind",
        "line",
        "coalesce(file_path, '') AS file_path",
        f"{sql_module('delegate_to')} AS delegate_to",
        f"{sql_strip('delegate_as')} AS delegate_as",
        "coalesce(params, '') AS params",
    ]
)
PREFIX = f"""
WITH RECURSIVE D AS (SELECT * EXCLUDE (def_id) FROM (SELECT DISTINCT def_id, {_D} FROM definitions WHERE removed_at IS NULL)
    UNION ALL SELECT {_D} FROM stdlib_definitions),
R AS (SELECT DISTINCT ref_id, {sql_module('module')} AS module, {sql_strip('function')} AS function, line,
    coalesce(file_path, '') AS file_path, coalesce(kind, '') AS kind FROM refs),
MODS AS (SELECT * FROM D WHERE function = '' AND kind IN ('module', 'defprotocol', 'defimpl')),
MODS2 AS (SELECT * FROM MODS WHERE kind <> 'defimpl'),
FNS AS (SELECT *, CASE WHEN kind IN ('type', 'opaque') THEN 1 ELSE 0 END AS t FROM D
    WHERE kind NOT IN ('module', 'defprotocol', 'defimpl', 'callback', 'macrocallback')),
CBS AS (SELECT * FROM D WHERE kind IN ('callback', 'macrocallback')),
NS AS (SELECT DISTINCT regexp_extract(module, '^[^.]+\\.[^.]+') AS p FROM MODS WHERE module LIKE '%.%')
"""


def query(name: str, sql: str | None = None):
    """Register a query of (D, R) with what follows the common prefix of its SQL."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(*facts(spark, sf_dir))
        if sql is not None:
            SQL[name] = PREFIX + sql
        return f

    return add


def namespaces(d: DataFrame) -> DataFrame:
    """The first two segments of the modules' names: the prefixes that the prefix queries ask for."""
    return (
        lookup.module_rows(d)
        .where(F.contains("module", F.lit(".")))
        .select(F.regexp_extract("module", r"^[^.]+\.[^.]+", 0).alias("prefix"))
        .distinct()
    )


# ---------------------------------------------------------------- lookups


@query("lookup_module", ", K AS (SELECT DISTINCT module FROM R) SELECT module, file_path, line, kind, arity, delegate_to, delegate_as FROM MODS JOIN K USING (module)")
def _(d, r):
    return lookup.lookup_module(d, r)


@query("modules_in_file", "SELECT file_path, line, module FROM MODS2")
def _(d, r):
    return lookup.modules_in_file(d)


@query(
    "lookup_function",
    """, K AS (SELECT DISTINCT module, function FROM R)
SELECT module, function, t AS type_rank, file_path, line, kind, arity, delegate_to, delegate_as, params FROM FNS JOIN K USING (module, function)""",
)
def _(d, r):
    return lookup.lookup_function(d, r)


@query(
    "function_in_file",
    """, P AS (SELECT DISTINCT file_path, line, function FROM R WHERE kind = 'call' AND function <> ''),
E AS (SELECT P.*, (SELECT max(m.module) FROM MODS2 m WHERE m.file_path = P.file_path
    AND m.line = (SELECT max(x.line) FROM MODS2 x WHERE x.file_path = P.file_path AND x.line <= P.line)) AS em FROM P),
C AS (SELECT file_path, line, function, CASE WHEN EXISTS (SELECT 1 FROM FNS f WHERE f.module = em AND f.function = E.function) THEN em
    ELSE (SELECT arg_min(f.module, (f.line, f.module)) FROM FNS f WHERE f.file_path = E.file_path AND f.function = E.function) END AS module FROM E)
SELECT * FROM C WHERE module IS NOT NULL""",
)
def _(d, r):
    return links.function_module_in_file(d, r.where("kind = 'call' AND function <> ''"))


@query(
    "functions_in_modules",
    """, I AS (SELECT DISTINCT file_path AS scope, module FROM R WHERE kind = 'import'),
C AS (SELECT DISTINCT file_path AS scope, function FROM R WHERE kind = 'call' AND function <> '')
SELECT DISTINCT scope, module, function, f.arity, f.kind, f.line, f.file_path FROM I JOIN FNS f USING (module) JOIN C USING (scope, function)""",
)
def _(d, r):
    imports = r.where("kind = 'import'").select(F.col("file_path").alias("scope"), "module")
    called = r.where("kind = 'call' AND function <> ''").select(F.col("file_path").alias("scope"), "function", F.lit(-1).alias("arity"))
    return lookup.functions_in_modules(d, imports, called)


@query("callback_def", ", K AS (SELECT DISTINCT module, function FROM D) SELECT module, function, arity, kind, line, file_path FROM CBS JOIN K USING (module, function)")
def _(d, r):
    return lookup.callback_definitions(d, d)


@query(
    "callback_def_global",
    """, K AS (SELECT DISTINCT function, arity AS asked_arity FROM CBS UNION SELECT DISTINCT function, -1 FROM CBS)
SELECT function, asked_arity, module, arity, kind, line, file_path FROM CBS JOIN K USING (function) WHERE asked_arity < 0 OR asked_arity = arity""",
)
def _(d, r):
    keys = lookup.callback_rows(d).select("function", "arity")
    return lookup.callback_definitions_anywhere(d, keys.union(keys.select("function", F.lit(-1))))


@query("references", ", K AS (SELECT DISTINCT module, function FROM D) SELECT module, function, file_path, line, kind FROM R JOIN K USING (module, function)")
def _(d, r):
    return lookup.references(r, d)


@query("references_by_prefix", "SELECT p AS prefix, module, function, file_path, line, kind FROM NS JOIN R ON module = p OR module ILIKE p || '.%'")
def _(d, r):
    return lookup.references_by_prefix(r, namespaces(d))


@query("modules_by_prefix", "SELECT p AS prefix, module, file_path, line, kind FROM NS JOIN MODS ON module = p OR module ILIKE p || '.%'")
def _(d, r):
    return lookup.modules_by_prefix(d, namespaces(d))


@query("submodules", "SELECT DISTINCT p AS prefix, module FROM NS JOIN D ON module ILIKE p || '.%' AND function = ''")
def _(d, r):
    return lookup.submodules(d, namespaces(d))


@query("using_modules", "SELECT DISTINCT module, file_path FROM D WHERE function = '__using__'")
def _(d, r):
    return lookup.using_modules(d)


@query(
    "refs_in_range",
    """, L AS (SELECT DISTINCT file_path, line FROM D WHERE function <> ''),
G AS (SELECT file_path, line AS first_line, coalesce(lead(line) OVER (PARTITION BY file_path ORDER BY line) - 1, line + 499) AS last_line FROM L)
SELECT G.file_path, first_line, module, function, line FROM G JOIN R ON R.file_path = G.file_path AND line BETWEEN first_line AND last_line
WHERE kind = 'call' AND function <> ''""",
)
def _(d, r):
    return lookup.calls_in_ranges(r, asof.function_ranges(d))


@query(
    "delegates_to",
    """, K AS (SELECT DISTINCT module, function FROM D),
X AS (SELECT delegate_to AS module, CASE WHEN delegate_as = '' THEN function ELSE delegate_as END AS function, module AS facade,
    function AS facade_function, arity, file_path, line FROM D WHERE kind = 'defdelegate')
SELECT * FROM X WHERE EXISTS (SELECT 1 FROM K WHERE K.module = X.module AND K.function = X.function)""",
)
def _(d, r):
    return lookup.delegates_to(d, d)


# ---------------------------------------------------------------- searches


@query(
    "search_modules",
    """, M AS (SELECT DISTINCT module FROM MODS2), P AS (SELECT DISTINCT substring(module, 1, 3) AS prefix FROM M WHERE length(module) >= 3),
X AS (SELECT prefix, module, row_number() OVER (PARTITION BY prefix ORDER BY module) AS position FROM P JOIN M ON module ILIKE prefix || '%')
SELECT prefix, module, CAST(position AS INT) AS position FROM X WHERE position <= 100""",
)
def _(d, r):
    prefixes = lookup.module_rows(d, False).where(F.length("module") >= 3).select(F.substring("module", 1, 3).alias("prefix"))
    return search.search_modules(d, prefixes)


@query(
    "search_modules_suffix",
    """, M AS (SELECT DISTINCT module FROM MODS2),
S AS (SELECT DISTINCT regexp_extract(module, e) AS segment FROM M, (VALUES ('[^.]+$'), ('[^.]+\\.[^.]+$'), ('[^.]+\\.[^.]+\\.[^.]+$')) AS v(e)),
X AS (SELECT segment, module, row_number() OVER (PARTITION BY segment ORDER BY module) AS position FROM S JOIN M
    ON segment <> '' AND (module = segment OR module ILIKE '%.' || segment))
SELECT segment, module, CAST(position AS INT) AS position FROM X WHERE position <= 20""",
)
def _(d, r):
    ends = F.array(*[F.substring_index("module", ".", -n) for n in (1, 2, 3)])
    return search.search_modules_by_suffix(d, lookup.module_rows(d, False).select(F.explode(ends).alias("segment")))


@query(
    "submodule_segments",
    """, M AS (SELECT DISTINCT module FROM MODS2), P AS (SELECT DISTINCT split_part(module, '.', 1) AS parent FROM M UNION SELECT p FROM NS),
X AS (SELECT parent, split_part(substring(module, length(parent) + 2), '.', 1) AS segment, min(module) AS first_module FROM P JOIN M ON module ILIKE parent || '.%' GROUP BY ALL),
Y AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY first_module, segment) AS position FROM X)
SELECT parent, segment, first_module, CAST(position AS INT) AS position FROM Y WHERE position <= 100""",
)
def _(d, r):
    tops = lookup.module_rows(d, False).select(F.substring_index("module", ".", 1).alias("parent"))
    return search.submodule_segments(d, tops.union(namespaces(d)))


_FUNCTIONS = """, X AS (SELECT module, function, arity, min((line, file_path, kind, params)) AS x FROM D
    WHERE function <> '' AND kind NOT IN ('callback', 'macrocallback'){0} GROUP BY ALL),
Y AS (SELECT module, function, arity, x[1] AS line, x[2] AS file_path, x[3] AS kind, x[4] AS params,
    row_number() OVER (PARTITION BY module ORDER BY function, arity) AS position FROM X)
SELECT * REPLACE (CAST(position AS INT) AS position) FROM Y WHERE position <= 100"""


@query("module_functions_public", _FUNCTIONS.format(" AND kind IN ('def', 'defmacro', 'defguard', 'defdelegate', 'type', 'opaque')"))
def _(d, r):
    return search.module_functions(d, True)


@query("module_functions_all", _FUNCTIONS.format(""))
def _(d, r):
    return search.module_functions(d, False)


_SYMBOLS = """SELECT CASE WHEN module = '{q}' THEN 0 WHEN {same} THEN 1 ELSE 2 END AS rank, module, function, arity, kind, line, file_path
FROM D WHERE ({hit}){more} ORDER BY rank, module, function, file_path, line, arity, kind LIMIT 50"""
_PLAIN = {"same": "instr(module, '{q}') > 0 OR instr(function, '{q}') > 0", "hit": "module ILIKE '%{q}%' OR function ILIKE '%{q}%'"}


def _symbols(q: str, more: str = "") -> str:
    return _SYMBOLS.format(q=q, more=more, **{k: v.format(q=q) for k, v in _PLAIN.items()})


@query("search_symbols", _symbols("Cache"))
def _(d, r):
    return search.search_symbols(d, "Cache")


@query(
    "search_symbols_dotted",
    _SYMBOLS.format(
        q="Lumen.Seq.all",
        same="instr(module || '.' || function, 'Lumen.Seq.all') > 0",
        hit="module ILIKE '%Lumen.Seq%' AND (function ILIKE '%all%' OR module ILIKE '%all%')",
        more="",
    ),
)
def _(d, r):
    return search.search_symbols(d, "Lumen.Seq.all")


@query("search_symbols_excluding", _symbols("sync", " AND NOT file_path ILIKE 'stdlib/%'"))
def _(d, r):
    return search.search_symbols(d, "sync", "stdlib/")


@query(
    "completion_labels",
    """, A AS (SELECT regexp_extract(module, '[^.]*$') AS label, module, 0 AS rank, 'alias' AS origin FROM R WHERE kind = 'alias'
    UNION SELECT regexp_extract(module, '[^.]*$'), module, 1, 'segment' FROM MODS2 UNION SELECT module, module, 2, 'module' FROM MODS2)
SELECT label, x[1] AS rank, x[2] AS module, x[3] AS origin FROM (SELECT label, min((rank, module, origin)) AS x FROM A GROUP BY label)""",
)
def _(d, r):
    last = N.last_segment(F.col("module")).alias("label")
    mods = lookup.module_rows(d, False)
    return search.completion_labels(
        [
            (r.where("kind = 'alias'").select(last, "module"), "alias"),
            (mods.select(last, "module"), "segment"),
            (mods.select(F.col("module").alias("label"), "module"), "module"),
        ]
    )


# ---------------------------------------------------------------- nearest rows

_AT = """(SELECT max(m.module) FROM MODS2 m WHERE m.file_path = {0}.file_path AND m.line =
    (SELECT max(x.line) FROM MODS2 x WHERE x.file_path = {0}.file_path AND x.line <= {0}.line))"""
# Anchors of functions: the greatest of a line, and the rows that stand before each reference.
_CALLERS = """, A AS (SELECT file_path, line, max((arity, module, function, kind)) AS a FROM D WHERE function <> '' GROUP BY file_path, line),
INN AS (SELECT c.*, A.a[2] AS caller_module, A.a[3] AS caller_function, A.a[1] AS caller_arity, A.line AS caller_line
    FROM (SELECT DISTINCT module, function, file_path, line FROM R WHERE kind = 'call' AND function <> '') c
    ASOF JOIN A ON c.file_path = A.file_path AND c.line >= A.line)"""


@query(
    "enclosing_module",
    """, A AS (SELECT file_path, line, max(module) AS m FROM MODS2 GROUP BY ALL)
SELECT R.ref_id, coalesce(A.m, '') AS enclosing_module FROM R ASOF LEFT JOIN A ON R.file_path = A.file_path AND R.line >= A.line""",
)
def _(d, r):
    return asof.enclosing_module(r.select("ref_id", "file_path", "line"), d).select("ref_id", "enclosing_module")


@query(
    "enclosing_function",
    """, A AS (SELECT file_path, line, max((arity, module, function, kind)) AS a FROM D WHERE function <> '' GROUP BY file_path, line)
SELECT R.ref_id, A.a[2] AS caller_module, A.a[3] AS caller_function, A.a[1] AS caller_arity, A.line AS caller_line
FROM R ASOF JOIN A ON R.file_path = A.file_path AND R.line >= A.line""",
)
def _(d, r):
    return asof.enclosing_function(r.select("ref_id", "file_path", "line"), d).drop("file_path", "line")


@query(
    "next_function_line",
    ", L AS (SELECT DISTINCT file_path, line FROM D WHERE function <> '') SELECT file_path, line, coalesce(lead(line) OVER (PARTITION BY file_path ORDER BY line), 0) AS next_line FROM L",
)
def _(d, r):
    return asof.next_function_line(d)


@query(
    "function_ranges",
    ", L AS (SELECT DISTINCT file_path, line FROM D WHERE function <> '') SELECT file_path, line AS first_line, coalesce(lead(line) OVER (PARTITION BY file_path ORDER BY line) - 1, line + 499) AS last_line FROM L",
)
def _(d, r):
    return asof.function_ranges(d)


@query(
    "nested_module_resolution",
    """, A AS (SELECT file_path, line, max(module) AS m FROM MODS2 GROUP BY ALL),
Q AS (SELECT DISTINCT A.m AS enclosing, regexp_extract(R.module, '[^.]*$') AS name FROM R ASOF JOIN A ON R.file_path = A.file_path AND R.line >= A.line WHERE R.kind = 'alias'),
C AS (SELECT enclosing, name, unnest(range(1, len(string_split(enclosing, '.')) + 1)) AS depth FROM Q WHERE enclosing <> '' AND name <> ''),
X AS (SELECT enclosing, name, depth, array_to_string(string_split(enclosing, '.')[1:depth], '.') || '.' || name AS c FROM C)
SELECT enclosing, name, arg_max(c, depth) AS module FROM X WHERE c IN (SELECT module FROM MODS) GROUP BY enclosing, name""",
)
def _(d, r):
    aliases = r.where("kind = 'alias'").select("file_path", "line", N.last_segment(F.col("module")).alias("name")).distinct()
    placed = asof.enclosing_module(aliases, d).select(F.col("enclosing_module").alias("enclosing"), "name")
    return asof.resolve_nested(placed, d)


_IMPLEMENTORS = f""", IMP AS (SELECT DISTINCT R.module AS behaviour, {_AT.format('R')} AS module, R.file_path FROM R WHERE kind IN ('behaviour', 'use'))"""
_BEHAVIOURS = """, BF AS (SELECT file_path, module AS behaviour FROM R WHERE kind = 'behaviour'
    UNION SELECT file_path, module FROM R WHERE kind = 'use' AND EXISTS (SELECT 1 FROM CBS WHERE CBS.module = R.module))"""


@query("behaviour_implementors", _IMPLEMENTORS + " SELECT * FROM IMP WHERE module IS NOT NULL")
def _(d, r):
    return asof.behaviour_implementors(d, r)


# ---------------------------------------------------------------- joins


@query("behaviours_for_file", _BEHAVIOURS + " SELECT * FROM BF")
def _(d, r):
    return links.behaviours_for_file(d, r)


@query(
    "implementations",
    _IMPLEMENTORS
    + """, CB AS (SELECT module AS behaviour, function, arg_min(arity, (line, arity)) AS arity FROM CBS GROUP BY ALL),
CAND AS (SELECT behaviour, module FROM IMP WHERE module IS NOT NULL UNION SELECT behaviour, behaviour FROM CB)
SELECT DISTINCT behaviour, f.module, f.function, f.arity, f.file_path, f.line FROM CB JOIN CAND USING (behaviour)
JOIN FNS f ON f.module = CAND.module AND f.function = CB.function AND f.arity = CB.arity""",
)
def _(d, r):
    return links.implementations(d, r)


@query(
    "declarations",
    _BEHAVIOURS
    + """, F AS (SELECT DISTINCT module, function, arity, file_path FROM FNS WHERE function <> ''),
C AS (SELECT F.*, module AS behaviour FROM F UNION SELECT F.*, behaviour FROM F JOIN BF USING (file_path))
SELECT DISTINCT C.module, C.function, C.arity, behaviour, CBS.file_path AS callback_file, CBS.line AS callback_line
FROM C JOIN CBS ON CBS.module = behaviour AND CBS.function = C.function AND CBS.arity = C.arity""",
)
def _(d, r):
    return links.declarations(d, r)


@query("incoming_calls", _CALLERS + " SELECT * FROM INN")
def _(d, r):
    return links.incoming_calls(d, r)


# A function's lines go up to the line before the next function of its file, those of the last one for 500 lines.
_INSIDE = """, A AS (SELECT file_path, line, max((arity, module, function, kind)) AS a, lead(line) OVER (PARTITION BY file_path ORDER BY line) AS next_line
    FROM D WHERE function <> '' GROUP BY file_path, line),
INN AS (SELECT c.*, A.a[2] AS caller_module, A.a[3] AS caller_function, A.line AS caller_line
    FROM (SELECT module, function, file_path, line FROM R WHERE kind = 'call' AND function <> '') c
    JOIN A ON c.file_path = A.file_path AND c.line BETWEEN A.line AND coalesce(A.next_line - 1, A.line + 499)),
T AS (SELECT module, function, min((t, line, file_path)) AS x FROM FNS GROUP BY ALL)"""


@query(
    "outgoing_calls",
    _INSIDE
    + """, E AS (SELECT file_path, caller_line, caller_module, caller_function, module, function, COUNT(*) AS n_calls, min(line) AS first_call, max(line) AS last_call
    FROM INN GROUP BY ALL)
SELECT E.*, x[3] AS target_file, x[2] AS target_line FROM E JOIN T USING (module, function)""",
)
def _(d, r):
    return links.outgoing_calls(d, r)


@query("outgoing_call_sites", _INSIDE + " SELECT DISTINCT file_path, caller_line, caller_module, caller_function, module, function, line FROM INN JOIN T USING (module, function)")
def _(d, r):
    return links.outgoing_call_sites(d, r)


@query("call_edges", _CALLERS + " SELECT caller_module, caller_function, module, function, COUNT(*) AS n_lines FROM INN GROUP BY ALL")
def _(d, r):
    return links.call_edges(d, r)


@query(
    "reverse_delegate_refs",
    """, X AS (SELECT DISTINCT delegate_to AS target_module, CASE WHEN delegate_as = '' THEN function ELSE delegate_as END AS target_function, module, function
    FROM D WHERE kind = 'defdelegate' AND delegate_to <> '')
SELECT target_module, target_function, module, function, file_path, line, kind FROM X JOIN R USING (module, function)""",
)
def _(d, r):
    return links.reverse_delegate_references(d, r)


@query(
    "injected_refs",
    """, U AS (SELECT DISTINCT module AS injector FROM R WHERE kind = 'use'),
I AS (SELECT DISTINCT f.module, f.function, injector FROM FNS f JOIN U ON f.module = injector WHERE f.kind = 'defmacro')
SELECT I.module, R.function, injector, file_path, line, kind FROM I JOIN R ON R.module = injector AND R.function = I.function""",
)
def _(d, r):
    used = r.where("kind = 'use'").select("module").distinct()
    macros = lookup.function_rows(d).where("kind = 'defmacro'").join(used, "module", "left_semi")
    return links.injected_references(r, macros.select("module", "function", F.col("module").alias("injector")))


_RENAMES = ", RN AS (SELECT p, p || 'Next' AS q FROM NS)"


@query(
    "rename_sites",
    _RENAMES
    + """, S AS (SELECT p, q, module, file_path, line, 'definition' AS origin FROM RN JOIN MODS ON module = p OR module ILIKE p || '.%'
    UNION SELECT p, q, module, file_path, line, 'reference' FROM RN JOIN R ON module = p OR module ILIKE p || '.%')
SELECT module AS old_module, q || substring(module, length(p) + 1) AS new_module, file_path, line, min(origin) AS origin FROM S GROUP BY p, q, module, file_path, line""",
)
def _(d, r):
    return links.rename_sites(d, r, renames(d))


def renames(d: DataFrame) -> DataFrame:
    """A rename of every namespace: `A.B` to `A.BNext`."""
    return namespaces(d).select(F.col("prefix").alias("old_prefix"), F.concat("prefix", F.lit("Next")).alias("new_prefix"))


@query("rename_map", _RENAMES + " SELECT DISTINCT module AS old_module, q || substring(module, length(p) + 1) AS new_module FROM RN JOIN MODS ON module = p OR module ILIKE p || '.%'")
def _(d, r):
    return links.rename_map(d, renames(d))


@query(
    "rename_collisions",
    """, N AS (SELECT DISTINCT module, min(module) OVER (PARTITION BY regexp_extract(module, '[^.]*$')) AS q FROM MODS),
RN AS (SELECT module AS p, q FROM N WHERE q <> module),
MAP AS (SELECT DISTINCT module AS old_module, q || substring(module, length(p) + 1) AS new_module FROM RN JOIN MODS ON module = p OR module ILIKE p || '.%'),
MF AS (SELECT DISTINCT module, file_path FROM MODS), MOVED AS (SELECT DISTINCT file_path FROM MF WHERE module IN (SELECT old_module FROM MAP))
SELECT DISTINCT old_module, new_module, file_path FROM MAP JOIN MF ON MF.module = new_module WHERE file_path NOT IN (SELECT file_path FROM MOVED)""",
)
def _(d, r):
    # Every module gets the name of the first one with the same last segment.
    names = lookup.module_rows(d).select("module", N.last_segment(F.col("module")).alias("last")).distinct()
    first = names.groupBy("last").agg(F.min("module").alias("new_prefix"))
    wanted = names.join(first, "last").where("module <> new_prefix").select(F.col("module").alias("old_prefix"), "new_prefix")
    return links.rename_collisions(d, wanted)


@query("reference_dedup", "SELECT DISTINCT module, function, file_path, line FROM R WHERE NOT starts_with(file_path, 'stdlib/')")
def _(d, r):
    return links.dedup_locations(r, ["module", "function"], "stdlib/")


@query(
    "prefer_functions_over_types",
    """SELECT module, function, arity, kind, file_path, line FROM FNS a WHERE function <> '' AND (t = 0 OR NOT EXISTS
    (SELECT 1 FROM FNS b WHERE b.module = a.module AND b.function = a.function AND b.t = 0))""",
)
def _(d, r):
    return links.functions_over_types(d)


@query("index_stats", "SELECT (SELECT COUNT(DISTINCT file_path) FROM D) AS n_files, (SELECT COUNT(*) FROM D) AS n_definitions, (SELECT COUNT(*) FROM R) AS n_references")
def _(d, r):
    return links.index_totals(d, r)


@query("sites_by_file", "SELECT file_path, COUNT(*) AS n_sites, min(line) AS first_line, max(line) AS last_line FROM R GROUP BY file_path")
def _(d, r):
    return links.sites_by_file(r)


# ---------------------------------------------------------------- walks

_HOPS = """, H AS (SELECT module, function, bool_and(kind = 'defdelegate' AND delegate_to <> '') AS ad, min((t, line, file_path, arity, delegate_to, delegate_as)) AS x
    FROM FNS WHERE function <> '' GROUP BY ALL),
E AS (SELECT module, function, x[5] AS nm, CASE WHEN x[6] = '' THEN function ELSE x[6] END AS nf FROM H WHERE ad),
E2 AS (SELECT E.* FROM E JOIN H ON H.module = nm AND H.function = nf),
W AS (SELECT module, function, module AS target_module, function AS target_function, 0 AS n_hops FROM H
    UNION ALL SELECT W.module, W.function, nm, nf, n_hops + 1 FROM W JOIN E2 ON E2.module = target_module AND E2.function = target_function WHERE n_hops < 5),
FD AS (SELECT module, function, arg_max(target_module, n_hops) AS target_module, arg_max(target_function, n_hops) AS target_function, max(n_hops) AS n_hops FROM W GROUP BY ALL)"""


@query("follow_delegate", _HOPS + " SELECT * FROM FD")
def _(d, r):
    return graph.follow_delegates(d)


@query(
    "cli_lookup",
    _HOPS
    + """, K AS (SELECT DISTINCT module, function FROM R WHERE function <> ''),
HIT AS (SELECT DISTINCT K.module, K.function, f.file_path || ':' || f.line AS location FROM K JOIN FD USING (module, function)
    JOIN FNS f ON f.module = target_module AND f.function = target_function),
FB AS (SELECT DISTINCT K.module, K.function, m.file_path || ':' || m.line AS location FROM K JOIN MODS m USING (module)
    WHERE NOT EXISTS (SELECT 1 FROM HIT WHERE HIT.module = K.module AND HIT.function = K.function))
SELECT * FROM HIT UNION ALL SELECT * FROM FB""",
)
def _(d, r):
    from codequarry.operators.composite import lookup_locations

    return lookup_locations(d, r.where("function <> ''").select("module", "function"))


def _injectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r = facts(spark, sf_dir)
    seeds = lookup.function_rows(d).where("kind = 'defmacro'").select(F.col("module").alias("seed")).distinct()
    return graph.reachable(spark, graph.use_edges(d, r), seeds)


QUERIES["injector_closure"] = _injectors
SQL["injector_closure"] = (
    PREFIX
    + f""", UE AS (SELECT DISTINCT {_AT.format('R')} AS module, R.module AS used FROM R WHERE kind = 'use'),
E AS (SELECT * FROM UE WHERE module IS NOT NULL AND module <> used),
S AS (SELECT DISTINCT module FROM FNS WHERE kind = 'defmacro'),
W AS (SELECT module AS seed, module AS node, 0 AS depth FROM S UNION SELECT seed, E.module, depth + 1 FROM W JOIN E ON E.used = W.node WHERE depth < 30)
SELECT seed, node, min(depth) AS depth FROM W GROUP BY seed, node"""
)

# ---------------------------------------------------------------- change detection on the reported files


def latest_reports(spark: SparkSession, sf_dir: str, first_run: bool) -> DataFrame:
    """The state of each path by all reports, or by those that the first effective run saw."""
    f = T.read(spark, sf_dir, "files")
    if first_run:
        since = T.read(spark, sf_dir, "index_runs").where("status = 'ok'").agg(F.min("started_at")).first()[0]
        f = f.where(F.col("loaded_at") <= F.lit(since).cast("timestamp_ntz"))
    state = F.max(F.struct("walked_at", "mtime")).alias("s")
    return f.groupBy(T.clean_path(F.col("path")).alias("path")).agg(state).select("path", F.col("s.mtime").alias("mtime"))


_PATH_SQL = r"regexp_replace(regexp_replace(path, '(^|/)(\.?/)+', '\1', 'g'), '(^|/)\.?$', '')"
_SNAPS = "WITH " + ", ".join(
    f"{n} AS (SELECT {_PATH_SQL} AS path, nullif(arg_max(coalesce(mtime, -1), walked_at), -1) AS mtime FROM files{t} GROUP BY 1)"
    for n, t in (("a", " WHERE loaded_at <= (SELECT min(started_at) FROM index_runs WHERE status = 'ok')"), ("b", ""))
)


def _changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codequarry.sources.ingest import changed_files

    return changed_files(latest_reports(spark, sf_dir, True).where("mtime IS NOT NULL"), latest_reports(spark, sf_dir, False).where("mtime IS NOT NULL"))


def _deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = latest_reports(spark, sf_dir, True).where("mtime IS NOT NULL")
    return links.missing_paths(stored, latest_reports(spark, sf_dir, False).where("mtime IS NOT NULL"))


QUERIES |= {"changed_files": _changed_files, "deleted_files": _deleted_files}
SQL |= {
    "changed_files": f"{_SNAPS} SELECT b.path, b.mtime FROM b LEFT JOIN a ON a.path = b.path AND a.mtime IS NOT NULL WHERE b.mtime IS NOT NULL AND (a.path IS NULL OR a.mtime <> b.mtime)",
    "deleted_files": f"{_SNAPS} SELECT a.path FROM a WHERE a.mtime IS NOT NULL AND a.path NOT IN (SELECT path FROM b WHERE mtime IS NOT NULL)",
}

# ---------------------------------------------------------------- functions

_SNAKE = r"lower(regexp_replace(regexp_replace({0}, '([^A-Z])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][^A-Z])', '\1_\2', 'g'))"
_LAST = "regexp_extract(module, '[^.]*$')"


@query("camel_to_snake", f"SELECT DISTINCT module, {_SNAKE.format(_LAST)} AS snake FROM MODS")
def _(d, r):
    return lookup.module_rows(d).select("module", N.camel_to_snake(N.last_segment(F.col("module"))).alias("snake")).distinct()


@query(
    "valid_names",
    r"""SELECT DISTINCT module, function, regexp_matches(module, '^[A-Z][A-Za-z0-9_]*(\.[A-Z][A-Za-z0-9_]*)*$') AS module_ok,
regexp_matches(function, '^[a-z_][a-z0-9_?!]*$') AS function_ok FROM R""",
)
def _(d, r):
    return r.select(
        "module", "function", N.is_module_name(F.col("module")).alias("module_ok"), N.is_function_name(F.col("function")).alias("function_ok")
    ).distinct()


@query(
    "call_text",
    """, X AS (SELECT DISTINCT module, function, arity, params FROM FNS WHERE function <> '' AND arity >= 0),
P AS (SELECT *, list_filter(string_split(params, ','), lambda p: p <> '') AS ps FROM X),
Q AS (SELECT *, list_transform(range(1, arity + 1), lambda i: coalesce(ps[i], 'arg' || i)) AS a FROM P)
SELECT module, function, arity, params, function || '/' || arity AS label, function || '(' || array_to_string(a, ', ') || ')' AS call,
function || '(' || array_to_string(a[2:], ', ') || ')' AS piped FROM Q""",
)
def _(d, r):
    rows = lookup.function_rows(d).where("function <> '' AND arity >= 0").select("module", "function", "arity", "params").distinct()
    f, p, a = F.col("function"), F.col("params"), F.col("arity")
    return rows.select("*", N.label(f, a).alias("label"), N.call_text(f, p, a).alias("call"), N.call_text(f, p, a, True).alias("piped"))


@query("kind_labels", "SELECT kind, CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in N.COMPLETION_LABELS.items()) + " ELSE 'text' END AS label, COUNT(*) AS n FROM D GROUP BY ALL")
def _(d, r):
    return d.groupBy("kind", N.completion_label(F.col("kind")).alias("label")).agg(F.count("*").alias("n"))


@query(
    "path_convention",
    f"""SELECT DISTINCT module, file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.exs?$', '') = {_SNAKE.format(_LAST)} AS follows,
CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') || '/' ELSE '' END || {_SNAKE.format(_LAST)} || regexp_extract(file_path, '\\.exs?$') AS path FROM MODS""",
)
def _(d, r):
    m, f = F.col("module"), F.col("file_path")
    return (
        lookup.module_rows(d)
        .select("module", "file_path", N.follows_convention(m, f).alias("follows"), N.conventional_path(m, f).alias("path"))
        .distinct()
    )
