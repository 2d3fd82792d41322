"""SQL over the lines of source texts: what line patterns say, beside what lexing and parsing find.

The texts of `sources` are written regularly: a `do` ends its line, an `end` starts one, heads and attributes start lines,
heads hold no parentheses within their own, and a statement goes on over lines only within brackets. Under these rules
blocks, brackets and literals can be paired by running sums over lines.
"""

from __future__ import annotations

from codequarry.plans.core_queries import _D, PREFIX
from codequarry.plans.core_queries import _HOPS as HOPS
from codequarry.plans.data_queries import sql_module, sql_strip

# Kinds of definitions as their lines begin.
_KIND = r"""CASE WHEN w IN ('def', 'defp', 'defmacro', 'defmacrop', 'defguard', 'defguardp', 'defdelegate', 'defprotocol', 'defimpl', 'defstruct', 'defexception') THEN w
    WHEN w = 'defmodule' THEN 'module' WHEN w IN ('@type', '@opaque', '@callback', '@macrocallback') THEN w[2:] END"""
_FUNCTIONS = "('def', 'defp', 'defmacro', 'defmacrop', 'defguard', 'defguardp', 'defdelegate')"

TEXTS = r"""
WITH S AS (SELECT path, arg_max(source_text, (read_at, source_text)) AS t FROM sources WHERE path IS NOT NULL AND source_text IS NOT NULL GROUP BY path),
L AS (SELECT path, string_split(replace(ltrim(t, chr(65279)), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM S)
"""

# LN: every line with its number, its text, and its code: without what lies in literals and comments. Q counts the lines with
# triple quotes before it: an odd number says that the line lies within a literal.
LINES = (
    TEXTS
    + r""",
L0 AS (SELECT path, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS t FROM L),
L1 AS (SELECT *, regexp_matches(t, '""\"|''{3}') AS quote, coalesce(sum(CAST(regexp_matches(t, '""\"|''{3}') AS INT)) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q FROM L0),
LN AS (SELECT path, n, t, quote, q, len(t) - len(ltrim(t, ' ')) AS w0, CASE WHEN q % 2 = 1 THEN '' ELSE
    rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(""\"|''{3}).*$', ''), '~[a-zA-Z](\|[^|]*\||\([^)]*\))', '', 'g'), '"(\\.|[^"\\])*"', '', 'g'), '#.*$', '')) END AS code FROM L1),
-- Blocks: a do and its end are neighbours among the dos and ends of one depth.
B0 AS (SELECT *, CASE WHEN regexp_matches(code, '(^|\s)do$') THEN 1 WHEN regexp_matches(code, '^\s*end\b') THEN -1 ELSE 0 END AS o FROM LN),
B1 AS (SELECT *, sum(o) OVER (PARTITION BY path ORDER BY n) AS after FROM B0 WHERE o <> 0),
B2 AS (SELECT path, o, n AS first, lead(n) OVER (PARTITION BY path, after - least(o, 0) ORDER BY n) AS last FROM B1),
BLOCKS AS (SELECT path, first, last FROM B2 WHERE o = 1 AND last IS NOT NULL),
-- Brackets over several lines, in the same way.
K0 AS (SELECT *, len(regexp_replace(code, '[^(\[{]', '', 'g')) - len(regexp_replace(code, '[^)\]}]', '', 'g')) AS o FROM LN),
K1 AS (SELECT *, sum(o) OVER (PARTITION BY path ORDER BY n) AS after FROM K0 WHERE o <> 0),
K2 AS (SELECT path, o, n AS first, lead(n) OVER (PARTITION BY path, after - least(o, 0) ORDER BY n) AS last FROM K1),
BRACKETS AS (SELECT path, first, last FROM K2 WHERE o > 0 AND last IS NOT NULL),
LITERALS AS (SELECT path, n AS first, lead(n) OVER (PARTITION BY path ORDER BY n) AS last, q FROM LN WHERE quote)
"""
)
DEFINED = (
    LINES
    + rf""",
-- The definitions of readable files whose line begins as a definition does; their kind is what the line says.
D0 AS (SELECT DISTINCT {_D}, params IS NULL AS unknown FROM definitions),
D1 AS (SELECT D0.* EXCLUDE (kind), code, t, regexp_extract(ltrim(code), '^@?[a-z]+') AS w FROM D0 JOIN LN ON path = file_path AND n = line),
D2 AS (SELECT *, {_KIND} AS kind, regexp_extract(
    (SELECT string_agg(x.code, ' ' ORDER BY x.n) FROM LN x WHERE x.path = file_path AND x.n BETWEEN line AND line + 12), '^\s*\w+\s+[\w?!]+\(([^()]*)\)', 1) AS head FROM D1),
-- Parameters that are not stored are read from the head: the last name of each part, without its default.
PD AS (SELECT DISTINCT * EXCLUDE (unknown, code, t, w, params, head), kind IN {_FUNCTIONS} AS callable, CASE WHEN unknown AND kind IN {_FUNCTIONS} AND arity > 0 THEN array_to_string(
    list_transform(string_split(head, ',')[1:arity], lambda p: regexp_extract(rtrim(split_part(p, '\\', 1)), '[a-z_][A-Za-z0-9_]*$')), ',')
    WHEN kind IN {_FUNCTIONS} THEN params ELSE '' END AS params
    FROM D2 WHERE kind IS NOT NULL AND (function <> '' OR kind IN ('module', 'defprotocol', 'defimpl'))),
-- Functions by head with the last line of their block: that of the do that ends the head.
F0 AS (SELECT file_path, module, function, max(arity) AS arity, kind, line FROM PD WHERE callable GROUP BY ALL),
F1 AS (SELECT F0.*, coalesce((SELECT b.last FROM BRACKETS b WHERE b.path = file_path AND b.first = line), line) AS head_end FROM F0),
FN AS (SELECT F1.* EXCLUDE (head_end), coalesce(b.last, line) AS last_line FROM F1 LEFT JOIN BLOCKS b ON b.path = file_path AND b.first = head_end),
M0 AS (SELECT DISTINCT file_path, module, kind, line FROM PD WHERE function = ''),
MD AS (SELECT M0.*, coalesce(b.last, line) AS last_line FROM M0 LEFT JOIN BLOCKS b ON b.path = file_path AND b.first = line)
"""
)

# Literals of `@doc` and `@moduledoc`: within quotes, within bars or parentheses of a sigil, or the lines of a heredoc without
# the indent of its end; specifications as they stand. OD has those between the statement before a head and the head.
DOCS = r""", AD AS (SELECT path, n, regexp_extract(code, '^\s*@(doc|moduledoc|spec)\b', 1) AS a, t, (SELECT list(x.t ORDER BY x.n) FROM LN x WHERE x.path = LN.path AND x.n > LN.n AND x.n <
        (SELECT l.last FROM LITERALS l WHERE l.path = LN.path AND l.first = LN.n)) AS body, (SELECT y.w0 FROM LITERALS l JOIN LN y ON y.path = l.path AND y.n = l.last WHERE l.path = LN.path AND l.first = LN.n) AS indent,
        (SELECT string_agg(z.t, chr(10) ORDER BY z.n) FROM LN z WHERE z.path = LN.path AND z.n BETWEEN LN.n AND coalesce((SELECT b.last FROM BRACKETS b WHERE b.path = LN.path AND b.first = LN.n), LN.n)) AS whole,
        -- A text that goes on after `<>`: its own line and those after lines that end so.
        (SELECT list(p.t ORDER BY p.n) FROM LN p WHERE p.path = LN.path AND p.n BETWEEN LN.n AND LN.n + 2 AND (p.n = LN.n OR EXISTS (SELECT 1 FROM LN r WHERE r.path = LN.path AND r.n = p.n - 1 AND r.code LIKE '%<>'))) AS parts
    FROM LN WHERE regexp_matches(code, '^\s*@(doc|moduledoc|spec)\b')),
VD AS (SELECT *, CASE WHEN a = 'spec' THEN ltrim(whole) WHEN quote_of = 3 THEN array_to_string(list_transform(body, lambda x: CASE WHEN starts_with(x, repeat(' ', indent)) THEN x[indent + 1:] ELSE x END), chr(10))
    WHEN quote_of = 1 THEN array_to_string(list_transform(parts, lambda x: regexp_replace(regexp_extract(x, '"((?:\\.|[^"\\])*)"', 1), '\\(.)', '\1', 'g')), '')
    WHEN quote_of = 2 THEN regexp_extract(t, '~[a-zA-Z][|(](.*)[|)]', 1) ELSE '' END AS value
    FROM (SELECT *, CASE WHEN regexp_matches(t, '""\"|''{3}') THEN 3 WHEN regexp_matches(t, '@\w+\(? *~[a-zA-Z][|(]') THEN 2 WHEN regexp_matches(t, '@\w+\(? *(~[a-zA-Z])?"') THEN 1 ELSE 0 END AS quote_of FROM AD)),
ED AS (SELECT FN.*, greatest(coalesce((SELECT max(p.last_line) FROM FN p WHERE p.file_path = FN.file_path AND p.line < FN.line), 0), (SELECT max(m.line) FROM MD m WHERE m.file_path = FN.file_path AND m.line < FN.line)) AS since FROM FN),
O0 AS (SELECT file_path, module, function, arity, line, coalesce((SELECT arg_max(value, n) FROM VD V WHERE V.path = file_path AND a = 'doc' AND n > since AND n < line), '') AS doc,
    coalesce((SELECT arg_max(value, n) FROM VD V WHERE V.path = file_path AND a = 'spec' AND n > since AND n < line), '') AS spec FROM ED),
OD AS (SELECT * FROM O0 WHERE doc <> '' OR spec <> ''
UNION ALL SELECT file_path, module, '', 0, MD.line, arg_min(value, n), '' FROM MD JOIN VD V ON V.path = file_path AND a = 'moduledoc' AND n BETWEEN MD.line AND last_line
    AND MD.line = (SELECT max(m.line) FROM MD m WHERE m.file_path = MD.file_path AND n BETWEEN m.line AND m.last_line) GROUP BY file_path, module, MD.line HAVING arg_min(value, n) <> '')
"""
# P: where the functions of qualified calls stand, with the module that stands before; ANSWERS: where these are defined.
PLACED = (
    PREFIX
    + HOPS
    + ", "
    + DEFINED.strip().removeprefix("WITH")
    + DOCS
    + """, C AS (SELECT DISTINCT file_path, line, function FROM R WHERE kind = 'call' AND function <> ''),
C1 AS (SELECT C.*, t, instr(t, '.' || function || '(') AS pos FROM C JOIN LN ON path = file_path AND n = line),
P AS (SELECT DISTINCT C1.file_path, C1.line - 1 AS line, CAST(pos AS INT) AS col, R.module, C1.function FROM C1 JOIN R ON R.file_path = C1.file_path AND R.line = C1.line AND R.function = C1.function
    WHERE pos > 0 AND instr(t, R.module || '.' || R.function || '(') + len(R.module) = pos),
K AS (SELECT DISTINCT module, function FROM P),
T AS (SELECT file_path, line, min(t) AS t FROM FNS GROUP BY ALL),
HIT AS (SELECT DISTINCT K.module, K.function, f.file_path, f.line, T.t FROM K JOIN FD USING (module, function) JOIN FNS f ON f.module = target_module AND f.function = target_function JOIN T ON T.file_path = f.file_path AND T.line = f.line),
FOUND AS (SELECT module, function, file_path AS target_path, line AS target_line FROM HIT h WHERE t = (SELECT min(t) FROM HIT x WHERE x.module = h.module AND x.function = h.function)
    UNION SELECT K.module, K.function, m.file_path, m.line FROM K JOIN MODS m USING (module) WHERE NOT EXISTS (SELECT 1 FROM HIT x WHERE x.module = K.module AND x.function = K.function)),
ANSWERS AS (SELECT DISTINCT P.file_path, P.line, P.col, target_path, target_line FROM P JOIN FOUND USING (module, function))
"""
)

SQL = {
    "parse_definitions": DEFINED + "SELECT * EXCLUDE (callable) FROM PD",
    # Beside the stored references: the modules that `@behaviour` and `to:` name, and names at the start of a line within a
    # specification, which may be of every module imported or used before.
    "parse_references": LINES
    + rf""", R0 AS (SELECT refs.* EXCLUDE (kind), code, CASE WHEN kind IN ('call', 'alias', 'import', 'use', 'require', 'behaviour') THEN kind
    WHEN contains(code, trim(function) || '(') THEN 'call' END AS kind FROM refs JOIN LN ON path = file_path AND n = line),
R AS (SELECT DISTINCT {sql_module("module")} AS module, CASE WHEN function IS NULL AND kind = 'call'
    THEN regexp_extract(code, replace({sql_module("module")}, '.', '\.') || '\.([a-z_]\w*[?!]?)\(', 1) ELSE {sql_strip("function")} END AS function, line, file_path, kind FROM R0 WHERE kind IS NOT NULL),
I AS (SELECT R.module, 'term' AS function, n AS line, file_path, 'call' AS kind FROM R JOIN LN ON path = file_path AND n > line
    WHERE kind IN ('import', 'use') AND regexp_matches(code, '^\s+term\(')),
M AS (SELECT {sql_module("delegate_to")} AS module, '' AS function, line, file_path, 'call' AS kind FROM definitions JOIN L ON path = file_path WHERE kind = 'defdelegate' AND {sql_module("delegate_to")} NOT IN ('', {sql_module("module")})),
B AS (SELECT module, '' AS function, line, file_path, 'call' AS kind FROM R WHERE kind = 'behaviour')
SELECT module, function, line, file_path, kind FROM R UNION SELECT * FROM I UNION SELECT * FROM M UNION SELECT * FROM B""",
    "text_functions": DEFINED + "SELECT file_path, module, function, kind, line FROM FN",
    "text_function_bodies": DEFINED + "SELECT file_path, module, function, arity, kind, line, CAST(last_line AS INT) AS last_line FROM FN",
    "text_buffer_functions": DEFINED
    + """SELECT file_path, function, arity, x[2] AS kind, x[3] AS params, x[1] AS line
FROM (SELECT file_path, function, arity, min((line, kind, params)) AS x FROM PD WHERE callable GROUP BY ALL)""",
    "text_folds": LINES
    + """SELECT path AS file_path, CAST(first AS INT) AS first_line, CAST(last AS INT) AS last_line, kind FROM (
    SELECT path, first, last, 'block' AS kind FROM BLOCKS UNION ALL SELECT path, first, last, 'bracket' FROM BRACKETS
    UNION ALL SELECT path, first, last, 'literal' FROM LITERALS WHERE q % 2 = 0 AND last IS NOT NULL)""",
    "text_bare_calls": LINES
    + r"""SELECT DISTINCT path AS file_path, function, CAST(n AS INT) AS line FROM (SELECT path, n, unnest(regexp_extract_all(
    regexp_replace(code, '^\s*(def[a-z]*|@spec|@callback|@macrocallback)\s+[\w?!]+', ''), '(?:^|[^\w.?!@&:])([a-z_]\w*[?!]?)\(', 1)) AS function FROM LN)""",
    "enclosing_by_block": DEFINED
    + """, P AS (SELECT DISTINCT file_path, line FROM refs JOIN L ON path = file_path)
SELECT P.file_path, P.line, coalesce(arg_max(MD.module, MD.line), '') AS module FROM P LEFT JOIN MD ON MD.file_path = P.file_path AND P.line BETWEEN MD.line AND MD.last_line GROUP BY ALL""",
    "text_symbols": DEFINED
    + """, X AS (SELECT file_path, kind, module AS label, line AS first_line, last_line FROM MD
    UNION ALL SELECT file_path, kind, function || '/' || arity, line, last_line FROM FN
    UNION ALL SELECT file_path, kind, function || '/' || max(arity), line, line FROM PD WHERE kind IN ('type', 'opaque', 'callback', 'macrocallback') GROUP BY file_path, kind, function, line),
Y AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY first_line, last_line DESC) - 1 AS index FROM X)
SELECT a.file_path, CAST(a.index AS INT) AS index, CAST(coalesce(arg_max(b.index, (b.first_line, b.index)), -1) AS INT) AS parent, a.kind, a.label, a.first_line, CAST(a.last_line AS INT) AS last_line
FROM Y a LEFT JOIN Y b ON b.file_path = a.file_path AND b.index < a.index AND b.last_line > b.first_line AND b.last_line >= a.first_line GROUP BY ALL""",
    "text_docs": DEFINED + DOCS + "SELECT * FROM OD",
    # Modules that are imported or used within the lines of a `__using__`.
    "text_using_edges": DEFINED
    + r"""SELECT file_path, module, w AS kind, CAST(row_number() OVER (PARTITION BY file_path, module, w ORDER BY n) - 1 AS INT) AS ordinal, target, '' AS function, -1 AS arity, '' AS option
FROM (SELECT FN.file_path, FN.module, n, regexp_extract(code, '^\s*(import|use)\s+[A-Z]', 1) AS w, regexp_extract(code, '^\s*(?:import|use)\s+([A-Z][\w.]*)', 1) AS target
    FROM FN JOIN LN ON path = file_path AND n BETWEEN line AND last_line WHERE function = '__using__') WHERE w <> ''""",
    # What stands above a head: its nearest line that is not blank, at most three lines up.
    "text_impl_annotations": DEFINED
    + r"""SELECT file_path, module, function, arity, line, x AS impl FROM (SELECT FN.*, (SELECT arg_max(regexp_extract(t, '^\s*@impl\s+([\w.]+)', 1), n) FROM LN
    WHERE path = file_path AND n BETWEEN line - 3 AND line - 1 AND trim(t) <> '') AS x FROM FN) WHERE x <> ''""",
}
SQL |= {
    "definition_at": PLACED + "SELECT file_path, line, col, target_path, target_line FROM ANSWERS",
    "hover_at": PLACED
    + """, HEADS AS (SELECT file_path AS target_path, line AS target_line, kind || ' ' || function || '/' || arity AS signature FROM FN
    UNION ALL SELECT file_path, line, kind || ' ' || module FROM MD),
X AS (SELECT a.file_path, a.line, a.col, min((coalesce(o.doc, '') = '', a.target_path, a.target_line, h.signature, coalesce(o.spec, ''), coalesce(o.doc, ''))) AS x
    FROM ANSWERS a JOIN HEADS h USING (target_path, target_line) LEFT JOIN OD o ON o.file_path = a.target_path AND o.line = a.target_line GROUP BY ALL)
SELECT file_path, line, col, x[4] AS signature, x[5] AS spec, x[6] AS doc FROM X""",
    "signature_at": PLACED
    + """SELECT P.file_path, P.line, CAST(P.col + len(P.function) + 1 AS INT) AS col, module, function, arity, params, 0 AS argument, split_part(params, ',', 1) AS parameter
FROM P JOIN (SELECT DISTINCT module, function, arity, params FROM FNS) f USING (module, function) WHERE arity > 0""",
    "definition_at_modules": PLACED
    + r"""SELECT DISTINCT r.file_path, r.line - 1 AS line, CAST(instr(t, r.module) + len(r.module) - 2 AS INT) AS col, m.file_path AS target_path, m.line AS target_line
FROM R r JOIN LN ON path = r.file_path AND n = r.line JOIN MODS m ON m.module = r.module
WHERE r.kind IN ('alias', 'import', 'use') AND regexp_matches(t, '^\s*' || r.kind || '\s+' || replace(r.module, '.', '\.') || '($|[^\w.])')""",
    # Every place of a variable as a word of its own within the function, from its head to its end.
    "variable_places": DEFINED
    + r""", A AS (SELECT path, n, regexp_extract(t, '\(([a-z_]\w*)\)$', 1) AS v, t FROM LN WHERE regexp_matches(t, '^\s+(v\d+ = )?[A-Z][\w.]*\.[a-z_]\w*[?!]?\([a-z_]\w*\)$')),
G AS (SELECT A.*, arg_max(f.last_line, f.line) AS last, max(f.line) AS first FROM A JOIN FN f ON f.file_path = path AND n BETWEEN f.line AND f.last_line GROUP BY ALL),
W AS (SELECT G.path, G.n, G.v, LN.n AS m, G.t AS own, unnest(list_filter(range(1, len(LN.t) + 1), lambda i: LN.t[i:i + len(G.v) - 1] = G.v AND NOT regexp_matches(coalesce(LN.t[i - 1:i - 1], ' '), '[\w.@:]')
    AND NOT regexp_matches(LN.t[i + len(G.v):i + len(G.v)], '[\w?!:(]'))) AS pos FROM G JOIN LN ON LN.path = G.path AND LN.n BETWEEN G.first AND G.last)
SELECT path AS file_path, CAST(n - 1 AS INT) AS line, CAST(len(own) - len(v) - 1 AS INT) AS col, CAST(m - 1 AS INT) AS at_line, CAST(pos - 1 AS INT) AS at_col, CAST(pos - 1 + len(v) AS INT) AS at_end FROM W""",
}
for _name in SQL:
    SQL[_name] = SQL[_name].replace('""\\"', '"' * 3)
