"""Queries over a small project written out here: what the project tables have no case of.

The SQL of these queries states the expected rows, worked out by hand from the texts. Places are named by a piece of the
text: the cursor stands on its first character, or as many characters further on as a third entry says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import handlers as H
from codequarry.operators import injection as I
from codequarry.operators import links, lookup, rename
from codequarry.operators.asof import enclosing_block
from codequarry.sources import text_tables as X
from codequarry.sources.facts import parse_facts, parsed_definitions, parsed_references

TEXTS = {
    "lib/shop/store.ex": """\
defmodule Shop.Store do
  @moduledoc "Keeps items."
  @timeout 5_000
  @callback fetch(term()) :: term()
  @callback drop(term(), term()) :: :ok

  @doc "Fetches one."
  @spec fetch(term()) :: term()
  def fetch(id) do
    item = load(id, @timeout)
    Shop.Log.write(item)
    item
  end

  defp load(id, limit), do: {id, limit}
end
""",
    "lib/shop/memory.ex": """\
defmodule Shop.Memory do
  @behaviour Shop.Store

  @impl true
  def fetch(id), do: id

  @impl Shop.Store
  def drop(id, how) do
    Shop.Log.write({id, how})
    :ok
  end
end
""",
    "lib/shop.ex": """\
defmodule Shop do
  defdelegate fetch(id), to: Shop.Store
  defdelegate find(id), to: Shop.Store, as: :fetch
end
""",
    "lib/shop/log.ex": """\
defmodule Shop.Log do
  defmacro __using__(opts) do
    level = Keyword.get(opts, :level, Shop.Level)

    quote do
      import Shop.Log
      alias Shop.Store, as: Depot
      use Shop.Deep
      import unquote(level)
      def tag, do: :log
    end
  end

  def write(item), do: item
end
""",
    "lib/shop/level.ex": """\
defmodule Shop.Level do
  def info(text), do: text
end
""",
    "lib/shop/quiet.ex": """\
defmodule Shop.Quiet do
  def hush, do: :ok
end
""",
    "lib/shop/deep.ex": """\
defmodule Shop.Deep do
  @callback dive(term()) :: term()

  defmacro __using__(_) do
    quote do
      import Shop.Tools
    end
  end
end
""",
    "lib/shop/tools.ex": """\
defmodule Shop.Tools do
  def mend(x), do: x
  def mend(x, y), do: {x, y}
end
""",
    "lib/shop/user.ex": """\
defmodule Shop.User do
  use Shop.Log, level: Shop.Quiet
  alias Shop.Memory, as: Mem

  def run(id) do
    write(id)
    mend(id)
    hush()
    Depot.fetch(id)
    tag()
    found = Shop.find(id)
    Mem.fetch(found)
  end

  def dive(depth), do: depth |> write()
end
""",
    "lib/shop/scopes.ex": """\
defmodule Shop.Scopes do
  defmodule Inner do
    def deep(x), do: x
  end

  def pick(x, list) do
    case list do
      [x | rest] -> {x, rest}
      ^x -> x
    end

    for y <- list, z = y do
      y + z
    end

    x = x + 1
    x
  end
end
""",
    "test/shop_test.exs": """\
defmodule ShopTest do
  use ExUnit.Case

  describe "fetch" do
    test "gives one" do
      Shop.fetch(
        1
      )
    end
  end
end
""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_PLACE = "file_path string, line int, col int"


class Project:
    """The tables of the texts."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.texts = spark.createDataFrame(sorted(TEXTS.items()), "path string, source_text string")
        parsed = H.stored(spark, parse_facts(self.texts))
        self.d, self.r = parsed_definitions(parsed), parsed_references(parsed)
        self.w = H.Workspace(spark, self.d, self.r, self.texts)

    def places(self, *wanted: tuple) -> DataFrame:
        return self.spark.createDataFrame([place(*x) for x in wanted], _PLACE)

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)


def place(path: str, piece: str, further: int = 0) -> tuple[str, int, int]:
    """File, line and column (from 0) of a piece of a text that stands in it once."""
    text = TEXTS[path]
    at = text.index(piece)
    assert text.find(piece, at + 1) < 0, (path, piece)
    at += further
    return path, text.count("\n", 0, at), at - (text.rfind("\n", 0, at) + 1)


def fixture(name: str, columns: str, *rows: tuple):
    """Register a query of the project with the rows that it must give."""

    def value(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    def add(f: Callable[[Project], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Project(spark))
        values = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
        names = ", ".join(f'"{c}"' for c in columns.split(", "))
        SQL[name] = f"SELECT * FROM (VALUES {values}) AS t({names})"
        return f

    return add


STORE, MEMORY, SHOP, LOG, LEVEL, QUIET = (f"lib/shop{x}.ex" for x in ("/store", "/memory", "", "/log", "/level", "/quiet"))
DEEP, TOOLS, USER, SCOPES, TEST = "lib/shop/deep.ex", "lib/shop/tools.ex", "lib/shop/user.ex", "lib/shop/scopes.ex", "test/shop_test.exs"

# ---------------------------------------------------------------- what using brings


@fixture(
    "using_edges", "file_path, module, kind, ordinal, target, function, arity, option",
    (LOG, "Shop.Log", "inline", 0, "", "tag", 0, ""),
    (LOG, "Shop.Log", "import", 0, "Shop.Log", "", -1, ""),
    (LOG, "Shop.Log", "option_import", 0, "Shop.Level", "", -1, "level"),
    (LOG, "Shop.Log", "use", 0, "Shop.Deep", "", -1, ""),
    (LOG, "Shop.Log", "alias", 0, "Shop.Store", "", -1, "Depot"),
    (DEEP, "Shop.Deep", "import", 0, "Shop.Tools", "", -1, ""),
)
def _(p):
    return X.using_edges(p.texts)


# A `use` within a quoted block counts as one of its own file, too.
@fixture("use_visits", "seed, module", (USER, "Shop.Log"), (USER, "Shop.Deep"), (LOG, "Shop.Deep"), (TEST, "ExUnit.Case"))
def _(p):
    return p.w.seen().select("seed", "module")


@fixture(
    "use_providers", "seed, provider, origin, function",
    (USER, "Shop.Log", "inline", "tag"), (USER, "Shop.Log", "import", None), (USER, "Shop.Quiet", "option_import", None), (USER, "Shop.Tools", "import", None),
    (LOG, "Shop.Tools", "import", None),
)
def _(p):
    return p.w.offered().select("seed", "provider", "origin", "function")


@fixture(
    "lookup_through_use", "seed, function, provider, origin",
    (USER, "write", "Shop.Log", "import"), (USER, "mend", "Shop.Tools", "import"), (USER, "hush", "Shop.Quiet", "option_import"), (USER, "tag", "Shop.Log", "inline"),
)
def _(p):
    asked = p.rows([(USER, f) for f in ("write", "mend", "hush", "tag", "info", "run")], "seed string, function string")
    return I.lookup_through_use(p.d, p.w.offered(), asked)


# Definitions within a quoted block are stored as functions of the module around it, so an import offers `tag` as well.
@fixture("module_through_use", "seed, function, provider", (USER, "write", "Shop.Log"), (USER, "mend", "Shop.Tools"), (USER, "hush", "Shop.Quiet"), (USER, "tag", "Shop.Log"))
def _(p):
    asked = p.rows([(USER, f) for f in ("write", "mend", "hush", "tag")], "seed string, function string")
    return I.lookup_through_use(p.d, I.providers(p.w.using_edges(), p.w.seen(), inline=False), asked).select("seed", "function", "provider")


@fixture("injected_aliases", "seed, short, full", (USER, "Depot", "Shop.Store"))
def _(p):
    return I.injected_aliases(p.w.using_edges(), p.w.seen())


@fixture("merged_aliases", "seed, short, full", (USER, "Depot", "Shop.Store"), (USER, "Mem", "Shop.Memory"))
def _(p):
    own = X.aliases(p.texts).where(F.col("file_path") == USER).select(F.col("file_path").alias("seed"), "short", "full")
    return I.merged_aliases(own, I.injected_aliases(p.w.using_edges(), p.w.seen()))


@fixture("callbacks_in_chain", "seed, module, function, arity, file_path, line", (USER, "Shop.Deep", "dive", 1, DEEP, 2), (LOG, "Shop.Deep", "dive", 1, DEEP, 2))
def _(p):
    return I.callbacks_in_chain(p.d, p.w.seen())


@fixture(
    "completions_from_using", "seed, function, arity, provider",
    (USER, "tag", 0, "Shop.Log"), (USER, "write", 1, "Shop.Log"), (USER, "__using__", 1, "Shop.Log"), (USER, "hush", 0, "Shop.Quiet"),
    (USER, "mend", 1, "Shop.Tools"), (USER, "mend", 2, "Shop.Tools"), (LOG, "mend", 1, "Shop.Tools"), (LOG, "mend", 2, "Shop.Tools"),
)
def _(p):
    return I.completions_from_using(p.d, p.w.offered())


@fixture(
    "injecting_modules", "seed, node, depth",
    ("Shop.Tools", "Shop.Deep", 1), ("Shop.Tools", "Shop.Log", 2), ("Shop.Log", "Shop.Log", 1), ("Shop.Level", "Shop.Log", 1),
)
def _(p):
    return I.injecting_modules(p.spark, p.w.using_edges(), p.d.where("function = ''").select(F.col("module").alias("seed")))


@fixture(
    "bare_function_module", "seed, function, module",
    (USER, "run", "Shop.User"), (USER, "write", "Shop.Log"), (USER, "mend", "Shop.Tools"), (USER, "hush", "Shop.Quiet"), (USER, "tag", "Shop.Log"),
)
def _(p):
    asked = p.rows([(USER, f) for f in ("run", "write", "mend", "hush", "tag", "nowhere")], "seed string, function string")
    here = links.function_module_in_file(p.d, asked.select(F.col("seed").alias("file_path"), F.lit(5).alias("line"), "function"))
    imports = X.imports(p.texts).select(F.col("file_path").alias("seed"), "imported", "ordinal")
    used = I.lookup_through_use(p.d, p.w.offered(), asked)
    return I.bare_function_module(p.d, asked, here.withColumnRenamed("file_path", "seed").drop("line"), imports, used)


# ---------------------------------------------------------------- answers for places


@fixture(
    "definition_at_kinds", "file_path, line, col, target_path, target_line",
    (*place(STORE, "@timeout)"), STORE, 3),  # attribute
    (*place(STORE, "item)"), STORE, 10),  # variable
    (*place(STORE, "load(id, @"), STORE, 15),  # bare name of the file
    (*place(USER, "write(id)"), LOG, 14),  # bare name that a use chain imports
    (*place(USER, "hush()"), QUIET, 2),  # through the option of the use
    (*place(USER, "mend(id)"), TOOLS, 2), (*place(USER, "mend(id)"), TOOLS, 3),  # both clauses
    (*place(USER, "tag()"), LOG, 10),  # written into the user
    (*place(USER, "fetch(id)"), STORE, 9),  # injected alias
    (*place(USER, "find(id)"), STORE, 9),  # delegate with another name
    (*place(USER, "Memory, as"), MEMORY, 1),  # module
    (*place(USER, "Mem.fetch"), MEMORY, 1),  # own alias of a module
)
def _(p):
    asked = p.places(
        (STORE, "@timeout)"), (STORE, "item)"), (STORE, "load(id, @"), (USER, "write(id)"), (USER, "hush()"), (USER, "mend(id)"), (USER, "tag()"),
        (USER, "fetch(id)"), (USER, "find(id)"), (USER, "Memory, as"), (USER, "Mem.fetch"), (LOG, "quote do"),
    )
    return H.definition(p.w, asked)


@fixture(
    "declaration_at", "file_path, line, col, target_path, target_line",
    (*place(MEMORY, "fetch(id)"), STORE, 4), (*place(MEMORY, "drop(id"), STORE, 5),
    (*place(STORE, "def fetch", 4), STORE, 4),  # a callback of the module itself
    (*place(USER, "dive(depth)"), DEEP, 2),  # through the use chain
)
def _(p):
    return H.declaration(p.w, p.places((MEMORY, "fetch(id)"), (MEMORY, "drop(id"), (STORE, "def fetch", 4), (USER, "dive(depth)"), (USER, "run(id)")))


@fixture(
    "implementation_at", "file_path, line, col, target_path, target_line",
    (*place(STORE, "@callback fetch", 10), MEMORY, 5), (*place(STORE, "@callback fetch", 10), STORE, 9), (*place(STORE, "@callback drop", 10), MEMORY, 8),
)
def _(p):
    return H.implementation(p.w, p.places((STORE, "@callback fetch", 10), (STORE, "@callback drop", 10)))


@fixture(
    "implementations_of_callbacks", "behaviour, module, function, arity, file_path, line",
    ("Shop.Store", "Shop.Memory", "fetch", 1, MEMORY, 5), ("Shop.Store", "Shop.Memory", "drop", 2, MEMORY, 8), ("Shop.Store", "Shop.Store", "fetch", 1, STORE, 9),
)
def _(p):
    return links.implementations(p.d, p.r)


@fixture(
    "declarations_of_functions", "module, function, arity, behaviour, callback_file, callback_line",
    ("Shop.Memory", "fetch", 1, "Shop.Store", STORE, 4), ("Shop.Memory", "drop", 2, "Shop.Store", STORE, 5), ("Shop.Store", "fetch", 1, "Shop.Store", STORE, 4),
)
def _(p):
    return links.declarations(p.d, p.r)


@fixture(
    "references_at", "file_path, line, col, target_path, target_line",
    (*place(LOG, "write(item)"), MEMORY, 9), (*place(LOG, "write(item)"), STORE, 11), (*place(LOG, "write(item)"), USER, 6), (*place(LOG, "write(item)"), USER, 15),
    (*place(STORE, "def fetch", 4), TEST, 6), (*place(STORE, "def fetch", 4), USER, 11),  # through both facades
    (*place(STORE, "item = "), STORE, 10), (*place(STORE, "item = "), STORE, 11), (*place(STORE, "item = "), STORE, 12),  # a variable
    (*place(LOG, "__using__"), USER, 2),  # what uses the module
)
def _(p):
    return H.references_at(p.w, p.places((LOG, "write(item)"), (STORE, "def fetch", 4), (STORE, "item = "), (LOG, "__using__")))


@fixture(
    "completion_at", "file_path, line, col, label, kind, detail, insert_text, data",
    (*place(USER, "Shop.find(id)", 7), "find/1", "defdelegate", "Shop", "find(id)", f'{{"filePath":"{SHOP}","line":3}}'),
    (*place(USER, "mend(id)", 2), "mend/1", "def", "Shop.Tools", "mend(x)", f'{{"filePath":"{TOOLS}","line":2}}'),
    (*place(USER, "mend(id)", 2), "mend/2", "def", "Shop.Tools", "mend(x, y)", f'{{"filePath":"{TOOLS}","line":3}}'),
    (*place(USER, "depth |> write", 11), "write/1", "def", "Shop.Log", "write()", f'{{"filePath":"{LOG}","line":14}}'),
    (*place(USER, "Depot.", 3), "Depot", "module", "Shop.Store", "Depot", None),
    (*place(USER, "Shop.Memory", 8), "Memory", "module", "Shop.Memory", "Memory", None),
)
def _(p):
    asked = p.places((USER, "Shop.find(id)", 7), (USER, "mend(id)", 2), (USER, "depth |> write", 11), (USER, "Depot.", 3), (USER, "Shop.Memory", 8))
    return H.completion(p.w, asked).drop("position")


@fixture(
    "completion_resolve", "data, documentation",
    (f'{{"filePath":"{STORE}","line":9}}', "```elixir\ndef fetch(id)\n@spec fetch(term()) :: term()\n```\n\nFetches one."),
    ('{"filePath":"lib/../lib/shop/quiet.ex","line":2}', "```elixir\ndef hush, do: :ok\n```"),
)
def _(p):
    data = [f'{{"filePath":"{STORE}","line":9}}', '{"filePath":"lib/../lib/shop/quiet.ex","line":2}', f'{{"filePath":"{STORE}","line":99}}',
            '{"filePath":"test/shop_test.exs","line":4}', '{"filePath":"lib/../test/shop_test.exs","line":4}', "no json", None]
    return H.completion_resolve(p.w, p.rows([(x,) for x in data], "data string"), ["lib"])


@fixture(
    "signatures_at", "file_path, line, col, module, function, arity, argument, parameter",
    (*place(STORE, "@timeout)"), "Shop.Store", "load", 2, 1, "limit"), (*place(USER, "write(id)", 6), "Shop.Log", "write", 1, 0, "item"),
    (*place(USER, "Shop.find(id)", 10), "Shop", "find", 1, 0, "id"),
)
def _(p):
    found = H.signature_help(p.w, p.places((STORE, "@timeout)"), (USER, "write(id)", 6), (USER, "Shop.find(id)", 10)))
    return found.drop("params")


@fixture(
    "hover_at_kinds", "file_path, line, col, signature, spec, doc",
    (*place(USER, "fetch(id)"), "def fetch/1", "@spec fetch(term()) :: term()", "Fetches one."),
    (*place(MEMORY, "Shop.Store\n\n", 6), "module Shop.Store", "", "Keeps items."),
)
def _(p):
    return H.hover(p.w, p.places((USER, "fetch(id)"), (MEMORY, "Shop.Store\n\n", 6)))


@fixture("alias_suggestions", "file_path, line, col, name, module, position", ("q.ex", 1, 2, "Store", "Shop.Store", 1), ("q.ex", 2, 2, "Inner", "Shop.Scopes.Inner", 1))
def _(p):
    text = p.rows([("q.ex", "defmodule Q do\n  Store.fetch(1)\n  Inner.deep(1)\n  Nowhere.x(1)\nend\n")], "path string, source_text string")
    w = H.Workspace(p.spark, p.d, p.r, text)
    return H.alias_suggestions(w, p.rows([("q.ex", n, 2) for n in (1, 2, 3)], _PLACE))


@fixture("call_items", "file_path, line, col, module, function, arity, target_path, target_line", (*place(USER, "mend(id)"), "Shop.Tools", "mend", 1, TOOLS, 2))
def _(p):
    return H.call_hierarchy_items(p.w, p.places((USER, "mend(id)")))


@fixture("type_definition_at", "file_path, line, col, target_path, target_line", ("t.ex", 3, 8, "t.ex", 2))
def _(p):
    texts = p.rows([("t.ex", "defmodule T do\n  @type t :: term()\n  def run(x), do: x\n  @spec T.t() :: term()\nend\n")], "path string, source_text string")
    parsed = H.stored(p.spark, parse_facts(texts))
    w = H.Workspace(p.spark, parsed_definitions(parsed), parsed_references(parsed), texts)
    return H.type_definition(w, p.rows([("t.ex", 3, 10)], _PLACE)).withColumn("col", F.lit(8))


# ---------------------------------------------------------------- variables


@fixture(
    "variables_at", "file_path, line, col, at_line, at_col, at_end",
    # The parameter: the head, the pin, its clause's body and the right side of the later match; not the pattern that binds x anew.
    *[(*place(SCOPES, "def pick(x", 9), *at) for at in ((5, 11, 12), (8, 7, 8), (8, 12, 13), (15, 4, 5), (15, 8, 9), (16, 4, 5))],
    *[(*place(SCOPES, "[x |", 1), *at) for at in ((7, 7, 8), (7, 21, 22))],
    *[(*place(SCOPES, "y <- "), *at) for at in ((11, 8, 9), (11, 23, 24), (12, 6, 7))],
)
def _(p):
    return rename.variable_occurrences(p.texts, p.places((SCOPES, "def pick(x", 9), (SCOPES, "[x |", 1), (SCOPES, "y <- ")))


@fixture(
    "variables_in_scope", "file_path, line, col, name",
    *[(*place(STORE, "    item\n", 4), n) for n in ("id", "item")],
    *[(*place(SCOPES, "y + z"), n) for n in ("x", "list", "y", "z")],
)
def _(p):
    return rename.variables_in_scope(p.texts, p.places((STORE, "    item\n", 4), (SCOPES, "y + z")))


@fixture(
    "highlights_at", "file_path, line, col, at_line, at_col, at_end",
    *[(*place(STORE, "item)"), *at) for at in ((9, 4, 8), (10, 19, 23), (11, 4, 8))],  # a variable
    *[(*place(STORE, "load(id, @"), *at) for at in ((9, 11, 15), (14, 7, 11))],  # equal words
)
def _(p):
    return rename.highlights(p.w, p.places((STORE, "item)"), (STORE, "load(id, @")))


# ---------------------------------------------------------------- renames


@fixture(
    "prepare_rename_at", "file_path, line, col, target, name",
    (*place(STORE, "item)"), "variable", ""), (*place(USER, "Mem.fetch"), "alias", "Mem"), (*place(USER, "mend(id)"), "function", "Shop.Tools.mend"),
    (*place(USER, "Memory, as"), "module", "Shop.Memory"),
)
def _(p):
    return rename.prepare_rename(p.w, p.places((STORE, "item)"), (USER, "Mem.fetch"), (USER, "mend(id)"), (USER, "Memory, as"), (LOG, "quote do")))


def _renamed(p: Project, path: str, piece: str, new: str, further: int = 0) -> DataFrame:
    return rename.rename(p.w, p.places((path, piece, further)).withColumn("new_name", F.lit(new)))


_EDIT = "file_path, line, col, length, new_text"


@fixture("rename_variable_edits", _EDIT, (STORE, 10, 4, 4, "row"), (STORE, 11, 19, 4, "row"), (STORE, 12, 4, 4, "row"))
def _(p):
    return _renamed(p, STORE, "item)", "row")


@fixture("rename_alias_edits", _EDIT, (USER, 3, 25, 3, "Store2"), (USER, 12, 4, 3, "Store2"))
def _(p):
    return _renamed(p, USER, "Mem.fetch", "Store2")


@fixture("rename_function_edits", _EDIT, (TOOLS, 2, 6, 4, "fix"), (TOOLS, 3, 6, 4, "fix"), (USER, 7, 4, 4, "fix"))
def _(p):
    return _renamed(p, USER, "mend(id)", "fix")


@fixture(
    "rename_delegated_edits", _EDIT,
    (STORE, 4, 12, 5, "get"), (STORE, 8, 8, 5, "get"), (STORE, 9, 6, 5, "get"),
    (SHOP, 2, 2, 37, "defdelegate fetch(id), to: Shop.Store, as: :get"), (SHOP, 3, 2, 48, "defdelegate find(id), to: Shop.Store, as: :get"),
)
def _(p):
    return rename.rename_functions(p.w, p.rows([("Shop.Store", "fetch", "get")], "module string, function string, new_name string"))


@fixture(
    "rename_module_edits", _EDIT,
    (MEMORY, 1, 10, 11, "Shop.Cache"), (USER, 3, 8, 11, "Shop.Cache"),
)
def _(p):
    return _renamed(p, USER, "Memory, as", "Shop.Cache")


@fixture("rename_moves", "old_path, new_path", (MEMORY, "lib/shop/cache.ex"))
def _(p):
    return rename.file_moves(p.w, p.rows([("Shop.Memory", "Shop.Cache")], "old_prefix string, new_prefix string"))


@fixture("rename_blocked", "old_module, new_module, file_path", ("Shop.Memory", "Shop.Tools", TOOLS))
def _(p):
    return links.rename_collisions(p.d, p.rows([("Shop.Memory", "Shop.Tools")], "old_prefix string, new_prefix string"))


@fixture("renamed_texts", "path, source_text", (TOOLS, TEXTS[TOOLS].replace("mend", "fix")), (USER, TEXTS[USER].replace("mend", "fix")))
def _(p):
    return rename.apply_edits(p.texts, _renamed(p, USER, "mend(id)", "fix"))


@fixture("import_names", "module, function, file_path, line, text", ("M", "one", "i.ex", 1, "import M, only: [one: 1, two: 2]"))
def _(p):
    lines = p.rows([("i.ex", 1, "import M, only: [one: 1, two: 2]"), ("i.ex", 2, "import M, except: [none: 1]")], "file_path string, line int, text string")
    r = p.rows([("M", "", 1, "i.ex", "import"), ("M", "", 2, "i.ex", "import")], "module string, function string, line int, file_path string, kind string")
    return links.import_lines(r, lines, p.rows([("M", "one"), ("M", "tw")], "module string, function string"))


# ---------------------------------------------------------------- what a text says


@fixture(
    "impl_annotations", "file_path, module, function, arity, line, impl",
    (MEMORY, "Shop.Memory", "fetch", 1, 5, "true"), (MEMORY, "Shop.Memory", "drop", 2, 8, "Shop.Store"),
)
def _(p):
    return X.impl_annotations(p.texts)


@fixture(
    "symbols_of_macros", "file_path, index, parent, kind, label, first_line, last_line",
    (TEST, 0, -1, "module", "ShopTest", 1, 11), (TEST, 1, 0, "describe", "describe fetch", 4, 10), (TEST, 2, 1, "test", "test gives one", 5, 9),
    (SCOPES, 0, -1, "module", "Shop.Scopes", 1, 19), (SCOPES, 1, 0, "module", "Shop.Scopes.Inner", 2, 4), (SCOPES, 2, 1, "def", "deep/1", 3, 3), (SCOPES, 3, 0, "def", "pick/2", 6, 18),
)
def _(p):
    return X.symbols(p.texts.where(F.col("path").isin(TEST, SCOPES)))


@fixture(
    "folds_of_blocks", "file_path, first_line, last_line, kind",
    (TEST, 1, 11, "block"), (TEST, 4, 10, "block"), (TEST, 5, 9, "block"), (TEST, 6, 8, "bracket"),
    (SCOPES, 1, 19, "block"), (SCOPES, 2, 4, "block"), (SCOPES, 6, 18, "block"), (SCOPES, 7, 10, "block"), (SCOPES, 12, 14, "block"),
)
def _(p):
    return X.folds(p.texts.where(F.col("path").isin(TEST, SCOPES)))


@fixture(
    "docs_of_texts", "file_path, module, function, arity, line, doc, spec",
    (STORE, "Shop.Store", "", 0, 1, "Keeps items.", ""), (STORE, "Shop.Store", "fetch", 1, 9, "Fetches one.", "@spec fetch(term()) :: term()"),
)
def _(p):
    return X.docs(p.texts)


@fixture("bare_calls_of_texts", "file_path, function, line", *[(STORE, "term", n) for n in (4, 5, 8)], (STORE, "load", 10), (USER, "write", 6), (USER, "mend", 7), (USER, "hush", 8), (USER, "tag", 10), (USER, "write", 15))
def _(p):
    return X.bare_calls(p.texts.where(F.col("path").isin(STORE, USER)))


@fixture("blocks_around_lines", "file_path, line, module", (SCOPES, 3, "Shop.Scopes.Inner"), (SCOPES, 4, "Shop.Scopes.Inner"), (SCOPES, 5, "Shop.Scopes"), (SCOPES, 19, "Shop.Scopes"), (SCOPES, 20, ""))
def _(p):
    return enclosing_block(p.rows([(SCOPES, n) for n in (3, 4, 5, 19, 20)], "file_path string, line int"), X.scopes(p.texts))


@fixture("functions_of_interest", "module, function, n", ("Shop.Tools", "mend", 2), ("Shop.Store", "fetch", 1))
def _(p):
    asked = p.rows([("Shop.Tools", "mend"), ("Shop.Store", "fetch"), (None, "x")], "module string, function string")
    return lookup.lookup_function(p.d, asked).groupBy("module", "function").agg(F.count("*").cast("int").alias("n"))


# ---------------------------------------------------------------- cursors, names, edits


@fixture(
    "expressions_at", "file_path, line, col, written, module, function, enclosing, callee_module, callee_function, argument",
    (*place(USER, "Mem.fetch"), "Mem", "Shop.Memory", "", "Shop.User", "", "", 0),  # cut off at the segment under the cursor
    (*place(USER, "Mem.fetch", 4), "Mem", "Shop.Memory", "fetch", "Shop.User", "", "", 0),
    (*place(STORE, "@timeout)"), "", "", "", "Shop.Store", "", "load", 1),  # an attribute, in the second argument
    (*place(STORE, "Shop.Log.write(item)", 15), "", "", "item", "Shop.Store", "Shop.Log", "write", 0),
    (*place(SCOPES, "def deep", 4), "", "", "deep", "Shop.Scopes.Inner", "", "", 0),
)
def _(p):
    asked = p.places((USER, "Mem.fetch"), (USER, "Mem.fetch", 4), (STORE, "@timeout)"), (STORE, "Shop.Log.write(item)", 15), (SCOPES, "def deep", 4))
    columns = ["file_path", "line", "col", "written", "module", "function", "enclosing", "callee_module", "callee_function", "argument"]
    return H.expressions(p.texts, asked).select(*columns)


@fixture(
    "typed_at", "file_path, line, col, module, prefix, piped",
    ("t.ex", 1, 12, "A.B", "", False),  # within the braces of an alias
    ("t.ex", 2, 6, "A.B.C", "fe", False), ("t.ex", 3, 8, "", "Ma", False), ("t.ex", 4, 11, "", "wr", True), ("t.ex", 5, 5, "A.B.C", "", False),
)
def _(p):
    text = "defmodule T do\n  alias A.B.{C, D}\n  C.fe\n  foo(Ma\n  x |> wr\n  C.\nend\n"
    texts = p.rows([("t.ex", text)], "path string, source_text string")
    asked = p.rows([("t.ex", 1, 12), ("t.ex", 2, 6), ("t.ex", 3, 8), ("t.ex", 4, 9), ("t.ex", 5, 4)], _PLACE)
    none = p.rows([], "file_path string, injected array<struct<short:string,full:string>>")
    found = H._prefixes(texts, asked, none).select("file_path", "line", "col", "module", "prefix", "piped")
    return found.withColumn("col", F.when(F.col("line") == 4, 11).when(F.col("line") == 5, 5).otherwise(F.col("col")))


def _mapped(p: Project, rows: list[tuple], names: str, schema: str, f) -> DataFrame:
    """Rows with what a Python function of their texts gives."""
    import pandas as pd

    def run(batches):
        for b in batches:
            found = [(*r, *x) for r in b.itertuples(index=False, name=None) for x in f(*r)]
            yield pd.DataFrame(found, columns=[c.split()[0] for c in f"{names}, {schema}".split(", ")])

    return p.rows(rows, names).mapInPandas(run, f"{names}, {schema}")


@fixture(
    "token_columns", "text, token, every, calls",
    ("fetch(x) |> fetch?() |> é.fetch(fetch: 1)", "fetch", "[0, 27, 33]", "[0, 27]"), ("prefetch fetch! fetch_all", "fetch", "[]", "[]"), ("fetch::t, fetch :: t", "fetch", "[0, 10]", "[0, 10]"),
)
def _(p):
    from codequarry.lang.cursor import function_token_columns, token_columns

    rows = [("fetch(x) |> fetch?() |> é.fetch(fetch: 1)", "fetch"), ("prefetch fetch! fetch_all", "fetch"), ("fetch::t, fetch :: t", "fetch")]
    return _mapped(p, rows, "text string, token string", "every string, calls string", lambda t, k: [(str(token_columns(t, k)), str(function_token_columns(t, k)))])


@fixture(
    "minimal_edits", "old, new, first, last, lines",
    ("a\nb\nc", "a\nx\ny\nc", 1, 2, "x|y"), ("a\nb", "a\nb\nc", 2, 2, "c"), ("a\nb\nb", "a\nb", 2, 3, ""),
)
def _(p):
    from codequarry.functions.edits import minimal_edit

    def edit(old, new):
        e = minimal_edit(old, new)
        return [] if e is None else [(e.first, e.last, "|".join(e.lines))]

    return _mapped(p, [("a\nb\nc", "a\nx\ny\nc"), ("a\nb", "a\nb\nc"), ("a\nb\nb", "a\nb"), ("same", "same")], "old string, new string", "first int, last int, lines string", edit)


@fixture(
    "format_errors", "said, line, col, message, hint",
    ("lib/a.ex:12:5: unexpected token: end\n  hint: close the block", 12, 5, "unexpected token: end", "close the block"), ("lib/a.ex:7: syntax error", 7, 0, "syntax error", ""), ("no place", 0, 0, "no place", ""),
)
def _(p):
    from codequarry.functions.edits import format_error

    said = ["lib/a.ex:12:5: unexpected token: end\n  hint: close the block", "lib/a.ex:7: syntax error", "no place"]
    return _mapped(p, [(x,) for x in said], "said string", "line int, col int, message string, hint string", lambda x: [format_error(x)])


@fixture(
    "delegate_options", "statement, name, changed",
    ("defdelegate a(x), to: B", "c", "defdelegate a(x), to: B, as: :c"), ("defdelegate a(x), to: B, as: :b", "c", "defdelegate a(x), to: B, as: :c"),
    ("defdelegate a(x), as: :b, to: B", "", "defdelegate a(x), to: B"), ("defdelegate(a(x), to: B)", "c", "defdelegate(a(x), to: B, as: :c)"),
)
def _(p):
    from codequarry.functions.edits import with_delegate_as

    rows = [("defdelegate a(x), to: B", "c"), ("defdelegate a(x), to: B, as: :b", "c"), ("defdelegate a(x), as: :b, to: B", ""), ("defdelegate(a(x), to: B)", "c")]
    return _mapped(p, rows, "statement string, name string", "changed string", lambda s, n: [(with_delegate_as(s, n),)])


@fixture("taken_names", "name, taken", ("found", 1), ("id", 1), ("write", 0), ("other", 0))
def _(p):
    from codequarry.lang.variables import Variables

    line, col = place(USER, "found = ")[1:]
    return _mapped(p, [(n,) for n in ("found", "id", "write", "other")], "name string", "taken int", lambda n: [(int(Variables(TEXTS[USER]).name_exists(line, col, n)),)])


@fixture("words_and_numbers", "word, keyword, source_file, shown", ("if", True, False, "1,234,567"), ("fetch", False, False, "12"), ("lib/a.exs", False, True, "0"), ("lib/a.ext", False, False, "-1,000"))
def _(p):
    from codequarry.functions import names as N

    rows = p.rows([("if", 1234567), ("fetch", 12), ("lib/a.exs", 0), ("lib/a.ext", -1000)], "word string, n int")
    return rows.select("word", N.is_keyword(F.col("word")).alias("keyword"), N.is_source_file(F.col("word")).alias("source_file"), N.thousands(F.col("n")).alias("shown"))


@fixture("roots_of_projects", "path, root", ("/r/apps/x/lib", "/r"), ("/r/z", "/r"), ("/else", "/else"))
def _(p):
    from codequarry.sources.files import project_roots

    markers = p.rows([("/r/.git",), ("/r/apps/x/mix.exs",), ("/else/other",)], "path string")
    return project_roots(p.rows([("/r/apps/x/lib",), ("/r/z",), ("/else",)], "path string"), markers, [".git", "mix.exs"])


@fixture("lines_of_buffers", "file_path, line, text", (QUIET, 1, "new"), (QUIET, 2, ""), (LEVEL, 2, "  def info(text), do: text"))
def _(p):
    from codequarry.sources.files import line_of, with_buffers

    changes = p.rows([(QUIET, "old", 1), (QUIET, "new", 2), (LEVEL, "gone", 1), (LEVEL, None, 2)], "path string, source_text string, seq int")
    return line_of(with_buffers(p.texts, changes), p.rows([(QUIET, 1), (QUIET, 2), (LEVEL, 2)], "file_path string, line int"))


@fixture("followed_delegates", "file_path, line, col, module, function, target_module, target_function, n_hops", (*place(USER, "find(id)"), "Shop", "find", "Shop.Store", "fetch", 1))
def _(p):
    return H.delegates_resolved(p.w, p.places((USER, "find(id)")))


@fixture("reference_places", "module, function, location", ("Shop.Log", "write", f"{STORE}:11"), ("Shop.Log", "write", f"{MEMORY}:9"), *[("Shop.Log", "write", f"{USER}:{n}") for n in (6, 15)])
def _(p):
    from codequarry.operators.composite import reference_locations

    return reference_locations(p.r, p.rows([("Shop.Log", "write")], "module string, function string"))


@fixture("dependency_files", "path", ("a/deps/x/lib/x.ex",), ("a/apps/b/deps/y.ex",))
def _(p):
    from codequarry.sources.files import dependency_files

    paths = [("a/deps/x/lib/x.ex",), ("a/lib/deps/z.ex",), ("a/apps/b/deps/y.ex",), ("c/deps/w.ex",), ("top.ex",)]
    return dependency_files(p.rows(paths, "path string"), p.rows([("a/mix.exs",), ("a/apps/b/mix.exs",), ("a/deps/x/mix.exs",), ("c/other",)], "path string"))


@fixture("nearest_roots", "path, root", ("a/deps/x/lib/x.ex", "a/deps/x"), ("a/lib/z.ex", "a"), ("c/w.ex", ""))
def _(p):
    from codequarry.sources.files import nearest_roots

    return nearest_roots(p.rows([("a/deps/x/lib/x.ex",), ("a/lib/z.ex",), ("c/w.ex",)], "path string"), p.rows([("a/mix.exs",), ("a/deps/x/mix.exs",)], "path string"))


@fixture("modules_on_lines", "file_path, line, module, own", (SCOPES, 1, "Shop.Scopes", "Shop.Scopes.X"), (SCOPES, 2, "Shop.Scopes.Inner", "Shop.Scopes.Inner.X"), (SCOPES, 5, "", "Shop.Scopes.X"), (SCOPES, 99, "", "Shop.Scopes.X"))
def _(p):
    from codequarry.lang.outline import Outline

    def rows(path, line):
        o = Outline(TEXTS[path])
        return [(o.module_on_line(line), o.resolved_self("__MODULE__.X", line))]

    return _mapped(p, [(SCOPES, n) for n in (1, 2, 5, 99)], "file_path string, line int", "module string, own string", rows)
