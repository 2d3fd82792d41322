"""Use chains on a small fixture."""

import pytest
from pyspark.sql import functions as F

from codequarry.operators.graph import reachable
from codequarry.operators import injection as I
from codequarry.sources import text_tables as X
from codequarry.sources.facts import parse_facts, parsed_definitions

FILES = {
    "web.ex": "defmodule Web do\n  defmacro __using__(opts) do\n    repo = Keyword.get(opts, :repo, DefaultRepo)\n    quote do\n      import Early\n      import Late\n      import unquote(repo)\n      use Base\n      alias Deep.Thing\n      def inline(x), do: x\n    end\n  end\nend",
    "base.ex": "defmodule Base do\n  defmacro __using__(_) do\n    quote do\n      import BaseTools\n      use Web\n      alias Other.Thing\n      alias Other.Tool\n    end\n  end\n  @callback cb(term) :: term\nend",
    "tools.ex": "defmodule Early do\n  def both, do: 1\n  def early(x), do: x\nend\ndefmodule Late do\n  def both, do: 2\n  defp hidden, do: 1\nend\ndefmodule BaseTools do\n  def base, do: 1\nend\n"
    "defmodule DefaultRepo do\n  def all, do: 1\nend\ndefmodule MyRepo do\n  def all, do: 2\n  def one, do: 3\nend\ndefmodule Kernel do\n  def both, do: 0\n  def elem(a, b), do: 1\nend",
    "user.ex": "defmodule User do\n  use Web, repo: MyRepo\n  import Late\n  def run do\n    both()\n    base()\n    one()\n    elem(1, 2)\n    run()\n  end\nend",
    "plain.ex": "defmodule Plain do\n  use Web\nend",
}


@pytest.fixture(scope="module")
def world(spark):
    sources = spark.createDataFrame(list(FILES.items()), "path string, source_text string").persist()
    d = parsed_definitions(parse_facts(sources)).persist()
    edges = X.using_edges(sources).persist()
    uses = X.uses(sources).where("file_path IN ('user.ex', 'plain.ex')").select(F.col("file_path").alias("seed"), F.col("used").alias("module"), "ordinal", "options")
    seen = I.visits(spark, edges, uses).persist()
    return sources, d, edges, seen


def test_visits_end_in_cycles(world):
    seen = {(r.seed, r.module): r.path for r in world[3].collect()}
    assert set(seen) == {("user.ex", "Web"), ("user.ex", "Base"), ("plain.ex", "Web"), ("plain.ex", "Base")}
    assert seen["user.ex", "Web"] == [0] and seen["user.ex", "Base"] == [0, 3, 0]


def test_lookup_order(spark, world):
    _, d, edges, seen = world
    offered = I.providers(edges, seen)
    asked = spark.createDataFrame([(s, f) for s in ("user.ex", "plain.ex") for f in ("both", "early", "base", "all", "one", "inline", "nope")], "seed string, function string")
    found = {(r.seed, r.function): (r.provider, r.origin) for r in I.lookup_through_use(d, offered, asked).collect()}
    assert found["user.ex", "both"] == ("Late", "import") and found["user.ex", "early"] == ("Early", "import")
    assert found["user.ex", "base"] == ("BaseTools", "import") and found["user.ex", "inline"] == ("Web", "inline")
    assert found["user.ex", "all"] == ("MyRepo", "option_import") and found["plain.ex", "all"] == ("DefaultRepo", "option_import")
    assert ("plain.ex", "one") not in found and ("user.ex", "nope") not in found
    without = {r.function for r in I.lookup_through_use(d, I.providers(edges, seen, inline=False), asked).collect()}
    assert "inline" not in without


def test_aliases_callbacks_completions(spark, world):
    _, d, edges, seen = world
    injected = I.injected_aliases(edges, seen).where("seed = 'user.ex'")
    assert {r.short: r.full for r in injected.collect()} == {"Thing": "Deep.Thing", "Tool": "Other.Tool"}
    own = spark.createDataFrame([("user.ex", "Tool", "Own.Tool")], "seed string, short string, full string")
    assert {r.short: r.full for r in I.merged_aliases(own, injected).collect()} == {"Thing": "Deep.Thing", "Tool": "Own.Tool"}
    assert [(r.module, r.function, r.arity) for r in I.callbacks_in_chain(d, seen).where("seed = 'plain.ex'").collect()] == [("Base", "cb", 1)]
    labels = {(r.function, r.arity): r.provider for r in I.completions_from_using(d, I.providers(edges, seen)).where("seed = 'user.ex'").collect()}
    assert labels == {("inline", 1): "Web", ("both", 0): "Late", ("early", 1): "Early", ("base", 0): "BaseTools", ("all", 0): "MyRepo", ("one", 0): "MyRepo"}


def test_injecting_modules(spark, world):
    found = I.injecting_modules(spark, world[2], spark.createDataFrame([("BaseTools",), ("Late",), ("Nobody",)], "seed string"))
    assert {(r.seed, r.node): r.depth for r in found.collect()} == {("BaseTools", "Base"): 1, ("BaseTools", "Web"): 2, ("Late", "Web"): 1, ("Late", "Base"): 2}


def test_bare_functions(spark, world):
    sources, d, edges, seen = world
    calls = X.bare_calls(sources).where("file_path = 'user.ex'").select(F.col("file_path").alias("seed"), "function").distinct()
    from codequarry.operators.links import function_module_in_file

    probes = X.bare_calls(sources).where("file_path = 'user.ex'")
    here = function_module_in_file(d, probes).select(F.col("file_path").alias("seed"), "function", "module")
    imports = X.imports(sources).select(F.col("file_path").alias("seed"), "imported", "ordinal")
    used = I.lookup_through_use(d, I.providers(edges, seen), calls)
    found = {r.function: r.module for r in I.bare_function_module(d, calls, here, imports, used).collect()}
    assert found == {"both": "Late", "base": "BaseTools", "one": "MyRepo", "elem": "Kernel", "run": "User"}


def test_text_tables(world):
    sources = world[0]
    assert {(r.module, r.first_line, r.last_line) for r in X.scopes(sources).where("file_path = 'base.ex'").collect()} == {("Base", 1, 11)}
    assert X.aliases(sources).count() == 3 and X.folds(sources).count() > 5 and X.symbols(sources).where("parent >= 0").count() > 5
    assert X.buffer_functions(sources).where("function = 'elem'").collect()[0].params == "a,b"
    assert X.functions(sources).where("function = 'run'").collect()[0].last_line == 10
    assert X.docs(sources).count() == 0 and X.impl_annotations(sources).count() == 0


def test_reachable_walks_until_nothing_is_new(spark):
    edges = spark.createDataFrame([(f"M{i + 1}", f"M{i}") for i in range(55)], "module string, used string").coalesce(1)
    found = reachable(spark, edges, spark.createDataFrame([("M0",)], "seed string").coalesce(1))
    assert {(r.node, r.depth) for r in found.collect()} == {(f"M{i}", i) for i in range(56)}
