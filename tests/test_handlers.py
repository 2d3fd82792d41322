"""Handlers for places in texts, on a small project."""

import pytest

from codequarry.operators import handlers as H
from codequarry.sources.facts import parse_facts, parsed_definitions, parsed_references

FILES = {
    "store.ex": "defmodule Shop.Store do\n  @limit 10\n  @type item :: map\n  @doc \"Fetches one.\"\n  @spec fetch(term, term) :: term\n  def fetch(id, opts \\\\ []), do: {id, opts, @limit}\n  def item(x), do: x\nend\n",
    "facade.ex": "defmodule Shop do\n  alias Shop.Store\n  defdelegate fetch(id), to: Store\n  def all do\n    Store.fetch(1)\n    helper(2)\n  end\n  defp helper(n), do: n\nend\n",
    "user.ex": "defmodule User do\n  alias Shop.Store, as: S\n  use Web\n  import Shop.Store\n  def go do\n    S.fetch(1, )\n    Shop.fetch(2)\n    tool(3)\n    item(4)\n    Stor\n    S.fe\n  end\nend\n",
    "web.ex": "defmodule Web do\n  defmacro __using__(_) do\n    quote do\n      import Web.Tools\n      @behaviour Web\n    end\n  end\n  @callback handle(term) :: term\nend\ndefmodule Web.Tools do\n  def tool(x), do: x\nend\n",
    "impl.ex": "defmodule Impl do\n  @behaviour Web\n  @impl true\n  def handle(x) do\n    x\n  end\nend\n",
}


@pytest.fixture(scope="module")
def world(spark):
    sources = spark.createDataFrame(list(FILES.items()), "path string, source_text string").persist()
    parsed = parse_facts(sources).persist()
    return H.Workspace(spark, parsed_definitions(parsed).persist(), parsed_references(parsed).persist(), sources)


def places(spark, *marks):
    """file, text that the cursor stands on, nth occurrence: the place of its first character."""
    rows = []
    for path, word, *more in marks:
        nth, shift = (more + [0, 0])[:2]
        at = -1
        for _ in range(nth + 1):
            at = FILES[path].index(word, at + 1)
        before = FILES[path][:at]
        rows.append((path, before.count("\n"), at - before.rfind("\n") - 1 + shift))
    return spark.createDataFrame(rows, "file_path string, line int, col int"), rows


def answers(df, rows):
    found = {}
    for r in df.collect():
        found.setdefault((r.file_path, r.line, r.col), set()).add((r.target_path, r.target_line))
    return [found.get(k, set()) for k in rows]


def test_definition(spark, world):
    p, rows = places(spark, ("user.ex", "fetch(1"), ("user.ex", "fetch(2"), ("user.ex", "tool"), ("user.ex", "item"), ("facade.ex", "helper"), ("store.ex", "@limit}"), ("user.ex", "Shop.fetch"), ("web.ex", "quote"))
    assert answers(H.definition(world, p), rows) == [
        {("store.ex", 6)}, {("store.ex", 6)}, {("web.ex", 11)}, {("store.ex", 7)}, {("facade.ex", 8)}, {("store.ex", 2)}, {("facade.ex", 1)}, set(),
    ]
    assert answers(H.definition(world, p, follow=False), rows)[1] == {("facade.ex", 3)}


def test_type_declaration_implementation(spark, world):
    p, rows = places(spark, ("user.ex", "item"), ("impl.ex", "x\n"), ("web.ex", "handle"), ("impl.ex", "Web"))
    assert answers(H.type_definition(world, p), rows)[0] == {("store.ex", 3)}
    assert answers(H.declaration(world, p), rows)[1] == {("web.ex", 8)}
    found = answers(H.implementation(world, p), rows)
    assert found[2] == {("impl.ex", 4)} and ("impl.ex", 1) in found[3]


def test_references(spark, world):
    p, rows = places(spark, ("store.ex", "fetch(id"), ("web.ex", "tool"))
    found = answers(H.references_at(world, p), rows)
    assert found[0] == {("facade.ex", 5), ("user.ex", 6), ("user.ex", 7)}
    assert ("user.ex", 8) in found[1] or found[1] == set()
    with_own = answers(H.references_at(world, p, declarations=True, stdlib_prefix="user"), rows)
    assert with_own[0] == {("facade.ex", 5), ("store.ex", 6)}


def test_hover_and_signatures(spark, world):
    p, rows = places(spark, ("user.ex", "fetch(1"))
    [h] = H.hover(world, p).collect()
    assert (h.signature, h.doc) == ("def fetch/2", "Fetches one.") and h.spec.startswith("@spec fetch(")
    p, rows = places(spark, ("user.ex", "1, )", 0, 3), ("user.ex", "3)"))
    found = {(r.line, r.function): (r.arity, r.argument, r.parameter) for r in H.signature_help(world, p).collect()}
    assert found == {(5, "fetch"): (2, 1, "opts"), (7, "tool"): (1, 0, "x")}


def test_completion_and_suggestions(spark, world):
    p, rows = places(spark, ("user.ex", "S.fe", 1, 4), ("user.ex", "tool", 0, 2), ("user.ex", "Stor\n", 0, 4), ("facade.ex", "helper", 0, 3))
    found = {}
    for r in H.completion(world, p).collect():
        found.setdefault((r.file_path, r.line, r.col), []).append(r.label)
    labels = [found.get(k, []) for k in rows]
    assert labels[0] == ["fetch/1", "fetch/2"] and labels[1] == ["tool/1"] and labels[3] == ["helper/1"]
    texts = spark.createDataFrame([("q.ex", "defmodule Q do\n  Store.x\nend")], "path string, source_text string")
    w = H.Workspace(spark, world.d, world.r, texts)
    ask = spark.createDataFrame([("q.ex", 1, 3)], "file_path string, line int, col int")
    assert [r.module for r in H.alias_suggestions(w, ask).collect()] == ["Shop.Store"]


def test_call_items_and_delegates(spark, world):
    p, rows = places(spark, ("user.ex", "fetch(2"))
    [c] = H.call_hierarchy_items(world, p).collect()
    assert (c.module, c.function, c.target_path) == ("Shop", "fetch", "facade.ex")
    [x] = H.delegates_resolved(world, p).collect()
    assert (x.target_module, x.n_hops) == ("Shop.Store", 1)


def test_places_that_are_nowhere(spark, world):
    p = spark.createDataFrame([("user.ex", 999, 0), ("nofile", 0, 0), ("user.ex", None, None), ("user.ex", 0, 999)], "file_path string, line int, col int")
    for handler in (H.definition, H.hover, H.signature_help, H.completion, H.references_at):
        handler(world, p).collect()


CHAINS = {
    "kit.ex": "defmodule Kit do\n  defmacro __using__(_) do\n    quote do\n      alias Deep.Thing\n      import Kit.Fns\n      def inline(x), do: x\n    end\n  end\nend\ndefmodule Kit.Fns do\n  def insert(x), do: x\nend\ndefmodule Deep.Thing do\n  def run(x), do: x\nend\n",
    "factory.ex": "defmodule Factory do\n  use Kit\nend\n",
    "client.ex": "defmodule Client do\n  import Factory\n  def go(arg) do\n    Factory.insert(1)\n    insert(2)\n    arg\n  end\nend\n",
    "user.ex": "defmodule User do\n  use Kit\n  def go do\n    Thing.run(1)\n    inline(2)\n  end\nend\n",
}


def test_use_chains_and_variables(spark):
    sources = spark.createDataFrame(list(CHAINS.items()), "path string, source_text string").persist()
    parsed = parse_facts(sources).persist()
    w = H.Workspace(spark, parsed_definitions(parsed).persist(), parsed_references(parsed).persist(), sources)
    rows = [("client.ex", 3, 13), ("client.ex", 4, 5), ("client.ex", 5, 5), ("user.ex", 3, 11), ("user.ex", 4, 5)]
    p = spark.createDataFrame(rows, "file_path string, line int, col int")
    assert answers(H.definition(w, p), rows) == [{("kit.ex", 11)}, {("kit.ex", 11)}, {("client.ex", 3)}, {("kit.ex", 14)}, {("kit.ex", 6)}]
    at = spark.createDataFrame([("user.ex", 3, 14)], "file_path string, line int, col int")
    assert {(r.module, r.function) for r in H.signature_help(w, at).collect()} == {("Deep.Thing", "run")}


def test_answers_of_repeated_definitions_are_not_shuffled(spark):
    # Places times definitions of one name: as many answers as the product, which are distinct without being compared.
    sources = spark.createDataFrame(
        [("user.ex", "defmodule User do\n  def go do\n" + "    Hot.run(1)\n" * 40 + "  end\nend\n")], "path string, source_text string"
    )
    hot = [("Hot", "run", 1, "def", n, f"hot{n % 5}.ex", "", "", "x") for n in range(1, 31)] + [("Hot", "", 0, "module", 1, f"hot{n}.ex", "", "", "") for n in range(5)]
    d = spark.createDataFrame(hot, "module string, function string, arity int, kind string, line int, file_path string, delegate_to string, delegate_as string, params string")
    w = H.Workspace(spark, d, parsed_references(parse_facts(sources)), sources)
    p = spark.createDataFrame([("user.ex", n, 8) for n in range(2, 42)] + [("user.ex", 2, 5)], "file_path string, line int, col int")
    found = H.definition(w, p)
    rows = found.collect()
    assert len(rows) == len(set(rows)) == 40 * 30 + 5
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # nothing is done to the joins' rows


def test_hover_looks_through_the_definitions_of_a_name_once(spark):
    calls = "defmodule User do\n  def go do\n" + "    Hot.run(1)\n" * 40 + "  end\nend\n"
    hot = [(f"hot{n}.ex", f"defmodule Hot do\n  def run(x), do: x\n  @doc \"Runs {n}.\"\n  def run(x, y), do: x\nend\n") for n in range(9)]
    sources = spark.createDataFrame([("user.ex", calls), *hot], "path string, source_text string")
    parsed = parse_facts(sources).persist()
    w = H.Workspace(spark, parsed_definitions(parsed), parsed_references(parsed), sources)
    p = spark.createDataFrame([("user.ex", n, 8) for n in range(2, 42)] + [("user.ex", 2, 5)], "file_path string, line int, col int")
    found = H.hover(w, p)
    rows = {tuple(r) for r in found.collect()}
    assert rows == {("user.ex", n, 8, "def run/2", "", "Runs 0.") for n in range(2, 42)} | {("user.ex", 2, 5, "module Hot", "", "")}
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # places meet one answer, after it was chosen
