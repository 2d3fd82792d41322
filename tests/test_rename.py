"""Renames as edits, and the functions on edits."""

import os

import pytest

from codequarry.functions import edits as E
from codequarry.operators import rename as R
from codequarry.operators.handlers import Workspace
from codequarry.sources.facts import parse_facts, parsed_definitions, parsed_references

FILES = {
    "lib/shop/store.ex": "defmodule Shop.Store do\n  @spec fetch(term) :: term\n  def fetch(x), do: fetch(x, 1)\n  def fetch(x, y), do: {x, y}\nend\n",
    "lib/facade.ex": "defmodule Facade do\n  alias Shop.Store\n  defdelegate fetch(x), to: Store\n  defdelegate get(x), to: Shop.Store, as: :fetch\nend\n",
    "lib/user.ex": "defmodule User do\r\n  import Shop.Store, only: [fetch: 1]\r\n  alias Shop.{Store, Other}\r\n  def go(é, b) do\r\n    é |> fetch()\r\n    Store.fetch(b, fetch: 1)\r\n  end\r\nend\r\n",
    "lib/other.ex": "defmodule Shop.Other do\n  def fetch(x), do: x\nend\ndefmodule Taken.Store do\nend\n",
}


@pytest.fixture(scope="module")
def world(spark):
    sources = spark.createDataFrame(list(FILES.items()), "path string, source_text string").persist()
    parsed = parse_facts(sources).persist()
    return Workspace(spark, parsed_definitions(parsed).persist(), parsed_references(parsed).persist(), sources)


def after(w, edits):
    return {r.path: r.source_text for r in R.apply_edits(w.sources, edits).collect()}


def test_rename_function(spark, world):
    new = after(world, R.rename_functions(world, spark.createDataFrame([("Shop.Store", "fetch", "load")], "module string, function string, new_name string")))
    assert new["lib/shop/store.ex"] == FILES["lib/shop/store.ex"].replace("fetch", "load")
    assert new["lib/facade.ex"] == FILES["lib/facade.ex"].replace("to: Store\n", "to: Store, as: :load\n").replace("as: :fetch", "as: :load")
    assert new["lib/user.ex"] == FILES["lib/user.ex"].replace("only: [fetch", "only: [load").replace("|> fetch", "|> load").replace("Store.fetch(b", "Store.load(b")
    assert "lib/other.ex" not in new
    bad = spark.createDataFrame([("Shop.Store", "fetch", "Not Valid")], "module string, function string, new_name string")
    assert R.rename_functions(world, bad).count() == 0


def test_rename_module_and_moves(spark, world):
    names = spark.createDataFrame([("Shop", "Market")], "old_prefix string, new_prefix string")
    new = after(world, R.rename_modules(world, names))
    assert new["lib/shop/store.ex"].startswith("defmodule Market.Store do") and "alias Market.Store" in new["lib/facade.ex"]
    assert "to: Market.Store, as: :fetch" in new["lib/facade.ex"] and "import Market.Store, only" in new["lib/user.ex"]
    one = spark.createDataFrame([("Shop.Store", "Shop.Depot")], "old_prefix string, new_prefix string")
    assert [tuple(r) for r in R.file_moves(world, one).collect()] == [("lib/shop/store.ex", "lib/shop/depot.ex")]
    assert "Depot.fetch(b" in after(world, R.rename_modules(world, one))["lib/user.ex"]
    clash = spark.createDataFrame([("Shop.Store", "Taken.Store"), ("User", "not a name")], "old_prefix string, new_prefix string")
    assert R.rename_modules(world, clash).count() == 0


def test_variables(spark, world):
    at = [("lib/user.ex", 3, 9, "wert"), ("lib/user.ex", 3, 12, "é"), ("lib/shop/store.ex", 2, 12, "y"), ("lib/shop/store.ex", 3, 12, "y"), ("lib/user.ex", 99, 0, "a")]
    places = spark.createDataFrame(at, "file_path string, line int, col int, new_name string")
    new = after(world, R.rename_variables(world.sources, places))
    assert new["lib/user.ex"] == FILES["lib/user.ex"].replace("é", "wert")
    assert new["lib/shop/store.ex"] == FILES["lib/shop/store.ex"].replace("fetch(x), do: fetch(x, 1)", "fetch(y), do: fetch(y, 1)")
    assert {r.name for r in R.variables_in_scope(world.sources, places.limit(1)).collect()} <= {"é", "b"}
    assert R.highlights(world, spark.createDataFrame([("lib/facade.ex", 1, 8)], "file_path string, line int, col int")).count() >= 2


def test_prepare(spark, world):
    places = spark.createDataFrame([("lib/user.ex", 3, 9), ("lib/user.ex", 5, 10), ("lib/user.ex", 5, 5), ("lib/user.ex", 7, 0)], "file_path string, line int, col int")
    found = {(r.line, r.col): (r.target, r.name) for r in R.prepare_rename(world, places).collect()}
    assert found == {(3, 9): ("variable", ""), (5, 10): ("function", "Shop.Store.fetch"), (5, 5): ("module", "Shop.Store")}
    assert R.prepare_rename(world, places, foreign="^lib/shop").count() == 1


def test_writing(spark, tmp_path):
    path = str(tmp_path / "a.ex")
    texts = spark.createDataFrame([(path, "new\r\n")], "path string, source_text string")
    moves = spark.createDataFrame([(path, str(tmp_path / "deep" / "b.ex"))], "old_path string, new_path string")
    assert R.write_texts(texts, moves) == 1
    assert not os.path.exists(path) and (tmp_path / "deep" / "b.ex").read_bytes() == b"new\r\n"


@pytest.mark.parametrize("old,new", [("a\nb\nc", "a\nx\nc"), ("a", "a\nb"), ("a\nb\nc", "a\nc"), ("", "x"), ("x", ""), ("a\na\na", "a\na"), ("a\n\nb", "a\nb"), ("same", "same")])
def test_minimal_edits(old, new):
    edit = E.minimal_edit(old, new)
    assert E.apply_edit(old, edit) == new
    assert (edit is None) == (old == new)


def test_formatter_messages():
    assert E.format_error("** (TokenMissingError) lib/a.ex:12:5: missing end\nhint: it looks like") == (12, 5, "missing end", "it looks like")
    assert E.format_error("nofile:3: syntax error") == (3, 0, "syntax error", "") and E.format_error("odd") == (0, 0, "odd", "")


def test_delegate_statements():
    assert E.with_delegate_as("defdelegate a(x), to: B", "c") == "defdelegate a(x), to: B, as: :c"
    assert E.with_delegate_as("defdelegate a(x), to: B, as: :d", "c") == "defdelegate a(x), to: B, as: :c"
    assert E.with_delegate_as("defdelegate a(x), as: :d, to: B", "") == "defdelegate a(x), to: B"
    text = "defmodule A do\n  defdelegate a(x),\n    to: B\n  def b, do: 1\nend"
    lo, hi = E.delegate_span(text, 2)
    assert text[lo:hi] == "defdelegate a(x),\n    to: B" and E.delegate_span(text, 4) == (0, 0)


def test_hover_text():
    assert E.hover_text("def a/1", "  @spec a(x)\n    :: y", " Doc. ") == "```elixir\ndef a/1\n@spec a(x)\n  :: y\n```\n\nDoc."
    assert E.hover_text("", "", "") == ""


def test_quoted_text_and_signatures():
    assert [E.quoted_text(x) for x in ('"a \\" b" c', '"open', "none", '""')] == ['a \\" b', "", "", ""]
    lines = ["  def a(x),", "def b(y) do", "   ", "def c, do: 1"]
    assert [E.signature_line(lines, n) for n in range(6)] == ["", "def a(x)", "def b(y)", "", "def c, do: 1", ""]
    assert E.dedent("    a\n\n      b\n") == "a\n\n  b"
