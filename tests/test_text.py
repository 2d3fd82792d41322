"""Outline, use bodies and cursor questions, one small text each."""

import pytest

from codequarry.lang import cursor as C
from codequarry.lang.outline import Outline
from codequarry.lang.using import using_bodies

NESTED = "defmodule A do\n  alias X.Y\n  defmodule B do\n    alias P.{Q, R.S}\n    def b, do: 1\n  end\n  def a(x, y \\\\ 1) do\n    x\n  end\nend\n"


def test_scopes_and_aliases():
    o = Outline(NESTED)
    assert [o.module_at(n) for n in (1, 4, 6, 7, 10, 11)] == ["A", "A.B", "A.B", "A", "A", ""]
    assert o.alias_map() == {"Y": "X.Y", "Q": "P.Q", "S": "P.R.S"}
    assert o.alias_map(5) == {"Q": "P.Q", "S": "P.R.S"} and o.alias_map(8) == {"Y": "X.Y"}
    assert Outline("alias A.B\ndefmodule C do\n  x\nend").alias_map(3) == {}


def test_aliases_in_literals_and_strange_groups():
    assert Outline('x = "alias A.B"\n"""\nalias C.D\n"""\n# alias E.F\n').alias_map() == {}
    assert Outline("alias A.{B, def, C\n").alias_map() == {"B": "A.B", "C": "A.C"}
    assert Outline("alias A.B, as: C\nrequire D.E, as: F\nrequire G").alias_map() == {"C": "A.B", "F": "D.E"}


def test_imports_and_uses_with_options():
    o = Outline("alias My.Repo\nimport Ecto.Query, only: [from: 2]\nuse Web, :view\nuse Job,\n  repo: Repo,\n  n: 1, other: A.B\n")
    assert [m for m, *_ in o.imports] == ["Ecto.Query"]
    assert [(u.module, u.options) for u in o.resolved_uses()] == [("Web", {}), ("Job", {"repo": "My.Repo", "other": "A.B"})]


def test_buffer_functions():
    assert Outline(NESTED).buffer_functions() == [("b", 0, "def", "", 5), ("a", 1, "def", "x", 7), ("a", 2, "def", "x,y", 7)]
    o = Outline("defguard g(x) when x > 1\ndefdelegate d(a), to: B\ndefp p, do: 1\ndefp p, do: 2")
    assert [o.function_line(n) for n in ("g", "d", "p", "q")] == [1, 2, 3, 0]


def test_attributes():
    o = Outline("defmodule A do\n  @x 1\n  @doc \"d\"\n  def f, do: @y\n  @y [\n    1\n  ]\n  g(@z)\nend")
    assert [o.attribute_line(n) for n in ("x", "y", "z", "doc")] == [2, 5, 0, 0]
    assert C.attribute_at("  x = @abc + 1", 7) == "abc" and C.attribute_at("  x = @abc + 1", 10) == ""


def test_bare_calls():
    text = "defmodule A do\n  @spec run(1) :: 1\n  def run(x), do: run(x)\n  def y do\n    B.run(1)\n    z |> run\n    run()\n    :run\n    \"run()\"\n    run = 1\n  end\nend"
    assert Outline(text).bare_call_lines("run") == [3, 6, 7]


def test_docs():
    text = 'defmodule A do\n  @moduledoc """\n  About.\n  """\n  @doc "one"\n  @spec a(term) ::\n          term\n  def a(x), do: x\n\n  def b, do: 1\n\n  @doc false\n  @impl true\n  def c, do: 1\nend'
    o = Outline(text)
    assert o.moduledoc("A") == "About." and o.moduledoc("B") == ""
    assert o.doc_above(8) == ("one", "@spec a(term) ::\n          term") and o.doc_above(10) == ("", "") and o.doc_above(14) == ("", "")
    assert o.impl_above(14) == "true" and o.impl_above(8) == ""


def test_symbols_and_folds():
    o = Outline(NESTED)
    assert [(p, k, x) for _, p, k, x, *_ in o.symbols()] == [(-1, "module", "A"), (0, "module", "A.B"), (1, "def", "b/0"), (0, "def", "a/2")]
    assert o.folds() == [(1, 10, "block"), (3, 6, "block"), (7, 9, "block")]
    assert Outline('x = [\n  1\n]\ny = """\n a\n"""\nz = [1]').folds() == [(1, 3, "bracket"), (4, 6, "literal")]


def test_using_bodies():
    text = (
        "defmodule Web do\n  alias My.Helpers\n  defmacro __using__(opts) do\n    repo = Keyword.get(opts, :repo, My.Repo)\n    mod = Keyword.fetch!(opts, :mod)\n"
        "    {x, _} = Keyword.pop(opts, :x, X)\n    fixed = Some.Mod\n    extra()\n    quote do\n      import Helpers\n      use Other\n      alias My.{A, B}\n      import unquote(repo)\n      use unquote(mod)\n"
        "      import unquote(fixed)\n      def hello(a, b \\\\ 1), do: import Not.This\n      unquote(x)\n    end\n  end\n  defp extra do\n    quote do\n      import Extra\n      alias Deep.C\n    end\n  end\nend\n"
    )
    [(module, body)] = using_bodies(text)
    assert module == "Web"
    assert body.imports == ["Extra", "My.Helpers", "Some.Mod"] and body.uses == ["Other"]
    assert body.options == [("repo", "My.Repo", "import"), ("mod", "", "use")]
    assert [(f, a) for f, a, *_ in body.functions] == [("hello", 1), ("hello", 2)]
    assert body.aliases == {"C": "Deep.C", "A": "My.A", "B": "My.B"}
    assert ("import", 1, "My.Helpers", "", -1, "") in body.edges()


def test_case_templates_and_none():
    [(module, body)] = using_bodies("defmodule My.Case do\n  use ExUnit.CaseTemplate\n  using do\n    quote do\n      import My.Tools\n    end\n  end\nend")
    assert module == "My.Case" and body.imports == ["My.Tools"]
    assert using_bodies(None) == using_bodies("") == using_bodies("defmodule A do\nend") == []


@pytest.mark.parametrize(
    "text,col,whole,want",
    [
        ("  Foo.Bar.baz(1)", 11, False, ("Foo.Bar", "baz", 2, 13)),
        ("  Foo.Bar.baz(1)", 7, False, ("Foo.Bar", "", 2, 9)),
        ("  Foo.Bar.baz(1)", 3, False, ("Foo", "", 2, 5)),
        ("  Foo.Bar.baz(1)", 3, True, ("Foo.Bar", "baz", 2, 13)),
        ("valid?(x)", 2, False, ("", "valid?", 0, 6)),
        ("x |> Foo.go", 9, False, ("Foo", "go", 5, 11)),
        ('"Foo.bar"', 3, False, ("", "", 0, 0)),
        ("# Foo.bar", 4, False, ("", "", 0, 0)),
        (":atom", 2, False, ("", "", 0, 0)),
        (":lists.flatten(x)", 9, False, (":lists", "flatten", 0, 14)),
        ("", 0, False, ("", "", 0, 0)),
    ],
)
def test_expressions(text, col, whole, want):
    assert tuple(C.expression_at(text, 0, col, whole)) == want


def test_prefixes():
    assert C.completion_prefix("  MyApp.Han", 11) == ("MyApp.Han", False, 2)
    assert C.completion_prefix("  Foo.", 6) == ("Foo", True, 2)
    assert C.completion_prefix("  :lis", 6) == (":lis", False, 2)
    assert C.completion_prefix("  ", 2) == ("", False, 0) and C.completion_prefix("", 0) == ("", False, 0)
    assert C.after_pipe("x |> fo", 5) and not C.after_pipe("x = fo", 4)
    assert C.module_and_function("A.B.c") == ("A.B", "c") and C.module_and_function("x") == ("", "x") and C.module_and_function("") == ("", "")


def test_alias_groups():
    text = "alias A.{\n  B,\n  \n}\nx = %{\n  a: 1\n}"
    assert C.alias_group_parent(text, 2, 2) == "A" and C.alias_group_parent(text, 5, 3) == "" and C.alias_group_parent(text, 0, 2) == ""


@pytest.mark.parametrize(
    "text,want",
    [
        ("Foo.bar(1, |", ("Foo.bar", 1)), ("f(|", ("f", 0)), ("f(a, g(b), |", ("f", 2)), ("f(a, g(|", ("g", 0)), ("f(a, [1, |", ("f", 1)),
        ("f(%{a: 1, b: 2}, |", ("f", 1)), ("f(a) |", ("", 0)), ("x = |", ("", 0)), ("Repo.get User, |", ("Repo.get", 1)), ("plug :a, |", ("plug", 1)), ("if x, |", ("", 0)),
    ],
)
def test_calls(text, want):
    col = text.index("|")
    assert C.call_at(text.replace("|", ""), 0, col) == want


def test_token_columns():
    assert C.token_columns("run(run_x, run!, run)", "run") == [0, 17] and C.token_columns("é run", "run") == [3]
    assert C.function_token_columns("run: run, run :: x, run::y", "run") == [5, 10, 20] and C.token_columns("x", "") == []


def test_outlines_hold_every_table(spark):
    """Tables taken from stored rows of files are those taken from the texts."""
    from codequarry.plans.fixture_queries import TEXTS
    from codequarry.sources import text_tables as X

    texts = spark.createDataFrame([*sorted(TEXTS.items()), ("none.ex", None), ("empty.ex", "")], "path string, source_text string")
    rows = X.outlines(texts, tuple(X.TABLES)).persist()
    assert rows.count() == len(TEXTS) + 1
    key = lambda df: sorted(map(str, df.collect()))
    for name in X.TABLES:
        assert key(X.table(name, rows)) == key(X.table(name, texts)), name
        assert X.table(name, rows).columns == X.table(name, texts).columns
    rows.unpersist()
