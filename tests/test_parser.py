"""The rules of the parser, one small text each."""

import os

import duckdb
import pytest

from codequarry.lang.parser import facts, resolve_alias

SF = "/root/testdata/sf0.01"


def defs(text):
    return [(d.module, d.function, d.arity, d.kind, d.line) for d in facts(text)[0]]


def refs(text):
    return [(r.module, r.function, r.line, r.kind) for r in facts(text)[1]]


def test_modules_nest_and_end():
    text = "defmodule A do\n  defmodule B do\n    def x, do: 1\n  end\n  def y do\n    1\n  end\nend\ndef z, do: 1\n"
    assert defs(text) == [("A", "", 0, "module", 1), ("A.B", "", 0, "module", 2), ("A.B", "x", 0, "def", 3), ("A", "y", 0, "def", 5)]


def test_dotted_names_are_not_prefixed_and_one_liners_open_nothing():
    text = "defmodule A do\n  defmodule B.C, do: nil\n  defimpl P, for: D do\n    def p(x), do: x\n  end\nend"
    assert defs(text) == [("A", "", 0, "module", 1), ("B.C", "", 0, "module", 2), ("A.P", "", 0, "defimpl", 3), ("A.P", "p", 1, "def", 4)]


def test_do_on_the_next_line():
    assert defs("defmodule A\ndo\n  def x, do: 1\nend") == [("A", "", 0, "module", 1), ("A", "x", 0, "def", 3)]


def test_defaults_expand_arities_and_params_are_named():
    found = facts("defmodule A do\n  def f(a, %{b: 1} = c, _, [h | t], d \\\\ 1, e \\\\ 2), do: 1\nend")[0][1:]
    assert [(d.arity, d.params) for d in found] == [(4, "a,c,arg3,arg4"), (5, "a,c,arg3,arg4,d"), (6, "a,c,arg3,arg4,d,e")]


def test_heads_over_many_lines():
    assert defs("defmodule A do\n  def f(\n    a,\n    b\n  ) do\n    a\n  end\n  def g, do: 1\nend")[1:] == [("A", "f", 2, "def", 2), ("A", "g", 0, "def", 8)]


def test_kinds():
    text = (
        "defmodule A do\n @type t(a) :: a\n @typep u :: 1\n @opaque o :: 1\n @callback c(x) :: 1\n @macrocallback m(x, y) :: 1\n"
        " defstruct [:a]\n defexception [:b]\n defguard g(x) when x\n defmacrop p(x), do: x\n defguardp q(x) when x\nend"
    )
    assert [(f, a, k) for _, f, a, k, _ in defs(text)[1:]] == [
        ("t", 1, "type"), ("o", 0, "opaque"), ("c", 1, "callback"), ("m", 2, "macrocallback"), ("__struct__", 0, "defstruct"),
        ("__exception__", 0, "defexception"), ("g", 1, "defguard"), ("p", 1, "defmacrop"), ("q", 1, "defguardp"),
    ]


def test_delegates():
    text = "defmodule A do\n  alias X.Y\n  defdelegate a(x), to: Y\n  defdelegate b(), to: Y.Z, as: :c\n  defdelegate d(x),\n    to: __MODULE__.E\n  def n, do: 1\nend"
    assert [(d.function, d.delegate_to, d.delegate_as) for d in facts(text)[0][1:]] == [("a", "X.Y", ""), ("b", "X.Y.Z", "c"), ("d", "A.E", ""), ("n", "", "")]


def test_literals_hold_no_facts():
    text = 'defmodule A do\n  @doc """\n  def no, do: Foo.bar()\n  """\n  def yes, do: "Foo.bar #{1}"\n  ~S(Foo.x)\nend'
    assert [f for _, f, *_ in defs(text)] == ["", "yes"] and refs(text) == []


def test_calls_structs_and_mentions():
    text = "defmodule A do\n  alias B.C\n  def f(x), do: C.run(%D.E{a: 1}, F, A, x.y)\nend"
    assert refs(text) == [("B.C", "", 2, "alias"), ("B.C", "run", 3, "call"), ("D.E", "", 3, "call"), ("F", "", 3, "call")]


def test_directives():
    text = "defmodule A do\n  alias B.{C, D.E}\n  alias F.G, as: H\n  import I, only: [a: 1]\n  use J, k: L\n  require M, as: N\n  @behaviour O\n  H.x\n  E.y\n  N.z\n  alias __MODULE__.P\nend"
    assert refs(text) == [
        ("B.C", "", 2, "alias"), ("B.D.E", "", 2, "alias"), ("F.G", "", 3, "alias"), ("I", "", 4, "import"), ("J", "", 5, "use"),
        ("L", "", 5, "call"), ("M", "", 6, "require"), ("O", "", 7, "behaviour"), ("O", "", 7, "call"), ("F.G", "x", 8, "call"),
        ("B.D.E", "y", 9, "call"), ("M", "z", 10, "call"), ("A.P", "", 11, "alias"),
    ]


def test_directives_do_not_go_through_aliases():
    assert refs("defmodule A do\n  alias B.C\n  import C\nend")[1] == ("C", "", 3, "import")


def test_aliases_end_with_their_module():
    text = "defmodule A do\n  alias X.Y\n  defmodule B do\n    alias P.Y\n    Y.a\n  end\n  Y.b\nend"
    assert [r[:2] for r in refs(text) if r[3] == "call"] == [("P.Y", "a"), ("X.Y", "b")]


def test_bare_calls_need_an_injector():
    body = "\n  plug :x\n  field(1)\n  scope 1, 2 do\n  end\n  a = b\n  x |> y\n  if z do\n  end\nend"
    assert refs("defmodule A do" + body) == []
    assert [r for r in refs("defmodule A do\n  import I\n  use U" + body) if r[3] == "call"] == [
        (m, f, line, "call") for f, line in [("plug", 4), ("field", 5), ("scope", 6), ("y", 9)] for m in ("I", "U")
    ]


def test_resolution():
    assert resolve_alias("A.B", {"A": "X.A"}) == "X.A.B" and resolve_alias("A.B", {"A.B": "Q"}) == "Q"
    assert resolve_alias("__MODULE__", {}) == "" and resolve_alias("__MODULE__.C", {}, "M") == "M.C"


@pytest.mark.parametrize("text", [None, "", "end end", "defmodule", "defmodule A do", "def", "alias", "alias A.{", "@type", "defmodule A do\n defdelegate a(", "%", "|>"])
def test_unfinished_code(text):
    facts(text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_round_trip_with_the_stored_facts():
    """Parsing the source texts gives every current definition and reference that the tables have of these files."""
    con = duckdb.connect()
    texts = dict(con.execute(f"SELECT path, source_text FROM '{SF}/sources.parquet' WHERE source_text IS NOT NULL").fetchall())
    stored: dict = {p: set() for p in texts}
    rows = con.execute(f"SELECT file_path, regexp_replace(trim(module, ' \t'), '^Elixir.', ''), trim(coalesce(function, ''), ' \t'), line, kind FROM '{SF}/refs.parquet'")
    for p, *r in rows.fetchall():
        if p in stored:
            stored[p].add(tuple(r))
    n = missing = 0
    for p, text in texts.items():
        n += len(stored[p])
        missing += len(stored[p] - set(refs(text)))
    assert n > 5000 and missing <= n * 0.001
