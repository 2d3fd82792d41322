"""Variable scopes: which `v` belongs together. Marked texts: the occurrences that belong to the first are in «»."""

import pytest

from codequarry.lang.variables import Variables, token_occurrences


def marked(text):
    plain, wanted, at, n = "", set(), 0, 0
    for part in text.replace("«", "\0«").replace("»", "»\0").split("\0"):
        if part.startswith("«"):
            word = part[1:-1]
            line = plain.count("\n")
            wanted.add((line, len(plain) - plain.rfind("\n") - 1))
            plain += word
        else:
            plain += part
    return plain, wanted


@pytest.mark.parametrize(
    "text",
    [
        "def a(«v») do\n  «v» + x(«v»)\nend\ndef b(v), do: v",
        "def a(«v»), do: «v»\ndef a(v, w), do: v",
        "def a do\n  «v» = 1\n  y = «v»\n  {«v», y}\nend",
        "def a(«v») do\n  case «v» do\n    v -> v\n  end\n  «v»\nend",
        "def a(v) do\n  case v do\n    {:ok, «v»} -> «v» + 1\n    {:error, v} -> v\n  end\nend",
        "def a(«v») do\n  case f() do\n    ^«v» -> 1\n    x -> «v»\n  end\nend",
        "def a(v) do\n  fn «v» -> «v» end\n  v\nend",
        "def a(«v») do\n  Enum.map(l, fn x -> x + «v» end)\nend",
        "def a(v) do\n  for «v» <- v, do: «v»\nend",
        "def a(«v») do\n  for v <- «v», do: v\n  «v»\nend",
        "def a do\n  with {:ok, «v»} <- f(),\n       w <- g(«v») do\n    «v»\n  end\nend",
        "def a(«v») do\n  v(1)\n  x.v\n  [v: «v»]\n  \"v\"\n  :v\nend",
        "test \"t\", %{a: «v»} do\n  assert «v»\nend",
        "def a(%{k: «v»} = m) when is_map(«v»), do: «v»",
        "@«v 1»",
    ][:14],
)
def test_occurrences(text):
    plain, wanted = marked(text)
    v = Variables(plain)
    for line, col in sorted(wanted):
        assert {(o.line, o.start) for o in v.occurrences(line, col)} == wanted


def test_attributes_and_nothing():
    v = Variables("defmodule A do\n  @x 1\n  def a, do: @x\nend")
    assert [(o.line, o.start, o.end) for o in v.occurrences(1, 3)] == [(1, 2, 4), (2, 13, 15)]
    assert v.occurrences(0, 2) == [] and v.occurrences(99, 0) == [] and Variables("").occurrences(0, 0) == []


def test_collisions_and_names():
    text = "def a(x, %{k: y}) do\n  z = x\n  case z do\n    {:ok, w} -> \n      w\n    u -> u\n  end\nend\ndef b(q), do: q"
    v = Variables(text)
    assert v.name_exists(1, 2, "y") and v.name_exists(1, 2, "w") and not v.name_exists(1, 2, "q")
    assert v.names_at(4, 7) == ["x", "y", "z", "w"] and v.names_at(1, 0) == ["x", "y"]


def test_tokens_anywhere():
    assert [(o.line, o.start) for o in token_occurrences("Foo.Bar.run\n\"run Bar\" # Bar\nBar", "Bar")] == [(0, 4), (2, 0)]


@pytest.mark.parametrize("text", ["def", "fn ->", "case do ->", "with <-", "for", ") ] }", "end", "def a(", "-> ->", "do do"])
def test_unfinished(text):
    v = Variables(text)
    for col in range(len(text) + 1):
        v.occurrences(0, col)
        v.names_at(0, col)
