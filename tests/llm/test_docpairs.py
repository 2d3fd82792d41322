import datetime as dt

import pytest

from codequarry.llm.docpairs import documented_functions, informative, pairs, says_something


def docs(text):
    return {(p["function"], p["line"]): p["doc"] for p in pairs(text)}


def test_doc_attributes_of_all_forms():
    text = (
        'defmodule A do\n  @doc "one"\n  def a, do: 1\n\n  @doc """\n  two\n    more\n  """\n  @spec b(term()) :: term()\n  def b(x) do\n    x\n  end\n'
        '  @doc ~S|three|\n  def c, do: 1\n  @doc "fo" <>\n    "ur"\n  def d, do: 1\n  @doc since: "1"\n  def e, do: 1\nend'
    )
    assert docs(text) == {("a", 3): "one", ("b", 10): "two\n  more", ("c", 14): "three", ("d", 17): "four", ("e", 19): None}


def test_the_last_text_counts_and_false_is_none():
    assert docs('@doc "a"\n@doc "b"\n@doc since: "1"\ndef x, do: 1\n@doc "a"\n@doc false\ndef y, do: 1') == {("x", 4): "b", ("y", 7): None}


def test_comments_directly_above():
    text = "# one\n# two\ndef a, do: 1\n\n# far\n\ndef b, do: 1\n\n# over\n@spec c() :: 1\ndef c, do: 1\nx = 1 # not own\ndef d, do: 1\n@doc \"doc\"\n# not this\ndef e, do: 1"
    assert docs(text) == {("a", 3): "one\ntwo", ("b", 7): None, ("c", 11): "over", ("d", 13): None, ("e", 16): "doc"}


def test_only_the_first_clause_and_whole_bodies():
    text = "defmodule A do\n  # doc\n  def f(1) do\n    fn -> case 1 do\n      _ -> :ok\n    end end\n  end\n  def f(x), do: x\n  def g, do: 1\nend"
    found = list(pairs(text))
    assert [(p["function"], p["line"], p["module"]) for p in found] == [("f", 3, "A"), ("g", 9, "A")]
    assert found[0]["code"].endswith("def f(x), do: x") and "end end\n  end" in found[0]["code"]


def test_strings_comments_and_other_line_ends():
    text = '﻿defmodule A do\r\n  @doc "real"\r\n  def a do\r\n    x = """\r\n    @doc "fake"\r\n    def no, do: 1\r\n    """\r\n    # @doc "no"\r\n  end\r\n  def b, do: 1\r\nend\r\n'
    assert docs(text) == {("a", 3): "real", ("b", 10): None}


def test_docs_do_not_pass_over_other_things():
    assert docs('defmodule A do\n  @doc "cb"\n  @callback x(term) :: term\n  def y, do: 1\nend\n@doc "m"\ndefmodule B do\n  def z, do: 1\nend') == {("y", 4): None, ("z", 8): None}


@pytest.mark.parametrize("text", ["", "def", "@doc", "def f(", '@doc "', "defmodule", "end end", "@doc\ndef x", "fn -> ->", "def f do"])
def test_unfinished_code(text):
    list(pairs(text))


@pytest.mark.parametrize(
    "doc",
    ["", "  ", "TODO", "todo: write docs", "TBD", "n/a", "...", "?", "Documentation to follow", "No documentation.", "Beschreibung fehlt noch",
     "pendiente de documentar", "(no description available at this time)", "The `load_item` function.", "load_item/2", "load_item(a, b)",
     "Loads the item.", "Load item with `a` and `b`.", "LOAD ITEM", "This function will load the item.", "## Notes", "This is the function `load_item`, which takes no arguments."],
)
def test_says_nothing(doc):
    assert not informative(doc, "load_item", ["a", "b"])


@pytest.mark.parametrize("doc", ["Raises when offline.", "O(n) in the size.", "`load_item/2`: keeps at most 3 of them.", "TODO\n\nTimes are in UTC.", "Gibt bei Leerlauf `nil` zurück.", "Nunca modifica la entrada."])
def test_says_something(doc):
    assert informative(doc, "load_item", ["a", "b"])


@pytest.mark.parametrize("comment", ["-----", "coveralls-ignore-start", "lint:disable-next-line X", "dialyzer: no_match", "def old(a), do: a", "x = f(1)", "end"])
def test_comments_that_are_none(comment):
    assert not says_something(comment, "f", [], comment=True)


def test_table(spark):
    schema = "path string, source_text string, read_at timestamp, s string"
    t = dt.datetime(2024, 1, 1)
    good = "# Raises when offline.\ndef a, do: 1\n# Drops it.\ndefmacrop hidden, do: 1"
    rows = [("p", good, t, ""), ("p", "def a, do: 1", t - dt.timedelta(1), ""), ("q", None, t, ""), (None, good, t, ""), ("r", "", t, ""), ("l", "x\n" * 50_000 + good, None, "")]
    found = documented_functions(spark.createDataFrame(rows, schema))
    assert sorted((r.path, r.line, r.doc) for r in found.collect()) == [("l", 50002, "Raises when offline."), ("p", 2, "Raises when offline.")]
    assert documented_functions(spark.createDataFrame([], schema)).count() == 0
