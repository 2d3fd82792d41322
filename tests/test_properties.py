"""Readers of texts end, without errors, on any text; tokens and edits keep their invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.functions.edits import apply_edit, minimal_edit
from codequarry.lang import cursor as C
from codequarry.lang.lexer import tokenize
from codequarry.lang.outline import Outline
from codequarry.lang.parser import facts
from codequarry.lang.using import using_bodies
from codequarry.lang.variables import Variables

PIECES = st.sampled_from(
    ["defmodule ", "A.B", " do\n", "end\n", "def f", "(x, y \\\\ 1)", ", do: ", "\n", "alias A.{B, C}\n", "use W, k: V\n", "@doc ", '"a#{', "}", '"', '"""\n', "~s(", ")", "fn ", "-> ",
     "case x", "with a <- b", "defmacro __using__(o)", "quote", "import unquote(z)", "x = Keyword.get(o, :k, D)\n", "# c\n", "|> g()", "%M{", "<<", ">>", "?", ":", "^x", "é", "\r\n", "@x 1\n", "helper()\n"]
)
TEXTS = st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=25).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_tokens_are_in_order_and_leave_out_blanks_only(text):
    tokens = tokenize(text, comments=True)
    at = 0
    for t in tokens:
        assert at <= t.start < t.end <= len(text)
        assert not text[at : t.start].strip(" \t\r\f\v﻿")
        at = t.end
    assert [t.line for t in tokens] == sorted(t.line for t in tokens)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_readers_end(text):
    facts(text)
    using_bodies(text)
    o = Outline(text)
    o.symbols(), o.folds(), o.resolved_uses(), o.buffer_functions(), o.bare_call_lines("f")
    v = Variables(text)
    for line in range(text.count("\n") + 1):
        o.module_at(line + 1), o.alias_map(line + 1), o.doc_above(line + 1), o.impl_above(line + 1)
        for col in (0, 3, 9):
            C.expression_at(o.t, line, col), C.call_at(o.t, line, col), C.alias_group_parent(o.t, line, col)
            v.occurrences(line, col), v.names_at(line, col)


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=20), st.text("ab\n", max_size=20))
def test_minimal_edits_give_the_new_text(old, new):
    assert apply_edit(old, minimal_edit(old, new)) == new
