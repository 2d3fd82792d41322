"""Lexer for Elixir source text: a state machine over one compiled pattern.

Strings, heredocs, sigils and quoted atoms are opaque tokens; interpolation is followed through nested literals, so
that a quote inside `#{...}` does not end the literal. Nothing here raises: an unterminated literal runs to the end
of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    start: int
    end: int
    line: int


# The words the lexer tells apart from ordinary identifiers.
KEYWORDS = frozenset(
    "do end fn def defp defmacro defmacrop defguard defguardp defdelegate defmodule defprotocol defimpl defstruct "
    "defexception alias import use require".split()
)
DEF_WORDS = ("def", "defp", "defmacro", "defmacrop", "defguard", "defguardp", "defdelegate")
MODULE_WORDS = ("defmodule", "defprotocol", "defimpl")
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}

_MAIN = re.compile(
    r"""[ \t\r\f\v﻿]*+(?:
    (?P<eol>\n)
  | (?P<comment>\#[^\n]*)
  | (?P<heredoc>\"\"\"|''')
  | (?P<string>["'])
  | (?P<sigil>~(?:[a-z]|[A-Z][A-Z0-9]*)(?:\"\"\"|'''|["'/|(\[{<]))
  | (?P<char>\?(?:\\x\{[0-9a-fA-F]+\}|\\x[0-9a-fA-F]{1,2}|\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4}|\\.|[^\s\\]))
  | (?P<qatom>:["'])
  | (?P<colons>::)
  | (?P<atom>:(?:[^\W\d][\w@]*[?!]?|<<>>|%\{\}|\{\}|\.\.\.|\.\.//|\.\.|[-+*/<>=!&|^~.]+))
  | (?P<attr>@[a-z_]\w*[?!]?)
  | (?P<number>\d(?:_?[0-9a-zA-Z])*(?:\.\d[\d_]*(?:[eE][-+]?\d+)?)?)
  | (?P<word>[^\W\d]\w*[?!]?)
  | (?P<op>\|>|\\\\|->|<-|=>|<<<|>>>|<<|>>|<>|\.\.\.|\.\.|===|!==|==|!=|=~|<=|>=|&&&|\|\|\||&&|\|\||\+\+|--|[-+*/<>=!&|^~%.,;()\[\]{}@:\\])
  | (?P<other>.)
    )""",
    re.VERBOSE | re.DOTALL,
)
# The fast way over a literal's inside: anything that cannot end it or nest in it.
_PLAIN = {q: re.compile(rf"[^{re.escape(q)}\\#]+") for q in "\"'/|)]}>"}


def _interpolation(text: str, at: int) -> int:
    """End of an interpolation whose `#{` ends at `at`: the place after its closing brace."""
    depth, n = 1, len(text)
    while at < n:
        c = text[at]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at + 1
        elif c in "\"'":
            at = _heredoc(text, at + 3, text[at : at + 3]) if text[at : at + 3] in ('"""', "'''") else _quoted(text, at + 1, c)
            continue
        elif c == "~":
            m = _MAIN.match(text, at)
            if m and m.lastgroup == "sigil":
                at = _sigil(text, m)
                continue
        elif c == "?" and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            m = _MAIN.match(text, at)
            if m and m.lastgroup == "char":
                at = m.end()
                continue
        at += 1
    return n


def _quoted(text: str, at: int, close: str, open_: str = "", raw: bool = False) -> int:
    """End of a literal whose inside starts at `at` and that ends with `close`."""
    n, depth = len(text), 1
    plain = _PLAIN.get(close) if not open_ else None
    while at < n:
        if plain and (m := plain.match(text, at)):
            at = m.end()
            continue
        c = text[at]
        if c == "\\" and not (raw and text[at + 1 : at + 2] != close):
            at += 2
        elif c == "#" and not raw and text.startswith("#{", at):
            at = _interpolation(text, at + 2)
        elif c == close:
            depth -= 1
            at += 1
            if not depth:
                return at
        else:
            depth += bool(open_) and c == open_
            at += 1
    return n


def _heredoc(text: str, at: int, quote: str, raw: bool = False) -> int:
    """End of a heredoc: its quote at the start of a line, after blanks."""
    n = len(text)
    while at < n:
        stop = text.find("\n", at)
        if stop < 0:
            return n
        if not raw:
            hash_at = text.find("#{", at, stop)
            while 0 <= hash_at and text[hash_at - 1] == "\\" and hash_at > at:
                hash_at = text.find("#{", hash_at + 2, stop)
            if hash_at >= 0:
                at = _interpolation(text, hash_at + 2)
                continue
        at = stop + 1
        first = at
        while first < n and text[first] in " \t":
            first += 1
        if text.startswith(quote, first):
            return first + 3
    return n


def _sigil(text: str, m: re.Match) -> int:
    head = m["sigil"]
    raw = head[1].isupper()
    if head.endswith(('"""', "'''")):
        at = _heredoc(text, m.end(), head[-3:], raw)
    else:
        opening = head[-1]
        closing = _CLOSING.get(opening, opening)
        at = _quoted(text, m.end(), closing, opening if closing != opening else "", raw)
    while at < len(text) and text[at].isalpha():
        at += 1
    return at


def tokenize(text: str, comments: bool = False) -> list[Token]:
    """The tokens of a text; offsets are characters, lines count from 1.

    Kinds: eol, comment (if asked for), heredoc, string, sigil, char, atom, attr, number, module (a name segment
    that starts with an upper-case letter, and `__MODULE__`), key (`name:`), ident, the keywords under their own
    name, operators and brackets as themselves, other. A word after a dot is never a keyword.
    """
    out: list[Token] = []
    add, match, new = out.append, _MAIN.match, tuple.__new__
    at, line, n = 0, 1, len(text)
    after_dot = False
    while at < n:
        m = match(text, at)
        if m is None:  # nothing but blanks
            break
        kind = m.lastgroup
        at, end = m.span(kind)
        if kind == "eol":
            add(new(Token, ("eol", at, end, line)))
            line += 1
            at = end
            continue
        if kind == "comment":
            if comments:
                add(new(Token, ("comment", at, end, line)))
            at = end
            continue
        if kind == "word":
            word = m[kind]
            if end < n and text[end] == ":" and text[end + 1 : end + 2] != ":" and not after_dot:
                kind, end = "key", end + 1
            elif word == "__MODULE__" or word[0].isupper():
                kind = "module"
                if word[-1] in "?!":
                    end -= 1
            elif not after_dot and word in KEYWORDS:
                kind = word
            else:
                # `x!=` is an identifier and an operator
                if word[-1] in "?!" and text[end : end + 1] == "=" and text[end + 1 : end + 2] not in ("=", "~"):
                    end -= 1 if word[-1] == "!" else 0
                kind = "ident"
            add(new(Token, (kind, at, end, line)))
        elif kind == "op":
            kind = m[kind]
            add(new(Token, (kind, at, end, line)))
        else:
            if kind == "heredoc":
                rest = text.find("\n", end)
                opens = rest >= 0 and not text[end:rest].strip()
                end = _heredoc(text, end, m[kind]) if opens else _quoted(text, at + 1, m[kind][0])
                kind = "heredoc" if opens else "string"
            elif kind == "string":
                end = _quoted(text, end, m[kind])
                if text[end : end + 1] == ":" and text[end + 1 : end + 2] != ":":
                    kind, end = "key", end + 1
            elif kind == "qatom":
                kind, end = "atom", _quoted(text, end, m[kind][1])
            elif kind == "sigil":
                end = _sigil(text, m)
            elif kind == "colons":
                kind = "::"
            add(new(Token, (kind, at, end, line)))
            line += text.count("\n", at, end)
        after_dot = kind == "."
        at = end
    return out


def line_starts(text: str) -> list[int]:
    """Offset of the first character of each line."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def token_at(tokens: list[Token], offset: int) -> int:
    """Index of the token that holds the offset, -1 if none does."""
    i = bisect_right(tokens, offset, key=lambda t: t.start) - 1
    return i if i >= 0 and tokens[i].end > offset else -1


def line_col_to_offset(starts: list[int], line: int, col: int) -> int:
    """Offset of a 1-based line and 0-based column, -1 beyond the text's lines."""
    return starts[line - 1] + col if 1 <= line <= len(starts) else -1


def literal_text(text: str, token: Token) -> str:
    """The text that a string, heredoc or sigil token stands for: without quotes, a heredoc without its indent."""
    raw = text[token.start : token.end]
    m = re.match(r"~(?:[a-z]|[A-Z][A-Z0-9]*)", raw)
    plain = bool(m and m.group()[1].isupper())
    if m:
        raw = raw[m.end() :].rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if raw.startswith(('"""', "'''")) and "\n" in raw:
        body = raw[3:]
        body = body[body.find("\n") + 1 :]
        lines = body.split("\n")
        indent = ""
        if lines and lines[-1].strip() in ('"""', "'''"):
            indent = lines[-1][: len(lines[-1]) - len(lines[-1].lstrip())]
            lines = lines[:-1]
        inner = "\n".join(x.removeprefix(indent) for x in lines)
    else:
        inner = raw[1:-1] if len(raw) > 1 and raw[-1] in "\"'/|)]}>" else raw[1:]
    return inner if plain else re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), inner, flags=re.DOTALL)
