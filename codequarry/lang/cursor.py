"""What stands at a place in a text: expressions, completion prefixes, calls with their argument, alias groups."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from codequarry.functions.names import KEYWORDS
from codequarry.lang.lexer import line_col_to_offset, token_at
from codequarry.lang.parser import Tokens

_OPENING, _CLOSING = frozenset(("(", "[", "{", "<<")), frozenset((")", "]", "}", ">>"))
_PART = frozenset(("module", "ident", "atom"))
_WORD_CHARS = re.compile(r"[\w.?!]", re.UNICODE)


class Expression(NamedTuple):
    """A dotted expression: module (`Foo.Bar`, `:lists`), function, first column and the column after it."""

    module: str = ""
    function: str = ""
    start: int = 0
    end: int = 0

    def __str__(self) -> str:
        return ".".join(x for x in (self.module, self.function) if x)


def _read(text: str | Tokens) -> Tokens:
    """The tokens of a text; who asks about many places of one reads it once."""
    return text if isinstance(text, Tokens) else Tokens(text)


def expression_at(text: str | Tokens, line: int, col: int, whole: bool = False) -> Expression:
    """The expression at a 0-based line and column, outside of literals and comments.

    It ends with the segment that the cursor is on, unless the `whole` chain is asked for.
    """
    t = _read(text)
    starts = t.starts
    at = line_col_to_offset(starts, line + 1, col)
    if at < 0:
        return Expression()
    i = token_at(t.all, at)
    if i < 0 and at > 0:  # the cursor stands right after a word
        i = token_at(t.all, at - 1)
    if i >= 0 and t.kind(i) == "." and t.kind(i + 1) in _PART:
        i = i - 1 if not whole and i else i
    if i < 0 or t.kind(i) not in ("module", "ident", "atom", "key", "."):
        return Expression()
    if t.kind(i) in ("key",):
        return Expression()
    if t.kind(i) == "atom" and t.kind(i + 1) != ".":
        return Expression()
    first = i
    while first >= 2 and t.kind(first - 1) == "." and t.kind(first - 2) in _PART and t.all[first - 2].line == t.all[i].line:
        first -= 2
    last = i
    while whole and t.kind(last + 1) == "." and t.kind(last + 2) in _PART:
        last += 2
    modules: list[str] = []
    function = ""
    end = first
    j = first
    while j <= last:
        word = t.word(j)
        if t.kind(j) == "ident":
            function, end = word, j
            break
        modules.append(word)
        end = j
        j += 2
    base = starts[t.all[first].line - 1]
    return Expression(".".join(modules), function, t.all[first].start - base, t.all[end].end - base)


def module_and_function(expression: str) -> tuple[str, str]:
    """`Foo.Bar.baz` gives Foo.Bar and baz: segments in upper case, then the first in lower case."""
    modules, function = [], ""
    for part in expression.split("."):
        if not part:
            continue
        if not part[0].isupper():
            function = part
            break
        modules.append(part)
    return ".".join(modules), function


def completion_prefix(line: str, col: int) -> tuple[str, bool, int]:
    """What is typed before a column: the prefix without a last dot, whether there is one, and where it starts."""
    col = min(col, len(line))
    start = col
    while start > 0 and _WORD_CHARS.match(line[start - 1]):
        start -= 1
    if start == col:
        return "", False, 0
    if start > 0 and line[start - 1] == ":":
        start -= 1
    typed = line[start:col]
    return (typed[:-1], True, start) if typed.endswith(".") else (typed, False, start)


def after_pipe(line: str, start: int) -> bool:
    """Whether an expression that starts at a column comes after a pipe."""
    return line[:start].rstrip().endswith("|>")


def alias_group_parent(text: str | Tokens, line: int, col: int) -> str:
    """The parent `P` if the place is within the braces of `alias P.{...}`, else ''."""
    t = _read(text)
    at = line_col_to_offset(t.starts, line + 1, col)
    return next((name for name, first, last in t.alias_groups if first <= at <= last), "")


def call_at(text: str | Tokens, line: int, col: int) -> tuple[str, int]:
    """The call around a place and which of its arguments the place is in, from 0; ('', 0) outside of calls.

    With parentheses or, within one line, without.
    """
    t = _read(text)
    at = line_col_to_offset(t.starts, line + 1, col)
    if at < 0:
        return "", 0
    i = bisect_left(t.all, at, key=lambda tok: tok.start) - 1
    if i >= 0 and t.all[i].kind in ("string", "heredoc", "sigil") and t.all[i].end > at:
        i -= 1
    openers, counts = t.nesting
    n, inside = (openers[i], i) if i >= 0 else (-1, -1)
    while n >= 0:
        k = t.all[n].kind
        if k == "(" and n and t.kind(n - 1) == "ident" and t.all[n - 1].end == t.all[n].start:
            return _callee(t, n - 1), counts[inside]
        if k in ("do", "fn"):
            break
        n, inside = (openers[n - 1], n - 1) if n else (-1, -1)
    # Without parentheses: the first identifier of the line's statement, if arguments follow it.
    n, depth, commas = i, 0, 0
    while n >= 0 and not (t.all[n].kind == "eol" and depth == 0):
        k = t.all[n].kind
        depth += (k in _CLOSING) - (k in _OPENING)
        if depth < 0:
            break
        if k == "," and depth == 0:
            commas += 1
        starts = n == 0 or t.kind(n - 1) in ("eol", "=", "|>", "->", "do", "(", "[", "{", ",") or t.kind(n - 1) == "."
        if depth == 0 and k == "ident" and starts and t.word(n) not in KEYWORDS and n < i + 1:
            following = t.kind(n + 1)
            if following not in ("", "eol", "=", ".", "(", ")", "|>", ",", "->", "do") and t.all[n].end < at and t.kind(n - 1) != ",":
                return _callee(t, n), commas
        n -= 1
    return "", 0


def _callee(t: Tokens, i: int) -> str:
    first = i
    while first >= 2 and t.kind(first - 1) == "." and t.kind(first - 2) in _PART:
        first -= 2
    return "".join(t.word(n) for n in range(first, i + 1))


def attribute_at(line: str, col: int) -> str:
    """The name of the module attribute at a column, '' without one."""
    for m in re.finditer(r"@([a-z_]\w*[?!]?)", line):
        if m.start() <= col < m.end():
            return m[1]
    return ""


def token_columns(line: str, token: str) -> list[int]:
    """Byte columns of a whole token in a line: no letter, digit, `_`, `?` or `!` on either side."""
    pattern = rf"(?<![\w?!]){re.escape(token)}(?![\w?!])"
    return [len(line[: m.start()].encode()) for m in re.finditer(pattern, line)] if token else []


def function_token_columns(line: str, token: str) -> list[int]:
    """As token_columns, without keyword keys (`token:`) but with types (`token ::`, `token::`)."""
    raw = line.encode()
    end = len(token.encode())
    return [c for c in token_columns(line, token) if not (raw[c + end : c + end + 1] == b":" and raw[c + end + 1 : c + end + 2] != b":")]
