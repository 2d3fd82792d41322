"""Definitions and references of one source text.

One pass over the tokens. Words that define something emit their rows by looking ahead and leave the tokens to the
pass, which then sees every module mention, pipe and block on the way; only the heads of modules and the operands of
`alias`, `import`, `use` and `require` are consumed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from codequarry.functions.names import KEYWORDS
from codequarry.lang.lexer import DEF_WORDS, MODULE_WORDS, Token, line_starts, tokenize

_NEVER_CALLS = frozenset(KEYWORDS)
_OPENING, _CLOSING = frozenset(("(", "[", "{")), frozenset((")", "]", "}"))
_NESTS, _UNNESTS = frozenset(("(", "[", "{", "<<", "do", "fn")), frozenset((")", "]", "}", ">>", "end"))
_STATEMENTS = frozenset((*DEF_WORDS, *MODULE_WORDS, "end"))
_DELEGATE_ENDS = _STATEMENTS | {"alias", "import"}
_TYPE_ATTRS = {"@type": "type", "@opaque": "opaque", "@callback": "callback", "@macrocallback": "macrocallback"}


@dataclass
class Definition:
    module: str
    function: str
    arity: int
    kind: str
    line: int
    delegate_to: str = ""
    delegate_as: str = ""
    params: str = ""


@dataclass
class Reference:
    module: str
    function: str
    line: int
    kind: str


@dataclass
class _Frame:
    name: str
    depth: int
    aliases: dict[str, str]
    injectors: dict[str, None]


def resolve_self(name: str, module: str) -> str:
    """`__MODULE__` replaced by the module that stands around; '' if there is none to replace it with."""
    if "__MODULE__" not in name:
        return name
    return name.replace("__MODULE__", module) if module else ""


def resolve_alias(name: str, aliases: dict[str, str], module: str = "") -> str:
    """The full name of a module mention: an alias of the whole, else of the first segment, else itself; '' if it
    cannot be resolved."""
    full = aliases.get(name)
    if full is None:
        head, dot, tail = name.partition(".")
        full = f"{aliases[head]}.{tail}" if dot and head in aliases else name
    return resolve_self(full, module)


def named(params: list[str]) -> list[str]:
    """Parameter names with `arg1`, `arg2`, ... for those without one."""
    return [p or f"arg{i}" for i, p in enumerate(params, 1)]


class Tokens:
    """A text's tokens with the small look-aheads that readers of Elixir need."""

    def __init__(self, text: str, tokens: list[Token] | None = None):
        self.text = text
        self.all = tokenize(text) if tokens is None else tokens
        self.n = len(self.all)

    @cached_property
    def starts(self) -> list[int]:
        """Offset of each line."""
        return line_starts(self.text)

    @cached_property
    def alias_groups(self) -> list[tuple[str, int, int]]:
        """Parent, first and last offset of the inside of each `alias Parent.{...}`."""
        found = []
        for i, tok in enumerate(self.all):
            if tok.kind != "alias":
                continue
            name, after = self.module_name(self.after_blank(i + 1))
            if name and self.kind(after) == "." and self.kind(after + 1) == "{":
                close = after + 2
                while close < self.n and self.all[close].kind in ("module", ".", ",", "eol"):
                    close += 1
                stop = self.all[close].start if close < self.n else len(self.text) + 1
                found.append((name, self.all[after + 1].end, stop))
        return found

    @cached_property
    def nesting(self) -> tuple[list[int], list[int]]:
        """After each token: the innermost bracket or block that is open (its index, -1 for none), and how many commas came
        within it by itself."""
        openers, counts = [], []
        stack, commas = [-1], [0]
        for i, t in enumerate(self.all):
            k = t.kind
            if k in _NESTS:
                stack.append(i)
                commas.append(0)
            elif k in _UNNESTS:
                if len(stack) > 1:
                    stack.pop()
                    commas.pop()
            elif k == ",":
                commas[-1] += 1
            openers.append(stack[-1])
            counts.append(commas[-1])
        return openers, counts

    def word(self, i: int) -> str:
        t = self.all[i]
        return self.text[t.start : t.end]

    def kind(self, i: int) -> str:
        return self.all[i].kind if 0 <= i < self.n else ""

    def line(self, i: int) -> int:
        return self.all[i].line

    def after_blank(self, i: int) -> int:
        """Index of the next token that is no line end."""
        while i < self.n and self.all[i].kind == "eol":
            i += 1
        return i

    def module_name(self, i: int) -> tuple[str, int]:
        """The dotted name that starts at i ('' if none does), and the index after it."""
        if self.kind(i) != "module":
            return "", i
        parts = [self.word(i)]
        i += 1
        while self.kind(i) == "." and self.kind(i + 1) == "module":
            parts.append(self.word(i + 1))
            i += 2
        return ".".join(parts), i

    def params(self, i: int) -> tuple[list[str], int, int]:
        """Of the parenthesis at i: the parameters' names ('' without one), how many have defaults, the index after."""
        if self.kind(i) != "(":
            return [], 0, i
        names: list[str] = []
        defaults, depth, i = 0, 1, i + 1
        name, default, some = "", False, False
        while i < self.n and depth:
            k = self.all[i].kind
            if k in _OPENING or k == "<<":
                depth, some = depth + 1, True
            elif k in _CLOSING or k == ">>":
                depth -= 1
            elif k == "," and depth == 1:
                names.append(name)
                defaults += default
                name, default = "", False
            elif k != "eol":
                some = True
                if depth == 1:
                    if k == "\\\\":
                        default = True
                    elif k == "=":
                        name = ""
                    elif k == "ident" and not name and self.word(i) != "_":
                        name = self.word(i)
            i += 1
        if some:
            names.append(name)
            defaults += default
        return names, defaults, i

    def option(self, i: int, key: str) -> tuple[str, int]:
        """The value of `, key: Value` right after i, ('' if it is not there), and the index after it."""
        j = self.after_blank(i)
        if self.kind(j) != ",":
            return "", i
        j = self.after_blank(j + 1)
        if self.kind(j) != "key" or self.word(j) != f"{key}:":
            return "", i
        j = self.after_blank(j + 1)
        if self.kind(j) not in ("module", "ident"):
            return "", i
        return self.word(j), j + 1

    def children(self, i: int) -> tuple[list[str] | None, int]:
        """The names in `.{A, B.C}` at i, None if there is no such group, and the index after it."""
        if self.kind(i) != "." or self.kind(i + 1) != "{":
            return None, i
        found, i = [], i + 2
        while i < self.n and self.all[i].kind != "}":
            name, after = self.module_name(i)
            if name:
                found.append(name)
            i = max(after, i + 1)
        return found, i + 1

    def block_do(self, i: int) -> tuple[bool, int]:
        """Whether a block's `do` comes before the next statement, and the index after it or at that statement."""
        while i < self.n:
            k = self.all[i].kind
            if k == "do":
                return True, i + 1
            if k in _STATEMENTS or (k == "attr" and (self.word(i) in _TYPE_ATTRS or self.word(i) == "@typep")):
                return False, i
            i += 1
        return False, self.n


@dataclass
class FactReader:
    """Reads the facts of one text; see the module's description."""

    text: str
    definitions: list[Definition] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)

    def __post_init__(self):
        self.t = Tokens(self.text)
        self.frames: list[_Frame] = []
        self.aliases: dict[str, str] = {}
        self.injectors: dict[str, None] = {}
        self.depth = 0

    @property
    def module(self) -> str:
        return self.frames[-1].name if self.frames else ""

    def read(self) -> FactReader:
        t, i = self.t, 0
        while i < t.n:
            k = t.all[i].kind
            if k in MODULE_WORDS:
                i = self._module(i, "module" if k == "defmodule" else k)
            elif k in ("alias", "import", "use", "require"):
                i = self._directive(i, k)
            else:
                if k in DEF_WORDS:
                    self._function(i, k)
                elif k in ("defstruct", "defexception") and self.module:
                    self._define("__struct__" if k == "defstruct" else "__exception__", 0, k, t.line(i))
                elif k == "attr":
                    self._attribute(i)
                elif k in ("do", "fn"):
                    self.depth += 1
                elif k == "end":
                    self._end()
                elif k == "|>":
                    self._bare_call(t.after_blank(i + 1))
                elif k == "ident":
                    self._statement(i)
                elif k == "module":
                    i = self._mention(i)
                    continue
                i += 1
        return self

    def _define(self, function: str, arity: int, kind: str, line: int, **more: str) -> None:
        self.definitions.append(Definition(self.module, function, arity, kind, line, **more))

    def _refer(self, module: str, function: str, line: int, kind: str) -> None:
        if module:
            self.references.append(Reference(module, function, line, kind))

    def _end(self) -> None:
        if self.frames and self.frames[-1].depth == self.depth:
            frame = self.frames.pop()
            self.aliases, self.injectors = frame.aliases, frame.injectors
        self.depth = max(0, self.depth - 1)

    def _module(self, i: int, kind: str) -> int:
        line = self.t.line(i)
        name, after = self.t.module_name(self.t.after_blank(i + 1))
        if not name:
            return i + 1
        if "." not in name and self.module:
            name = f"{self.module}.{name}"
        self.definitions.append(Definition(name, "", 0, kind, line))
        block, after = self.t.block_do(after)
        if block:
            self.depth += 1
            self.frames.append(_Frame(name, self.depth, dict(self.aliases), dict(self.injectors)))
        return after

    def _directive(self, i: int, kind: str) -> int:
        t, line = self.t, self.t.line(i)
        name, after = t.module_name(t.after_blank(i + 1))
        if not name:
            return i + 1
        full = resolve_self(name, self.module)
        if kind in ("import", "use"):
            self._refer(full, "", line, kind)
            if full:
                self.injectors[full] = None
            return after
        children, end = t.children(after) if kind == "alias" else (None, after)
        if children is not None:
            for child in children:
                whole = f"{full}.{child}" if full else ""
                self.aliases[child.rpartition(".")[2]] = whole or child
                self._refer(whole, "", line, kind)
            return end
        short, end = t.option(after, "as")
        if full and (short or kind == "alias"):
            self.aliases[short or full.rpartition(".")[2]] = full
        self._refer(full, "", line, kind)
        return end if short else after

    def _function(self, i: int, kind: str) -> None:
        t = self.t
        j = t.after_blank(i + 1)
        if not self.module or t.kind(j) != "ident":
            return
        params, defaults, after = t.params(t.after_blank(j + 1))
        more = self._delegate(after) if kind == "defdelegate" else {}
        names = named(params)
        for arity in range(len(params) - defaults, len(params) + 1):
            self._define(t.word(j), arity, kind, t.line(i), params=",".join(names[:arity]), **more)

    def _delegate(self, i: int) -> dict[str, str]:
        t, depth, found = self.t, 0, {}
        while i < t.n and not (depth == 0 and t.all[i].kind in _DELEGATE_ENDS):
            k = t.all[i].kind
            depth += (k in _OPENING) - (k in _CLOSING)
            if k == "key":
                value = t.after_blank(i + 1)
                if t.word(i) == "to:" and (name := t.module_name(value)[0]):
                    named_here = name.replace("__MODULE__", self.module) if self.module else name
                    found["delegate_to"] = resolve_alias(named_here, self.aliases) or named_here
                elif t.word(i) == "as:" and t.kind(value) in ("atom", "ident"):
                    found["delegate_as"] = t.word(value).removeprefix(":")
            i += 1
        return found

    def _attribute(self, i: int) -> None:
        t, word = self.t, self.t.word(i)
        if not self.module:
            return
        j = t.after_blank(i + 1)
        if word in _TYPE_ATTRS and t.kind(j) == "ident":
            params, _, _ = t.params(t.after_blank(j + 1))
            self._define(t.word(j), len(params), _TYPE_ATTRS[word], t.line(i))
        elif word == "@behaviour":
            name, _ = t.module_name(j)
            self._refer(resolve_self(name, self.module), "", t.line(i), "behaviour")

    def _mention(self, i: int) -> int:
        """A module's name that is no operand of a directive; returns the index after it."""
        t = self.t
        name, after = t.module_name(i)
        if not ("A" <= name[0] <= "Z"):
            return i + 1
        line = t.line(i)
        if t.kind(i - 1) == "%":
            if t.kind(after) == "{":
                self._refer(resolve_alias(name, self.aliases, self.module), "", t.line(i - 1), "call")
            return after
        if t.kind(after) == "." and t.kind(after + 1) == "ident":
            function = t.word(after + 1)
            if function not in _NEVER_CALLS:
                self._refer(resolve_alias(name, self.aliases, self.module), function, line, "call")
            return after + 2
        if name != self.module:
            self._refer(resolve_alias(name, self.aliases, self.module), "", line, "call")
        return after

    def _bare_call(self, i: int) -> None:
        """A call without a module may be of any module that was imported or used."""
        if self.module and self.t.kind(i) == "ident" and self.t.word(i) not in _NEVER_CALLS:
            for injector in self.injectors:
                self._refer(injector, self.t.word(i), self.t.line(i), "call")

    def _statement(self, i: int) -> None:
        """An identifier: a bare call if it starts a line and is followed by what makes it one."""
        if not self.injectors or t_kind(self.t, i - 1) not in ("", "eol"):
            return
        if self.t.kind(i + 1) in ("do", "(", "atom") or self._do_follows(i + 1):
            self._bare_call(i)

    def _do_follows(self, i: int) -> bool:
        """Whether a `do` ends the expression that goes on at i; after a line end only the `do` itself may come."""
        depth, line_ended = 0, False
        while i < self.t.n:
            k = self.t.all[i].kind
            if k == "do" and depth == 0:
                return True
            if k == "eol":
                line_ended = line_ended or depth == 0
            elif k in _OPENING:
                depth, line_ended = depth + 1, False
            elif k in _CLOSING:
                depth -= 1
            elif depth == 0 and line_ended:
                return False
            i += 1
        return False


def t_kind(t: Tokens, i: int) -> str:
    return t.kind(i) if i >= 0 else ""


def facts(text: str | None) -> tuple[list[Definition], list[Reference]]:
    """Definitions and references of a text; none for NULL or ''. Never raises on unfinished code."""
    if not text:
        return [], []
    reader = FactReader(text.replace("\r\n", "\n").lstrip("﻿")).read()
    return reader.definitions, reader.references
