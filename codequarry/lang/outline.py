"""What one source text says about itself: scopes, directives, functions, attributes, documentation, symbols, folds."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from functools import cached_property

from codequarry.functions.names import KEYWORDS
from codequarry.lang.lexer import DEF_WORDS, MODULE_WORDS, literal_text
from codequarry.lang.parser import Tokens, named, resolve_alias, resolve_self

# Attributes that start a statement of their own.
_DECLARING = frozenset("type typep opaque callback macrocallback".split())
_OPENING, _CLOSING = frozenset(("(", "[", "{", "<<")), frozenset((")", "]", "}", ">>"))
# Attributes that the language gives a meaning of its own.
RESERVED_ATTRIBUTES = frozenset(
    "doc moduledoc typedoc spec type typep opaque callback macrocallback behaviour impl derive enforce_keys "
    "before_compile after_compile on_load on_definition optional_callbacks compile deprecated dialyzer external_resource".split()
)


@dataclass
class Scope:
    name: str
    kind: str
    first_line: int
    last_line: int
    parent: int


@dataclass
class Alias:
    scope: int
    short: str
    full: str
    line: int


@dataclass
class Use:
    module: str
    options: dict[str, str]
    line: int
    scope: int


@dataclass
class Function:
    module: str
    name: str
    kind: str
    line: int
    last_line: int
    params: list[str]
    defaults: int
    scope: int


@dataclass
class Block:
    """A macro called at the start of a line with a block, such as `test "..." do`."""

    macro: str
    label: str
    line: int
    last_line: int


@dataclass
class Outline:
    """One pass over a text. Scopes are modules; -1 is the file itself."""

    text: str
    scopes: list[Scope] = field(default_factory=list)
    aliases: list[Alias] = field(default_factory=list)
    imports: list[tuple[str, int, int]] = field(default_factory=list)  # module, line, scope
    uses: list[Use] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)
    attributes: list[tuple[str, int, int]] = field(default_factory=list)  # name, line, token index
    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self):
        self.text = self.text.replace("\r\n", "\n").lstrip("﻿")
        self.t = t = Tokens(self.text)
        stack: list[tuple[int, int]] = []  # scope, depth of its block
        opened: list[tuple[int, Function | Block | None]] = []  # depth and owner of each open block
        macro_do: dict[int, Block] = {}  # macro blocks by the token that opens them
        depth, i, head_end = 0, 0, 0
        awaiting: Function | None = None
        last = t.all[-1].line if t.n else 1
        while i < t.n:
            k = t.all[i].kind
            here = stack[-1][0] if stack else -1
            if k in MODULE_WORDS:
                name, after = t.module_name(t.after_blank(i + 1))
                if name:
                    outer = self.scopes[here].name if here >= 0 else ""
                    full = f"{outer}.{name}" if outer and "." not in name else name
                    block, after = t.block_do(after)
                    self.scopes.append(Scope(full, "module" if k == "defmodule" else k, t.line(i), last if block else t.line(i), here))
                    if block:
                        depth += 1
                        stack.append((len(self.scopes) - 1, depth))
                        opened.append((depth, None))
                    i = after
                    continue
            elif k == "alias":
                i = self._alias(i, here)
                continue
            elif k in ("import", "use"):
                name, after = t.module_name(t.after_blank(i + 1))
                if name and k == "import":
                    self.imports.append((name, t.line(i), here))
                elif name:
                    self.uses.append(Use(name, self._options(after), t.line(i), here))
                i = max(after, i + 1)
                continue
            elif k == "require":
                name, after = t.module_name(t.after_blank(i + 1))
                short, end = t.option(after, "as")
                if name and short:
                    self._bind(here, short, name, t.line(i))
                i = max(end if short else after, i + 1)
                continue
            elif k in DEF_WORDS:
                j = t.after_blank(i + 1)
                if t.kind(j) == "ident":
                    params, defaults, head_end = t.params(t.after_blank(j + 1))
                    awaiting = Function(self.scopes[here].name if here >= 0 else "", t.word(j), k, t.line(i), t.line(i), params, defaults, here)
                    self.functions.append(awaiting)
            elif k == "attr":
                self.attributes.append((t.word(i)[1:], t.line(i), i))
            elif k in ("do", "fn"):
                depth += 1
                opened.append((depth, (macro_do.pop(i, None) or awaiting) if k == "do" else None))
                if k == "do":
                    awaiting = None
            elif k == "ident" and i >= head_end and here >= 0 and not macro_do and t.kind(i - 1) in ("", "eol") and t.word(i) not in KEYWORDS:
                do = self._next_do[i]
                if t.kind(do) == "do":
                    name = t.word(i)
                    written = self.text[t.all[i].end : t.all[do].start].strip()
                    if len(written) >= 2 and written[0] == written[-1] == '"':
                        written = written[1:-1]
                    macro_do[do] = Block(name, f"{name} {written}" if written else name, t.line(i), last)
                    self.blocks.append(macro_do[do])
            elif k == "end" and depth:
                if stack and stack[-1][1] == depth:
                    self.scopes[stack.pop()[0]].last_line = t.line(i)
                if opened and opened[-1][0] == depth:
                    f = opened.pop()[1]
                    if f is not None:
                        f.last_line = t.line(i)
                depth -= 1
            i += 1

    @cached_property
    def _next_do(self) -> list[int]:
        """For each token the next one that opens a block or starts or ends a statement."""
        t, found, at = self.t, [0] * self.t.n, self.t.n
        for i in range(t.n - 1, -1, -1):
            found[i] = at
            k = t.all[i].kind
            if k in ("do", "end") or k in DEF_WORDS or k in MODULE_WORDS or (k == "attr" and t.word(i)[1:] in _DECLARING):
                at = i
        return found

    def _bind(self, scope: int, short: str, full: str, line: int) -> None:
        whole = resolve_self(full, self.scopes[scope].name if scope >= 0 else "")
        if whole:
            self.aliases.append(Alias(scope, short, whole, line))

    def _alias(self, i: int, scope: int) -> int:
        t, line = self.t, self.t.line(i)
        name, after = t.module_name(t.after_blank(i + 1))
        if not name:
            return i + 1
        children, end = t.children(after)
        if children is not None:
            for child in children:
                self._bind(scope, child.rpartition(".")[2], f"{name}.{child}", line)
            return end
        short, end = t.option(after, "as")
        self._bind(scope, short or name.rpartition(".")[2], name, line)
        return end if short else after

    def _options(self, i: int) -> dict[str, str]:
        """Options of a `use` whose values are modules, up to the end of the statement."""
        t, found, depth = self.t, {}, 0
        while i < t.n and not (t.all[i].kind == "eol" and depth <= 0 and t.kind(i - 1) != ","):
            k = t.all[i].kind
            depth += (k in _OPENING) - (k in _CLOSING)
            if k == "key" and t.kind(t.after_blank(i + 1)) == "module":
                found[t.word(i)[:-1]] = t.module_name(t.after_blank(i + 1))[0]
            i += 1
        return found

    # -------------------------------------------------------- questions

    def scope_at(self, line: int) -> int:
        """The innermost module whose block holds the line, -1 outside of all."""
        best = -1
        for n, s in enumerate(self.scopes):
            if s.first_line <= line <= s.last_line and (best < 0 or s.first_line >= self.scopes[best].first_line):
                best = n
        return best

    def module_at(self, line: int) -> str:
        n = self.scope_at(line)
        return self.scopes[n].name if n >= 0 else ""

    @property
    def first_module(self) -> str:
        """The name in the first `defmodule`, as written; '' without one."""
        return next((s.name for s in self.scopes if s.kind == "module"), "")

    def module_on_line(self, line: int) -> str:
        """The module whose `defmodule` stands on a line, '' if none does."""
        return next((s.name for s in self.scopes if s.kind == "module" and s.first_line == line), "")

    def resolved_self(self, name: str, line: int = 0) -> str:
        """A name with `__MODULE__` replaced by the module around the line, or without one by the first of the text."""
        own = (self.module_at(line) if line else "") or self.first_module
        return resolve_self(name, own) or name

    def alias_map(self, line: int | None = None) -> dict[str, str]:
        """Short to full names; with a line only those of the module that the line is in, later ones winning."""
        scope = None if line is None else self.scope_at(line)
        return {a.short: a.full for a in self.aliases if scope is None or a.scope == scope}

    def resolved_uses(self) -> list[Use]:
        """Uses with modules and option values resolved through the aliases of the file."""
        m = self.alias_map()
        out = []
        for u in self.uses:
            own = self.scopes[u.scope].name if u.scope >= 0 else ""
            options = {k: resolve_alias(v, m, own) for k, v in u.options.items()}
            out.append(Use(resolve_alias(u.module, m, own), options, u.line, u.scope))
        return out

    def buffer_functions(self) -> list[tuple[str, int, str, str, int]]:
        """name, arity, kind, parameters, line of each callable; the first of equal name and arity."""
        found: dict[tuple[str, int], tuple] = {}
        for f in self.functions:
            names = named(f.params)
            for arity in range(len(f.params) - f.defaults, len(f.params) + 1):
                found.setdefault((f.name, arity), (f.name, arity, f.kind, ",".join(names[:arity]), f.line))
        return list(found.values())

    def function_line(self, name: str) -> int:
        """The line of the first definition of a name, 0 without one."""
        return next((f.line for f in self.functions if f.name == name), 0)

    def attribute_line(self, name: str) -> int:
        """The line that gives a module attribute its value, 0 without one; reserved attributes have none."""
        if name in RESERVED_ATTRIBUTES:
            return 0
        for n, line, i in self.attributes:
            starts = i == 0 or self.t.kind(i - 1) in ("eol", ";")
            if n == name and starts and self.t.kind(i + 1) not in ("", "eol", ",", ")", "]", "}", ".", "|>", "="):
                return line
        return 0

    def bare_calls(self) -> dict[str, list[int]]:
        """For each name that is called without a module the lines that do so: before a parenthesis, or after a pipe."""
        t, found = self.t, {}
        before = ""  # kind of the last token that is no line end
        for i, tok in enumerate(t.all):
            if tok.kind == "ident" and before != "." and before not in DEF_WORDS and not (before == "attr" and t.word(last) in ("@spec", "@callback", "@macrocallback")):
                if before == "|>" or (t.kind(i + 1) == "(" and t.all[i + 1].start == tok.end):
                    found.setdefault(t.word(i), set()).add(tok.line)
            if tok.kind != "eol":
                before, last = tok.kind, i
        return {name: sorted(lines) for name, lines in found.items()}

    def bare_call_lines(self, name: str) -> list[int]:
        """Lines that call `name` without a module."""
        return self.bare_calls().get(name, [])

    # -------------------------------------------------------- documentation

    def docs_above(self, lines: list[int]) -> dict[int, tuple[str, str]]:
        """Documentation and spec of what is defined on each line: from the attributes above it, back to the statement
        before. Lines, attributes and statements are gone through once, in order."""
        t, found = self.t, {}
        ends = sorted([(f.line, f.last_line) for f in self.functions] + [(x.first_line, x.first_line) for x in self.scopes])
        at = [x[1] for x in self.attributes]
        limit = n = 0
        for line in sorted(set(lines)):
            while n < len(ends) and ends[n][0] < line:
                limit, n = max(limit, ends[n][1]), n + 1
            doc = spec = ""
            for name, _, i in self.attributes[bisect_right(at, limit) : bisect_left(at, line)]:
                if name == "doc":
                    doc = self._literal(i + 1)
                elif name == "spec":
                    end, depth = i, 0
                    while end + 1 < t.n and not (t.all[end + 1].kind == "eol" and depth <= 0 and t.kind(end) not in ("|", "::", ",")):
                        end += 1
                        depth += (t.all[end].kind in _OPENING) - (t.all[end].kind in _CLOSING)
                    spec = self.text[t.all[i].start : t.all[end].end]
            found[line] = (doc, spec)
        return found

    def doc_above(self, line: int) -> tuple[str, str]:
        """Documentation and spec of what is defined on a line."""
        return self.docs_above([line])[line]

    def _literal(self, i: int) -> str:
        parts = []
        while self.t.kind(i) in ("string", "heredoc", "sigil"):
            parts.append(literal_text(self.text, self.t.all[i]))
            if self.t.kind(i + 1) != "<>":
                break
            i = self.t.after_blank(i + 2)
        return "".join(parts)

    @cached_property
    def moduledocs(self) -> dict[int, str]:
        """The documentation of each module (by its number) that has some; -1 for one outside of modules."""
        found: dict[int, str] = {}
        for name, line, i in self.attributes:
            if name == "moduledoc":
                found.setdefault(self.scope_at(line), self._literal(i + 1))
        return found

    def moduledoc(self, module: str) -> str:
        return self.moduledocs.get(next((n for n, s in enumerate(self.scopes) if s.name == module), -1), "")

    def impl_above(self, line: int) -> str:
        """What the `@impl` above a head says (`true` or a module), '' without one; only the nearest line that is not
        blank counts, at most three lines up."""
        rows = self.text.split("\n")
        for at in range(line - 2, max(-1, line - 5), -1):
            if at < len(rows) and at >= 0 and rows[at].strip():
                m = re.match(r"\s*@impl\s+([\w.]+)", rows[at])
                return m[1] if m else ""
        return ""

    # -------------------------------------------------------- outline and folds

    def symbols(self) -> list[tuple[int, int, str, str, int, int]]:
        """index, parent, kind, label, first and last line of modules, functions, types, callbacks and macro blocks."""
        rows: list[tuple[str, str, int, int]] = [(s.kind, s.name, s.first_line, s.last_line) for s in self.scopes]
        rows += [(f.kind, f"{f.name}/{len(f.params)}", f.line, f.last_line) for f in self.functions]
        rows += [(b.macro, b.label, b.line, b.last_line) for b in self.blocks]
        for name, line, i in self.attributes:
            j = self.t.after_blank(i + 1)
            if name in ("type", "opaque", "typep", "callback", "macrocallback") and self.t.kind(j) == "ident":
                params, _, _ = self.t.params(j + 1)
                rows.append((name, f"{self.t.word(j)}/{len(params)}", line, line))
        rows.sort(key=lambda r: (r[2], -r[3]))
        out, open_ = [], []
        for n, (kind, label, first, last) in enumerate(rows):
            while open_ and open_[-1][1] < first:
                open_.pop()
            out.append((n, open_[-1][0] if open_ else -1, kind, label, first, last))
            if last > first:
                open_.append((n, last))
        return out

    def folds(self) -> list[tuple[int, int, str]]:
        """First line, last line and kind of what can be folded: literals, blocks and brackets over several lines."""
        found, stack = [], []
        for tok in self.t.all:
            if tok.kind in ("heredoc", "sigil"):
                last = tok.line + self.text.count("\n", tok.start, tok.end)
                if last > tok.line:
                    found.append((tok.line, last, "literal"))
            elif tok.kind in ("do", "fn") or tok.kind in _OPENING:
                stack.append((tok.kind, tok.line))
            elif tok.kind == "end":
                while stack and stack[-1][0] not in ("do", "fn"):
                    stack.pop()
                if stack and (first := stack.pop()[1]) < tok.line:
                    found.append((first, tok.line, "block"))
            elif tok.kind in _CLOSING:
                if stack and stack[-1][0] in _OPENING and (first := stack.pop()[1]) < tok.line:
                    found.append((first, tok.line, "bracket"))
        return sorted(found)
