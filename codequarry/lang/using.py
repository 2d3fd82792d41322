"""What a module's `__using__` puts into the modules that use it."""

from __future__ import annotations

from dataclasses import dataclass, field

from codequarry.lang.lexer import DEF_WORDS
from codequarry.lang.outline import Outline
from codequarry.lang.parser import Tokens, named, resolve_alias

# Functions of Keyword that read an option, with and without a default, and that set one.
_WITH_DEFAULT = frozenset(("get", "pop", "pop!"))
_WITHOUT_DEFAULT = frozenset(("fetch", "fetch!", "pop_lazy", "get_lazy"))
_SETTING = frozenset(("put", "put_new"))
_OPENING, _CLOSING = frozenset(("(", "[", "{")), frozenset((")", "]", "}"))


@dataclass
class UsingBody:
    """Imports and further uses in order, functions written into the user, options that name modules, aliases."""

    imports: list[str] = field(default_factory=list)
    functions: list[tuple[str, int, str, str, int]] = field(default_factory=list)  # name, arity, kind, params, line
    uses: list[str] = field(default_factory=list)
    options: list[tuple[str, str, str]] = field(default_factory=list)  # key, default module, import or use
    aliases: dict[str, str] = field(default_factory=dict)

    def edges(self) -> list[tuple[str, int, str, str, int, str]]:
        """kind, ordinal, target, function, arity, option: the body as rows."""
        rows = [("inline", n, "", f, a, "") for n, (f, a, *_) in enumerate(self.functions)]
        rows += [("import", n, m, "", -1, "") for n, m in enumerate(self.imports)]
        rows += [(f"option_{how}", n, default, "", -1, key) for n, (key, default, how) in enumerate(self.options)]
        rows += [("use", n, m, "", -1, "") for n, m in enumerate(self.uses)]
        rows += [("alias", n, full, "", -1, short) for n, (short, full) in enumerate(self.aliases.items())]
        return rows


class _Reader:
    def __init__(self, text: str):
        self.outline = Outline(text)
        self.t: Tokens = self.outline.t
        self.aliases = self.outline.alias_map()
        self.body = UsingBody()
        self.vars: dict[str, tuple[str, str]] = {}  # variable: option key ('' for a constant), module
        self.entered: set[str] = set()

    def full(self, name: str, i: int) -> str:
        return resolve_alias(name, self.body.aliases | self.aliases, self.outline.module_at(self.t.line(min(i, self.t.n - 1))))

    def span(self, i: int) -> tuple[int, int]:
        """The inside of the next block: the indexes after its `do` and of its `end`."""
        block, start = self.t.block_do(i)
        if not block:
            return start, start
        depth, j = 1, start
        while j < self.t.n:
            k = self.t.all[j].kind
            depth += (k in ("do", "fn")) - (k == "end")
            if not depth:
                break
            j += 1
        return start, j

    def read(self, lo: int, hi: int) -> None:
        t, i = self.t, lo
        while i < hi:
            k = t.all[i].kind
            starts = t.kind(i - 1) in ("eol", "do", ";", "->", "") or i == lo
            if k in ("import", "use", "alias"):
                i = self._directive(i, k)
                continue
            if k in DEF_WORDS:
                j = t.after_blank(i + 1)
                if t.kind(j) == "ident" and t.word(j) != "unquote":
                    params, defaults, after = t.params(t.after_blank(j + 1))
                    names = named(params)
                    for arity in range(len(params) - defaults, len(params) + 1):
                        self.body.functions.append((t.word(j), arity, k, ",".join(names[:arity]), t.line(i)))
                    i = self._past_function(after, hi)
                    continue
            elif k == "ident" and starts and t.kind(i + 1) == "=":
                self._assign(t.word(i), i + 2)
            elif k == "{" and starts and t.kind(i + 1) == "ident" and t.kind(i + 2) == ",":
                close = i
                while close < hi and t.all[close].kind != "}":
                    close += 1
                if t.kind(close + 1) == "=":
                    self._assign(t.word(i + 1), close + 2)
            elif k == "ident" and starts and t.kind(i + 1) == "(" and t.word(i) not in ("quote", "unquote"):
                self._helper(t.word(i))
            i += 1

    def _past_function(self, i: int, hi: int) -> int:
        """The index after a function's body, so that what it does is not taken for what the body of `quote` does."""
        t = self.t
        while i < hi and t.all[i].kind not in ("do", "eol"):
            i += 1
        if t.kind(i) == "eol" and t.kind(t.after_blank(i)) == "do":
            i = t.after_blank(i)
        return self.span(i)[1] + 1 if t.kind(i) == "do" else i

    def _directive(self, i: int, kind: str) -> int:
        t = self.t
        j = t.after_blank(i + 1)
        if t.kind(j) == "ident" and t.word(j) == "unquote" and t.kind(j + 1) == "(" and t.kind(j + 2) == "ident":
            key, module = self.vars.get(t.word(j + 2), ("", ""))
            if kind != "alias" and key:
                self.body.options.append((key, module, kind))
            elif kind != "alias" and module:
                (self.body.imports if kind == "import" else self.body.uses).append(module)
            return j + 3
        name, after = t.module_name(j)
        if not name:
            return i + 1
        if kind == "alias":
            children, end = t.children(after)
            if children is not None:
                for c in children:
                    self.body.aliases[c.rpartition(".")[2]] = self.full(f"{name}.{c}", i)
                return end
            short, end = t.option(after, "as")
            self.body.aliases[short or name.rpartition(".")[2]] = self.full(name, i)
            return end if short else after
        (self.body.imports if kind == "import" else self.body.uses).append(self.full(name, i))
        return after

    def _assign(self, variable: str, i: int) -> None:
        t = self.t
        i = t.after_blank(i)
        name, after = t.module_name(i)
        if not name:
            return
        if name != "Keyword" or t.kind(after) != ".":
            if t.kind(after) in ("eol", "", "end"):
                self.vars[variable] = ("", self.full(name, i))
            return
        call, j, depth = t.word(after + 1), after + 2, 0
        key, module = "", ""
        while j < t.n:
            k = t.all[j].kind
            depth += (k in _OPENING) - (k in _CLOSING)
            if k == "atom" and not key:
                key = t.word(j).removeprefix(":")
            elif k == "module" and key and not module:
                module = self.full(t.module_name(j)[0], j)
            if depth <= 0:
                break
            j += 1
        if call in _WITH_DEFAULT or call in _WITHOUT_DEFAULT:
            if key:
                self.vars[variable] = (key, module if call in _WITH_DEFAULT else "")
        elif call in _SETTING and module:
            self.body.uses.append(module)

    def _helper(self, name: str) -> None:
        """A function of the same file that is called for its `quote do`."""
        if name in self.entered:
            return
        self.entered.add(name)
        t = self.t
        for i in range(t.n - 1):
            if t.all[i].kind in DEF_WORDS and t.kind(i + 1) == "ident" and t.word(i + 1) == name:
                lo, hi = self.span(i + 2)
                for q in range(lo, hi):
                    if t.kind(q) == "ident" and t.word(q) == "quote":
                        own = _Reader.__new__(_Reader)
                        own.__dict__ = self.__dict__ | {"body": UsingBody()}
                        own.read(*own.span(q + 1))
                        # Aliases are always taken over, the rest only from helpers that import something.
                        if own.body.imports:
                            self.body.imports += own.body.imports
                            self.body.functions += own.body.functions
                            self.body.uses += own.body.uses
                            self.body.options += own.body.options
                        self.body.aliases = own.body.aliases | self.body.aliases
                        return
                return


def using_bodies(text: str | None) -> list[tuple[str, UsingBody]]:
    """Each module of a text that can be used, with what using it brings; none for NULL or ''."""
    if not text:
        return []
    found = []
    reader = _Reader(text)
    t = reader.t
    template = any(u.module == "ExUnit.CaseTemplate" for u in reader.outline.uses)
    for i in range(t.n):
        k = t.all[i].kind
        entry = k == "defmacro" and t.kind(i + 1) == "ident" and t.word(i + 1) == "__using__"
        entry = entry or (template and k == "ident" and t.word(i) == "using" and t.kind(i - 1) in ("eol", "do"))
        if entry:
            own = _Reader(text)
            lo, hi = own.span(i + 1)
            own.read(lo, hi)
            found.append((reader.outline.module_at(t.line(i)), own.body))
    return found
