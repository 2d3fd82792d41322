"""Where a variable of a source text occurs.

Regions of tokens stand for scopes: a definition's clause, a `->` clause (its pattern and its body), and the clauses of
`with` and `for`. A region binds a name if its pattern has the name unpinned, or if its body assigns it. The occurrences
of a name are those in the innermost region around it that binds it (outermost: the definition's clause), without the
regions inside that bind the name anew.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from codequarry.lang.lexer import DEF_WORDS, line_col_to_offset, line_starts, token_at
from codequarry.lang.parser import Tokens

_OPENING, _CLOSING = frozenset(("(", "[", "{", "<<")), frozenset((")", "]", "}", ">>"))
# Words that are no variables.
_WORDS = frozenset("and or not in when true false nil case cond if unless else rescue catch after receive try with for quote unquote super raise".split())
_CLAUSE_BLOCKS = frozenset(("case", "cond", "receive", "try", "else", "rescue", "catch", "after"))


class Occurrence(NamedTuple):
    line: int  # from 0
    start: int
    end: int


@dataclass
class Region:
    """Tokens lo..hi (exclusive) with the ranges in which names are bound and those that are read outside of it."""

    kind: str
    lo: int
    hi: int
    patterns: list[tuple[int, int]] = field(default_factory=list)
    inside: list[Region] = field(default_factory=list)


class Variables:
    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n")
        self.t = Tokens(self.text)
        self.starts = line_starts(self.text)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, tok in enumerate(self.t.all):
            if tok.kind in _OPENING or tok.kind in ("do", "fn"):
                stack.append(i)
            elif tok.kind in _CLOSING or tok.kind == "end":
                want = ("do", "fn") if tok.kind == "end" else _OPENING
                while stack and self.t.kind(stack[-1]) not in want:
                    stack.pop()
                if stack:
                    self.match[stack.pop()] = i
        self.opener = {close: open_ for open_, close in self.match.items()}
        self._assigned: dict[tuple[int, str], list[int]] = {}
        self.root = Region("file", 0, self.t.n)
        self.root.inside = self._regions(0, self.t.n)

    # -------------------------------------------------------- building

    def _close(self, i: int, hi: int) -> int:
        return self.match.get(i, hi)

    def _statement_end(self, i: int, hi: int) -> int:
        """Where an expression that starts at i ends: a line end, comma-less, outside of brackets and blocks."""
        while i < hi:
            k = self.t.kind(i)
            if i in self.match:
                i = self.match[i]
            elif k == "eol" and self.t.kind(i - 1) not in (",", "|>", "=", "<-", "->", "when", "key", "<>", "do") and self.t.kind(self.t.after_blank(i)) not in ("|>", "do", "when"):
                return i
            elif k in _CLOSING or k == "end":
                return i
            i += 1
        return hi

    def _regions(self, lo: int, hi: int) -> list[Region]:
        """The regions directly within a range."""
        t, out, i = self.t, [], lo
        while i < hi:
            k = t.kind(i)
            if k in DEF_WORDS or (k == "ident" and t.word(i) == "test" and t.kind(i - 1) in ("eol", "do", "")):
                end = self._statement_end(i + 1, hi)
                body = next((j for j in range(i, end) if t.kind(j) == "do"), None)
                stop = self._close(body, hi) + 1 if body is not None and body in self.match else end
                head = body if body is not None else next((j for j in range(i, end) if t.kind(j) == "key" and t.word(j) == "do:"), end)
                region = Region("def", i, min(stop, hi), [(i + 2, head)])
                region.inside = self._regions(i + 2, region.hi)
                out.append(region)
                i = region.hi
            elif k == "fn":
                close = self._close(i, hi)
                out += self._clauses(i + 1, close)
                i = close + 1
            elif k == "ident" and t.word(i) in ("with", "for") and t.kind(i + 1) not in ("eol", ".", "=", ",", ")"):
                region = self._comprehension(i, hi)
                out.append(region)
                i = region.hi
            elif k == "do" and i in self.match and self._has_clauses(i + 1, self.match[i]):
                out += self._clauses(i + 1, self.match[i])
                i = self.match[i] + 1
            else:
                i += 1
        return out

    def _arrows(self, lo: int, hi: int) -> list[int]:
        """The `->` tokens of a block itself, not of blocks within."""
        found, i = [], lo
        while i < hi:
            if self.t.kind(i) == "->":
                found.append(i)
            i = self.match[i] + 1 if i in self.match else i + 1
        return found

    def _has_clauses(self, lo: int, hi: int) -> bool:
        return bool(self._arrows(lo, hi))

    def _clauses(self, lo: int, hi: int) -> list[Region]:
        arrows, out = self._arrows(lo, hi), []
        heads = []
        for n, a in enumerate(arrows):
            first = a
            floor = arrows[n - 1] + 1 if n else lo
            while first > floor and not (self.t.kind(first - 1) == "eol" and self.t.kind(first - 2) not in (",", "when", "|", "=")):
                back = self.opener.get(first - 1)
                first = back if back is not None and back >= floor else first - 1
            heads.append(first)
        for n, a in enumerate(arrows):
            stop = heads[n + 1] if n + 1 < len(arrows) else hi
            region = Region("clause", heads[n], stop, [(heads[n], a)])
            region.inside = self._regions(heads[n], stop)
            out.append(region)
        return out

    def _comprehension(self, i: int, hi: int) -> Region:
        """`with` and `for`: each `pattern <- value` binds for what comes after its value."""
        t = self.t
        end = self._statement_end(i + 1, hi)
        body = next((j for j in range(i, end) if t.kind(j) == "do" and not self._within(j, i + 1, end)), None)
        stop = min(self._close(body, hi) + 1 if body is not None else end, hi)
        region = Region("steps", i, stop)
        last, j = i + 1, i + 1
        limit = body if body is not None else stop
        while j < limit:
            if j in self.match:
                j = self.match[j] + 1
                continue
            k = t.kind(j)
            if k == "<-":
                region.patterns.append((last, j))
            elif k == "=" and not any(a <= j < b for a, b in region.patterns):
                region.patterns.append((last, j))
            elif k == ",":
                last = j + 1
            elif k == "key" and t.word(j) in ("do:", "into:", "reduce:", "uniq:"):
                break
            j += 1
        region.inside = self._regions(i + 1, stop)
        return region

    def _within(self, j: int, lo: int, hi: int) -> bool:
        return any(o < j < c for o, c in self.match.items() if lo <= o < hi and self.t.kind(o) in _OPENING)

    # -------------------------------------------------------- names

    def is_variable(self, i: int) -> bool:
        t = self.t
        if t.kind(i) != "ident" or t.word(i) in _WORDS or t.kind(i - 1) == "." or t.kind(i - 1) in DEF_WORDS:
            return False
        adjacent = t.kind(i + 1) == "(" and t.all[i + 1].start == t.all[i].end
        return not adjacent and not (t.kind(i - 1) == "attr" and t.word(i - 1) in ("@spec", "@callback", "@type"))

    def _pinned(self, i: int) -> bool:
        return self.t.kind(i - 1) in ("^", "op") and self.text[self.t.all[i - 1].start] == "^"

    def _binds(self, r: Region, name: str) -> bool:
        if any(self._named(i, name) and not self._pinned(i) for a, b in r.patterns for i in range(a, b)):
            return True
        return r.kind in ("def", "clause") and bool(self._assignments(r, name))

    def _named(self, i: int, name: str) -> bool:
        return self.t.kind(i) == "ident" and self.t.word(i) == name and self.is_variable(i)

    def _assignments(self, r: Region, name: str) -> list[int]:
        """Places in a region itself where the name is on the left of `=`."""
        known = self._assigned.get((id(r), name))
        if known is not None:
            return known
        found, i = [], r.lo
        inner = {j for s in r.inside for j in range(s.lo, s.hi)}
        while i < r.hi:
            if i not in inner and self._named(i, name) and not self._pinned(i):
                j, depth = i + 1, 0
                while j < r.hi and self.t.kind(j) not in ("eol", "do", "->") and depth >= -3:
                    k = self.t.kind(j)
                    if k in _CLOSING:
                        depth -= 1
                    elif j in self.match:
                        j = self.match[j]
                    elif k == "=" and depth <= 0:
                        found.append(i)
                        break
                    elif k in ("|>", ";") or (k == "," and depth == 0):
                        break
                    j += 1
            i += 1
        self._assigned[id(r), name] = found
        return found

    def _around(self, i: int) -> list[Region]:
        """Regions around a token, outermost first."""
        out, here = [], self.root
        while True:
            out.append(here)
            inner = next((s for s in here.inside if s.lo <= i < s.hi), None)
            if inner is None:
                return out
            here = inner

    def _collect(self, r: Region, name: str) -> list[int]:
        found = []
        inner = [s for s in r.inside]
        for i in range(r.lo, r.hi):
            region = next((s for s in inner if s.lo <= i < s.hi), None)
            if region is None and self._named(i, name):
                found.append(i)
        for s in inner:
            found += self._collect(s, name) if not self._binds(s, name) else self._free(s, name)
        return sorted(found)

    def _free(self, r: Region, name: str) -> list[int]:
        """Occurrences in a region that binds the name which still mean the outer one: pins, and what is read before
        the name is bound."""
        out = [i for a, b in r.patterns for i in range(a, b) if self._named(i, name) and self._pinned(i)]
        if r.kind == "steps":
            first = next(n for n, (a, b) in enumerate(r.patterns) if any(self._named(i, name) and not self._pinned(i) for i in range(a, b)))
            stop = next((j for j in range(r.patterns[first][1], r.hi) if self.t.kind(j) == "," and not self._within(j, r.lo, r.hi)), r.patterns[first][1])
            lo, hi = r.patterns[first]
            out += [i for i in range(r.lo, stop) if not lo <= i < hi and self._named(i, name)]
        return out

    def _position(self, i: int) -> Occurrence:
        tok = self.t.all[i]
        base = self.starts[tok.line - 1]
        return Occurrence(tok.line - 1, tok.start - base, tok.end - base)

    def _token(self, line: int, col: int) -> int:
        at = line_col_to_offset(self.starts, line + 1, col)
        i = token_at(self.t.all, at) if at >= 0 else -1
        return i if i >= 0 else (token_at(self.t.all, at - 1) if at > 0 else -1)

    # -------------------------------------------------------- questions

    def occurrences(self, line: int, col: int) -> list[Occurrence]:
        """All occurrences of the variable or module attribute at a place (from 0); none for anything else."""
        i = self._token(line, col)
        if i < 0:
            return []
        if self.t.kind(i) == "attr":
            return [self._position(n) for n, tok in enumerate(self.t.all) if tok.kind == "attr" and self.t.word(n) == self.t.word(i)]
        if not self.is_variable(i):
            return []
        name = self.t.word(i)
        around = self._around(i)
        if self._pinned(i) and len(around) > 1 and around[-1].kind in ("clause", "steps"):
            around = around[:-1]
        definition = next((r for r in around if r.kind == "def"), None)
        for r in reversed(around):
            if r.kind == "file":
                break
            if r.kind == "steps" and i in self._outer_reads(r, name):
                continue
            if self._binds(r, name):
                found = self._collect(r, name)
                if r.kind == "steps":
                    found = [n for n in found if n not in self._outer_reads(r, name)]
                elif r.kind == "clause":
                    found = [n for n in found if not (any(a <= n < b for a, b in r.patterns) and self._pinned(n))]
                return [self._position(n) for n in found]
        return [self._position(n) for n in self._collect(definition, name)] if definition and self._bound_in(definition, name) else []

    def _outer_reads(self, r: Region, name: str) -> set[int]:
        return set(self._free(r, name)) if self._binds(r, name) else set()

    def _bound_in(self, r: Region, name: str) -> bool:
        return self._binds(r, name) or any(self._bound_in(s, name) for s in r.inside)

    def name_exists(self, line: int, col: int, name: str) -> bool:
        """Whether a variable of that name is in the definition around a place: a rename to it would collide."""
        i = self._token(line, col)
        definition = next((r for r in self._around(max(i, 0)) if r.kind == "def"), None)
        return bool(definition) and self._bound_in(definition, name)

    def names_at(self, line: int, col: int) -> list[str]:
        """Variables that can be used at a place: bound before it in the regions around it, in order."""
        at = line_col_to_offset(self.starts, line + 1, col)
        i = max((n for n, tok in enumerate(self.t.all) if tok.end <= at), default=-1)
        around = self._around(max(i, 0))
        if not any(r.kind == "def" for r in around):
            return []
        found: dict[str, None] = {}
        for r in around[1:]:
            inner = {j for s in r.inside for j in range(s.lo, s.hi)}
            for a, b in r.patterns:
                for j in range(a, min(b, i + 1)):
                    if self.is_variable(j) and self.t.kind(j) == "ident" and not self._pinned(j):
                        found.setdefault(self.t.word(j))
            for j in range(r.lo, min(r.hi, i + 1)):
                if j not in inner and self.t.kind(j) == "ident" and self.is_variable(j) and j in self._assignments(r, self.t.word(j)):
                    found.setdefault(self.t.word(j))
        return [n for n in found if not n.startswith("_")]


def token_occurrences(text: str, word: str) -> list[Occurrence]:
    """Identifiers and module segments that equal a word, outside of literals and comments."""
    text = text.replace("\r\n", "\n")
    t, starts = Tokens(text), line_starts(text)
    out = []
    for i, tok in enumerate(t.all):
        if tok.kind in ("ident", "module") and t.word(i) == word:
            base = starts[tok.line - 1]
            out.append(Occurrence(tok.line - 1, tok.start - base, tok.end - base))
    return out
