"""Functions paired with their documentation.

A string- and comment-aware lexer walks each source text once; `do` and `end` are matched like braces to delimit the
functions, and the documentation immediately before a function's first clause is attached to it: the last `@doc`
with a text, or without any `@doc` the comment lines directly above the head (or above the attributes that stand
directly above the head).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codequarry.lang.lexer import DEF_WORDS, MODULE_WORDS, Token, literal_text, tokenize
from codequarry.sources.facts import latest_texts

#: Kinds whose functions are paired.
PAIRED_KINDS = ("def", "defp", "defmacro", "defguard", "defdelegate")
PAIR_SCHEMA = (
    "path string, line int, kind string, module string, function string, arity int, params array<string>, "
    "doc string, doc_origin string, code string"
)
_OPEN, _CLOSE = frozenset("([{") | {"<<"}, frozenset(")]}") | {">>"}

# ---------------------------------------------------------------- what a documentation says

# Words that say "documentation is to come" or "there is none", in the languages of the sources.
_NONE_YET = frozenset(
    "todo fixme tbd tba wip xxx hack placeholder stub pending undocumented docs doc documentation documented document "
    "description describe descr comment comments docstring na lorem ipsum "
    "dokumentation dokumentieren beschreibung beschreiben platzhalter ausstehend undokumentiert kommentar "
    "documentación documentacion documentar documentado descripción descripcion describir pendiente comentario".split()
)
# Words that add nothing to the above.
_FILLER = frozenset(
    "a an the this that these it its is are was be been being to of for in on at and or with no not none missing empty "
    "available time currently yet soon later here there add write put please proper better good some more any follow "
    "follows following will should must needs need needed do does fill out up me us we i function method module code "
    "coming come comes later now n nothing something someone still only just see fix update "
    "fehlt fehlen noch folgt folgen hier keine kein später bald nicht vorhanden die der das eine ein funktion bitte ergänzen "
    "sin falta aún aun no hay aquí aqui por favor luego más mas tarde función funcion de la el una un disponible añadir agregar".split()
)
# Words with which a sentence about a function says no more than its name and parameters do.
_ABOUT = frozenset(
    "a an the this that it its is are of for to in on by as and or with from which takes take taking given using uses "
    "will would can does do function method macro guard delegate helper routine call calls called calling "
    "return returns returned returning result results value values argument arguments arg args parameter parameters param params "
    "accepts accept receives receive its their named name no none any "
    "funktion die der das eine ein mit und von diese methode gibt zurück "
    "función funcion la el los las una un con y de esta este método metodo devuelve".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_DIRECTIVE = re.compile(
    r"^(?:[\w.-]+:(?:disable|enable|ignore|off|on|skip|allow|next|this|todo)[\w-]*(?:\s.*)?"
    r"|[a-z]+(?:-[a-z]+)*-(?:start|stop|end|begin|ignore|disable|enable|line|file|off|on)(?:-[\w-]+)?(?:\s.*)?"
    r"|(?:dialyzer|credo|sobelow|coveralls|excoveralls|lint|noqa|nolint|rubocop|eslint|pragma|vim?|ex|formatter|region|endregion|iex|type)\s*:.*"
    r"|(?:noqa|nolint|nosec|endregion|region)\b.*|!.*|-\*-.*)$",
    re.IGNORECASE,
)
_CODE = re.compile(
    r"^(?:(?:def|defp|defmacro|defmacrop|defguard|defguardp|defdelegate|defmodule|defstruct)\s+[\w.]+.*"
    r"|(?:end|else|do)|(?:import|alias|use|require)\s+[A-Z][\w.]*.*|@\w+\s+.*|\|>.*"
    r"|[\w.]+[?!]?\([^()]*\)|[a-z_]\w*\s*=\s*\S.*|(?:if|unless|case|cond|with|for|fn|test|assert)\b.*(?:\bdo|->|,\s*do:.*|==.*)|.*\s->$|IO\.\w+.*)$"
)
_REFERENCE = re.compile(r"^`?&?(?:[A-Z][\w.]*\.)?([a-z_]\w*[?!]?)(?:/\d+|\([^()]*\))?`?\s*(?:[:.-]\s*|$)")


def _stems(words: list[str]) -> set[str]:
    """Words without the endings of plural and third person."""
    out = set()
    for w in words:
        w = w.lower()
        for end in ("ies", "es", "s", "ing", "ed", "d"):
            if w.endswith(end) and len(w) - len(end) > 2:
                out.add(w[: -len(end)] + ("y" if end == "ies" else ""))
        out.add(w)
        out.add(w.rstrip("e"))
    return out


def says_something(line: str, name: str, params: list[str], comment: bool = False) -> bool:
    """Whether one line of documentation tells more than that there is none, or than the function's name does."""
    line = line.strip().strip("*-•").strip() if not comment else line.strip()
    if not _WORD.search(line):
        return False
    if comment and (_DIRECTIVE.match(line) or _CODE.match(line)):
        return False
    rest = line
    if (m := _REFERENCE.match(line)) and m[1] == name:
        rest = line[m.end() :]
    words = [w for w in _WORD.findall(rest)]
    if not words:
        return False
    low = [w.lower() for w in words]
    if low in (["n", "a"], ["no"], ["nil"], ["false"]):
        return False
    if any(w in _NONE_YET for w in low) and all(w in _NONE_YET or w in _FILLER for w in low):
        return False
    own = _stems([w for ident in [name, *params] for w in _WORD.findall(ident.replace("_", " "))])
    return any(w not in _ABOUT and not (_stems([w]) & own) for w in low)


def informative(doc: str, name: str, params: list[str], comment: bool = False) -> bool:
    """Whether any line of the documentation says something; headings and code fences don't count."""
    fenced = False
    for line in doc.split("\n"):
        bare = line.strip()
        if not comment and bare.startswith("```"):
            fenced = not fenced
            continue
        if fenced or (not comment and (bare.startswith(("#", "iex>", "...>", "iex(")) or line.startswith("    "))):
            continue
        if says_something(line, name, params, comment):
            return True
    return False


# ---------------------------------------------------------------- the walk


def _doc_value(text: str, tokens: list[Token], i: int) -> tuple[str | None, bool]:
    """What follows `@doc`: a text, or None; whether it is `false`."""
    n = len(tokens)
    while i < n and tokens[i].kind == "(":
        i += 1
    parts = []
    while i < n and tokens[i].kind in ("string", "heredoc", "sigil"):
        parts.append(literal_text(text, tokens[i]))
        i += 1
        if i < n and tokens[i].kind == "<>":
            i += 1
            while i < n and tokens[i].kind == "eol":
                i += 1
        else:
            break
    if parts:
        return "".join(parts), False
    return None, i < n and text[tokens[i].start : tokens[i].end] in ("false", "nil")


def _head(text: str, tokens: list[Token], i: int) -> tuple[str, list[str], int]:
    """Name, parameters and the index after the parameters of the head whose keyword is at i."""
    n = len(tokens)
    i += 1
    while i < n and tokens[i].kind == "eol":
        i += 1
    if i >= n or tokens[i].kind not in ("ident", "key") and not tokens[i].kind.isidentifier():
        return "", [], i
    name = text[tokens[i].start : tokens[i].end].rstrip(":")
    i += 1
    if i >= n or tokens[i].kind != "(":
        return name, [], i
    depth, i = 1, i + 1
    params: list[str] = []
    current, some = "", False
    while i < n and depth:
        t = tokens[i]
        if t.kind in _OPEN:
            depth, some = depth + 1, True
        elif t.kind in _CLOSE:
            depth -= 1
            some = some or depth > 0
        elif t.kind == "," and depth == 1:
            params.append(current or f"arg{len(params) + 1}")
            current, some = "", False
        elif t.kind != "eol":
            some = True
            if t.kind == "=" and depth == 1:
                current = ""
            elif t.kind == "ident" and depth == 1 and not current:
                word = text[t.start : t.end]
                current = "" if word == "_" else word
        i += 1
    if some:
        params.append(current or f"arg{len(params) + 1}")
    return name, params, i


def _body_end(tokens: list[Token], i: int) -> int:
    """Index after the function whose head's parameters end before i: after the matching `end`, or, without a
    block, after the last line of the statement."""
    n, brackets, start = len(tokens), 0, i
    while i < n:
        k = tokens[i].kind
        if k in _OPEN:
            brackets += 1
        elif k in _CLOSE:
            brackets -= 1
        elif k == "do" and brackets <= 0:
            depth, i = 1, i + 1
            while i < n and depth:
                k = tokens[i].kind
                depth += (k in ("do", "fn")) - (k == "end")
                i += 1
            return i
        elif k == "fn":
            depth, i = 1, i + 1
            while i < n and depth:
                k = tokens[i].kind
                depth += (k in ("do", "fn")) - (k == "end")
                i += 1
            continue
        elif k == "eol" and brackets <= 0:
            before = tokens[i - 1].kind if i > start else ""
            j = i + 1
            while j < n and tokens[j].kind == "eol":
                j += 1
            after = tokens[j].kind if j < n else ""
            if before not in (",", "|>", "=", "<>", "->", "when", "key", "\\\\", "||", "&&") and after not in ("|>", "do", "<>", "when"):
                return i
            i = j
            continue
        elif k in DEF_WORDS or k in MODULE_WORDS:
            return i
        i += 1
    return n


def pairs(text: str) -> Iterator[dict]:
    """Every function of a source text with its documentation (None without any), in order of its first clause.

    Undefined or unterminated code gives what can be read of it. Line ends of either kind, a byte-order mark and an
    empty text are no special cases.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    every = tokenize(text, comments=True)
    tokens = [t for t in every if t.kind != "comment"]
    own_line = {}
    previous_line = 0
    for t in every:
        if t.kind == "comment" and previous_line != t.line:
            own_line[t.line] = text[t.start + 1 : t.end].lstrip("#").strip()
        if t.kind != "eol":
            previous_line = t.line + text.count("\n", t.start, t.end)
    modules: list[tuple[str, int]] = []
    found: dict[tuple, dict] = {}
    doc: tuple[str | None, bool] | None = None
    top = 0  # first line of the attributes that stand directly above the current place, 0 without any
    last_line = 0
    depth, i, n = 0, 0, len(tokens)
    while i < n:
        t = tokens[i]
        starts = i == 0 or tokens[i - 1].kind in ("eol", ";", "do")
        if t.kind == "eol":
            i += 1
            continue
        if starts and t.kind == "attr":
            word = text[t.start + 1 : t.end]
            if not (top and last_line == t.line - 1):
                top = t.line
            if word == "doc":
                value, false = _doc_value(text, tokens, i + 1)
                if value is not None or false:
                    doc = (value, false)
            elif word in ("callback", "macrocallback"):
                doc = None
            brackets = 0
            i += 1
            while i < n and not (tokens[i].kind == "eol" and brackets <= 0 and tokens[i - 1].kind not in (",", "<>", "|", "::")):
                brackets += (tokens[i].kind in _OPEN) - (tokens[i].kind in _CLOSE)
                if tokens[i].kind in DEF_WORDS and tokens[i - 1].kind == "eol":
                    break
                i += 1
            last = tokens[i - 1]
            last_line = last.line + text.count("\n", last.start, last.end)
            continue
        if starts and t.kind in MODULE_WORDS:
            j, name = i + 1, ""
            while j < n and tokens[j].kind in ("module", "."):
                name += text[tokens[j].start : tokens[j].end]
                j += 1
            while j < n and tokens[j].kind not in ("do", "eol") or (j < n and tokens[j].kind == "eol" and tokens[j - 1].kind == ","):
                j += 1
            if j < n and tokens[j].kind == "do":
                outer = modules[-1][0] if modules else ""
                modules.append((f"{outer}.{name}" if outer and "." not in name else name, depth))
                depth += 1
                j += 1
            doc, top, i = None, 0, j
            continue
        if starts and t.kind in DEF_WORDS:
            name, params, j = _head(text, tokens, i)
            stop = _body_end(tokens, j)
            module = modules[-1][0] if modules else ""
            key = (module, name, len(params))
            if name:
                above = top if top and last_line == t.line - 1 else t.line
                lines = []
                while above - 1 in own_line:
                    above -= 1
                    lines.append(own_line[above])
                comment = "\n".join(reversed(lines)) or None
                last = tokens[stop - 1] if stop > i else t
                entry = found.get(key)
                if entry is None:
                    found[key] = entry = {
                        "line": t.line, "kind": t.kind, "module": module, "function": name, "arity": len(params),
                        "params": params, "doc": None, "doc_origin": None, "code": text[t.start : last.end],
                    }
                    if doc is None and comment is not None:
                        entry["doc"], entry["doc_origin"] = comment, "comment"
                elif t.kind == entry["kind"]:
                    entry["code"] += "\n\n" + text[t.start : last.end]
                if doc is not None:
                    entry["doc"], entry["doc_origin"] = doc[0], "attribute" if doc[0] is not None else "false"
            doc, top = None, 0
            i = max(stop, i + 1)
            continue
        top = 0
        if t.kind in ("do", "fn"):
            depth += 1
        elif t.kind == "end":
            depth -= 1
            if modules and depth <= modules[-1][1]:
                modules.pop()
            doc = None
        i += 1
    yield from found.values()


def documented_functions(sources: DataFrame, kinds: tuple[str, ...] = PAIRED_KINDS, trivial: bool = False) -> DataFrame:
    """Code–description pairs of `sources` (path, source_text, read_at): columns of PAIR_SCHEMA.

    A file read more than once counts as last read; of equally late readings the greatest text counts. Nulls: a
    NULL path or text is left out. Functions without documentation, or whose documentation is blank, a placeholder,
    a repetition of their name, or (comments) a marker, a directive or disabled code are left out; with `trivial` every
    documentation is kept, whatever it says. Empty texts give nothing; long ones are read whole; extra columns are ignored.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["source_text"], strict=True):
                for p in pairs(text):
                    if p["kind"] not in kinds or p["doc"] is None:
                        continue
                    if trivial or informative(p["doc"], p["function"], p["params"], p["doc_origin"] == "comment"):
                        rows.append({"path": path, **p})
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "module", "function", "arity", "params", "doc", "doc_origin", "code"])

    return latest_texts(sources).mapInPandas(extract, PAIR_SCHEMA)
