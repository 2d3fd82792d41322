import pytest

from codequarry.lang.lexer import line_col_to_offset, line_starts, literal_text, token_at, tokenize


def kinds(text):
    return [t.kind for t in tokenize(text) if t.kind != "eol"]


def words(text):
    return [text[t.start : t.end] for t in tokenize(text) if t.kind != "eol"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("", []),
        ("def a, do: 1", ["def", "ident", ",", "key", "number"]),
        ("x.end", ["ident", ".", "ident"]),
        ("Foo.Bar.baz", ["module", ".", "module", ".", "ident"]),
        ("__MODULE__", ["module"]),
        ('"a #{b <> "}"} c" x', ["string", "ident"]),
        ('"""\n def x do\n """\ny', ["heredoc", "ident"]),
        ("~S|a # b| x", ["sigil", "ident"]),
        ("~s(a (b) c) x", ["sigil", "ident"]),
        ('~s"""\n"\n"""i x', ["sigil", "ident"]),
        ("?\" ?a ?\\n x", ["char", "char", "char", "ident"]),
        (":a :\"b c\" :+ :a?", ["atom", "atom", "atom", "atom"]),
        ("a |> b \\\\ c -> d <- e => f :: g", ["ident", "|>", "ident", "\\\\", "ident", "->", "ident", "<-", "ident", "=>", "ident", "::", "ident"]),
        ("<<1, 2>>", ["<<", "number", ",", "number", ">>"]),
        ("valid? put! 0x1F 1_000.5e3", ["ident", "ident", "number", "number"]),
        ("@doc @spec", ["attr", "attr"]),
        ("# a def\nb # c", ["ident"]),
        ("'a' 'b#{c}'", ["string", "string"]),
        ("Élan.x", ["module", ".", "ident"]),
    ],
)
def test_kinds(text, want):
    assert kinds(text) == want


def test_lines_of_opaque_tokens_are_their_first():
    text = 'a\n"""\nx\n"""\nb'
    assert [(t.kind, t.line) for t in tokenize(text) if t.kind != "eol"] == [("ident", 1), ("heredoc", 2), ("ident", 5)]


@pytest.mark.parametrize("text", ['"abc', '"""\nabc', "~s(abc", '"#{', "~S", "?", ":", '"#{"', "'", "@", "\\", "#{"])
def test_unfinished_text_ends(text):
    tokens = tokenize(text)
    assert all(a.end <= b.start for a, b in zip(tokens, tokens[1:], strict=False)) and all(t.end <= len(text) for t in tokens)


def test_very_long_texts():
    text = "x = \"" + "a" * 2_000_000 + "\"\n" + "b\n" * 100_000
    assert tokenize(text)[-1].line == 100_001


def test_offsets():
    text = "ab\ncd e"
    tokens = tokenize(text)
    assert line_starts(text) == [0, 3]
    assert line_col_to_offset([0, 3], 2, 3) == 6 and line_col_to_offset([0, 3], 3, 0) == -1
    assert text[tokens[token_at(tokens, 4)].start :].startswith("cd") and token_at(tokens, 5) == -1


def test_literal_text():
    for text, want in [('"a\\nb"', "a\nb"), ('~S(a\\n)', "a\\n"), ('"""\n  a\n   b\n  """', "a\n b"), ("~s|x|", "x"), ('""', "")]:
        assert literal_text(text, tokenize(text)[0]) == want


def test_comments_when_asked_for():
    assert [t.kind for t in tokenize("a # b", comments=True)] == ["ident", "comment"]
