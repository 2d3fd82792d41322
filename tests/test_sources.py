"""Walking, reading and storing source trees; incremental runs; the change stream."""

import json
import os

import pytest

from codequarry.operators.composite import lookup_rows, reference_locations
from codequarry.sources import files as S
from codequarry.sources.facts import token_counts, tokens
from codequarry.sources.ingest import INDEX_VERSION, Index
from codequarry.streaming.changes import event_counts, events, follow


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


@pytest.fixture
def project(tmp_path):
    root = str(tmp_path / "project")
    put(root, "lib/a.ex", "defmodule A do\n  def run(x), do: B.help(x)\n  def run(x, y), do: x + y\nend\n")
    put(root, "lib/b.ex", "defmodule B do\n  defdelegate help(x), to: C\nend\n")
    put(root, "lib/deep/c.ex", "defmodule C do\n  def help(1), do: 1\n  def help(x), do: x\nend\n")
    put(root, ".formatter.exs", "[]")
    put(root, "_build/x.ex", "defmodule Hidden do\nend")
    put(root, "node_modules/y.ex", "defmodule Hidden do\nend")
    put(root, "lib/readme.md", "no")
    return root


def names(df, column="path"):
    return sorted(os.path.basename(r[column]) for r in df.collect())


def keys(spark, *rows):
    return spark.createDataFrame(rows, "module string, function string")


def test_walk_and_read(spark, project):
    found = S.walk_files(spark, project)
    assert names(found) == [".formatter.exs", "a.ex", "b.ex", "c.ex"]
    assert names(S.walk_files(spark, project, spread=1)) == names(found)
    assert all(r.mtime > 10**18 for r in found.collect())
    texts = S.read_texts(spark, found)
    assert sum(r.source_text is not None for r in texts.collect()) == 4
    assert S.walk_files(spark, project + "/nowhere").count() == 0


def test_index_lookup_and_references(spark, project, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", n_buckets=3)
    assert index.is_empty() and index.version() == 0
    index.build(project)
    assert index.version() == INDEX_VERSION and not index.is_empty()
    with pytest.raises(FileExistsError):
        index.build(project)
    d, r = index.definitions(), index.refs()
    assert {x.line for x in lookup_rows(d, keys(spark, ("A", "run"))).collect()} == {2, 3}
    assert [(os.path.basename(x.file_path), x.line) for x in lookup_rows(d, keys(spark, ("B", "help"))).orderBy("line").collect()] == [("c.ex", 2), ("c.ex", 3)]
    assert [x.line for x in lookup_rows(d, keys(spark, ("B", "help")), follow=False).collect()] == [2]
    assert [x.line for x in lookup_rows(d, keys(spark, ("A", "nothing"))).collect()] == [1]
    assert lookup_rows(d, keys(spark, ("A", "nothing")), strict=True).count() == 0
    assert [x.location.rsplit("/", 1)[1] for x in reference_locations(r, keys(spark, ("B", "help"))).collect()] == ["a.ex:2"]


def test_refresh_changes_and_prunes(spark, project, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", n_buckets=3)
    index.build(project)
    assert index.refresh(project) == {"changed": 0, "removed": 0}
    path = put(project, "lib/a.ex", "# one\n# more\n\n\ndefmodule A do\n  def run(x), do: x\nend\n")
    os.utime(path, ns=(1, 5))  # an older time is a change too
    os.remove(os.path.join(project, "lib/b.ex"))
    assert index.refresh(project, prune=False) == {"changed": 1, "removed": 0}
    assert [x.line for x in lookup_rows(index.definitions(), keys(spark, ("A", "run"))).collect()] == [6]
    assert index.refresh(project) == {"changed": 0, "removed": 1}
    assert names(index.files()) == [".formatter.exs", "a.ex", "c.ex"]
    assert index.definitions().where("module = 'B'").isEmpty() and index.refs().isEmpty()


def test_version_and_damage_rebuild(spark, project, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", n_buckets=3)
    index.build(project)
    index.set_metadata("index_version", "999")
    assert index.refresh(project)["changed"] == 4
    last = sorted(os.listdir(f"{tmp_path}/index/commits"))[-1]
    with open(f"{tmp_path}/index/commits/99999999.json", "w") as f:
        f.write("{broken")
    assert last and index.is_empty()
    index.build(project, force=True)
    assert index.files().count() == 4


def test_stdlib_gives_definitions_only(spark, project, tmp_path):
    std = str(tmp_path / "std")
    put(std, "lib/k.ex", "defmodule Kernel do\n  def x, do: Other.y()\nend")
    index = Index(spark, f"file://{tmp_path}/index", n_buckets=2)
    index.build(project, std)
    assert index.metadata("stdlib_root") == std
    assert index.definitions().where("module = 'Kernel'").count() == 2 and index.refs().where("module = 'Other'").isEmpty()


def test_a_commit_in_between_is_not_lost(spark, project, tmp_path, monkeypatch):
    """Another writer commits to the same buckets while a write is under way: the write begins anew from there."""
    index, other = (Index(spark, f"file://{tmp_path}/index", n_buckets=1) for _ in range(2))
    index.build(project)
    a, b = (os.path.join(project, f"lib/{x}.ex") for x in "ab")
    put(project, "lib/a.ex", "defmodule A2 do\nend")
    put(project, "lib/b.ex", "defmodule B2 do\nend")
    change = lambda path: spark.createDataFrame([(1, "change", path)], "seq bigint, op string, path string")
    write, calls = Index._write, []

    def interrupted(self, tables, touched):
        calls.append(1)
        if len(calls) == 1:
            other.apply_changes(change(b))
        return write(self, tables, touched)

    monkeypatch.setattr(Index, "_write", interrupted)
    index.apply_changes(change(a))
    found = {r.module for r in index.definitions().collect()}
    assert {"A2", "B2"} <= found and len(calls) == 3


def test_buckets_are_dealt_anew_and_old_folders_taken_away(spark, project, tmp_path, monkeypatch):
    import codequarry.sources.ingest as ingest

    index = Index(spark, f"file://{tmp_path}/index", n_buckets=1)
    index.build(project)
    rows = lambda: sorted(map(str, index.definitions().collect() + index.refs().collect() + index.edges().collect()))
    before = rows()
    index.resize(5)
    assert index.n_buckets == 5 and rows() == before
    assert index.vacuum() >= 1 and index.vacuum() == 0 and rows() == before
    monkeypatch.setattr(ingest, "BUCKET_BYTES", 8)
    put(project, "lib/d.ex", "defmodule D do\n  defmacro __using__(_) do\n    quote do\n      import E\n    end\n  end\nend\n" + "# long\n" * 200)
    assert index.refresh(project)["changed"] == 1
    assert index.n_buckets > 5 and set(before) < set(rows())
    assert [(r.module, r.kind, r.target) for r in index.edges().where("module = 'D'").collect()] == [("D", "import", "E")]


def test_head_is_followed(spark, project, tmp_path):
    import time

    from codequarry.streaming.changes import follow_head, head_of

    index = Index(spark, f"file://{tmp_path}/index", n_buckets=1)
    index.build(project)
    assert head_of(project) == ""
    put(project, ".git/HEAD", "ref: refs/heads/main\n")
    put(project, ".git/refs/heads/main", "one\n")
    assert head_of(project) == "ref: refs/heads/main one"
    query = follow_head(spark, index, project, "1 second")
    try:
        put(project, "lib/new.ex", "defmodule New do\nend")
        put(project, ".git/refs/heads/main", "two\n")
        until = time.time() + 60
        while time.time() < until and index.definitions().where("module = 'New'").isEmpty():
            time.sleep(0.5)
    finally:
        query.stop()
    assert not index.definitions().where("module = 'New'").isEmpty()


@pytest.mark.parametrize("many", [0, 100_000])
def test_the_last_reading_of_a_text_counts(spark, monkeypatch, many):
    """Whether the paths read again are broadcast or not."""
    import datetime as dt

    import codequarry.sources.facts as facts

    monkeypatch.setattr(facts, "MANY_AGAIN", many)
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("a", "once", day(1)), ("b", "old", day(1)), ("b", "new", day(3)), ("b", None, day(4)), ("c", "x", day(2)), ("c", "y", day(2)),
            ("d", None, day(1)), (None, "lost", day(1)), ("e", "", None), ("f", "first", None), ("f", "then", day(1)), ("g", "same", day(1)), ("g", "same", day(1))]
    table = spark.createDataFrame([(*r, 1) for r in rows], "path string, source_text string, read_at timestamp, n int")
    found = facts.latest_texts(table)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "once"), ("b", "new"), ("c", "y"), ("e", ""), ("f", "then"), ("g", "same")]
    assert facts.latest_texts(table.limit(0)).count() == 0


def test_of_several_changes_of_a_buffer_the_last_counts(spark):
    disk = spark.createDataFrame([("a", "disk"), ("b", "disk")], "path string, source_text string")
    changes = spark.createDataFrame([("a", "z", 1), ("a", "y", 2), ("b", "x", 1), ("b", None, 2)], "path string, source_text string, seq int")
    assert {r.path: r.source_text for r in S.with_buffers(disk, changes).collect()} == {"a": "y", "b": "disk"}


def test_change_stream(spark, project, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", n_buckets=2)
    index.build(project)
    log = tmp_path / "log"
    log.mkdir()

    def say(n, *rows):
        (log / f"{n}.json").write_text("\n".join(json.dumps({"seq": s, "op": o, "path": p}) for s, o, p in rows))

    new = put(project, "lib/n.ex", "defmodule N do\n  def n, do: 1\nend")
    gone = os.path.join(project, "lib/b.ex")
    say(1, (1, "create", new), (2, "delete", gone), (3, "change", os.path.join(project, "lib/readme.md")))
    follow(spark, index, str(log), str(tmp_path / "cp")).awaitTermination()
    assert names(index.files()) == [".formatter.exs", "a.ex", "c.ex", "n.ex"]
    os.remove(new)
    say(2, (4, "delete", new), (5, "create", new), (6, "save", os.path.join(project, "lib/a.ex")))
    follow(spark, index, str(log), str(tmp_path / "cp")).awaitTermination()
    assert names(index.files()) == [".formatter.exs", "a.ex", "c.ex"]
    assert event_counts(events(spark, str(log))).isStreaming


def test_buffers_lines_and_tokens(spark):
    disk = spark.createDataFrame([("a", "x\r\ny"), ("b", None)], "path string, source_text string")
    open_ = spark.createDataFrame([("a", "new"), ("c", "own"), ("c", "own")], "path string, source_text string")
    assert {r.path: r.source_text for r in S.with_buffers(disk, open_).collect()} == {"a": "new", "b": None, "c": "own"}
    assert [(r.line, r.text) for r in S.lines(disk).orderBy("line").collect()] == [(1, "x"), (2, "y")]
    asked = spark.createDataFrame([("a", 2), ("a", 9), ("z", 1)], "file_path string, line int")
    assert {(r.file_path, r.line): r.text for r in S.line_of(disk, asked).collect()} == {("a", 2): "y", ("a", 9): "", ("z", 1): None}
    assert [(r.kind, r.line) for r in tokens(disk).orderBy("ordinal").collect()] == [("ident", 1), ("eol", 1), ("ident", 2)]
    assert {r.kind: r.n for r in token_counts(disk).collect()} == {"ident": 2, "eol": 1}


def test_project_roots(spark):
    paths = spark.createDataFrame([("/r/apps/x/lib",), ("/r/z",), ("/else",)], "path string")
    markers = spark.createDataFrame([("/r/.git",), ("/r/apps/x/mix.exs",), ("/r/mix.exs",), ("/else/other",)], "path string")
    found = {r.path: r.root for r in S.project_roots(paths, markers, [".git", "mix.exs"]).collect()}
    assert found == {"/r/apps/x/lib": "/r", "/r/z": "/r", "/else": "/else"}
    found = {r.path: r.root for r in S.project_roots(paths, markers, ["mix.exs"]).collect()}
    assert found == {"/r/apps/x/lib": "/r/apps/x", "/r/z": "/r", "/else": "/else"}


def test_library_root(tmp_path):
    from codequarry.sources.library import library_root

    install = tmp_path / "1.18"
    put(str(install), "lib/elixir/lib/kernel.ex", "")
    empty = str(tmp_path / "empty")
    os.makedirs(os.path.join(empty, "lib"))
    lib = str(install / "lib")
    assert library_root(" /given ", "/env", [str(install)], lib) == "/given" and library_root("", "/env", [str(install)]) == "/env"
    assert library_root("", "", ["", empty, lambda: str(install)], empty) == lib
    assert library_root("", "", [lambda: ""], lib) == lib and library_root("", "", [], empty) == "" and library_root() == ""


def test_incremental_batches_over_a_tree(spark, project, tmp_path):
    from codequarry.operators.incremental import IncrementalBatches

    batches = IncrementalBatches(spark, f"file://{tmp_path}/batches")

    def run(name):
        listing = S.fingerprints(S.walk_files(spark, project))
        return names(batches.run(name, listing, full=True))

    assert run("1") == [".formatter.exs", "a.ex", "b.ex", "c.ex"]
    os.utime(os.path.join(project, "lib/a.ex"), ns=(2**61, 2**61))  # touched, not changed
    os.remove(os.path.join(project, "lib/b.ex"))
    put(project, "lib/deep/c.ex", "defmodule C do\nend\n")
    os.utime(os.path.join(project, "lib/deep/c.ex"), ns=(1, 1))  # changed, with an older time
    assert run("2") == ["c.ex"]
    assert {os.path.basename(r.path) for r in batches.manifest().where("NOT present").collect()} == {"b.ex"}
