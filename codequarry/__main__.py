"""Command line: python -m codequarry init|reindex|lookup|references|version. Answers are lines of `path:line`."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from codequarry.operators.composite import lookup_locations, reference_locations
from codequarry.sources.ingest import INDEX_VERSION, Index


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="codequarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, said in (("init", "index a tree from nothing"), ("reindex", "take in what changed in a tree or a file")):
        c = commands.add_parser(name, help=said)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--stdlib", default="", help="root of the shared library's sources")
        c.add_argument("--index", default="", help="folder of the index; .codequarry in the tree by default")
        if name == "init":
            c.add_argument("--force", action="store_true", help="build anew what is there")
        else:
            c.add_argument("--prune", action="store_true", help="take out files that are gone")
    for name, said in (("lookup", "where a module or function is defined"), ("references", "where it is referred to")):
        c = commands.add_parser(name, help=said)
        c.add_argument("module")
        c.add_argument("function", nargs="?", default="")
        c.add_argument("--index", default=".codequarry")
        if name == "lookup":
            c.add_argument("--strict", action="store_true", help="no module's place for a function that is not there")
            c.add_argument("--no-follow-delegates", action="store_true")
    commands.add_parser("version")
    return parser.parse_args(argv)


def _folder(path: str) -> str:
    return path if ":" in path else "file://" + os.path.abspath(path)


def run(spark: SparkSession, argv: list[str]) -> tuple[int, list[str]]:
    """Exit code and lines of output of a command."""
    a = _arguments(argv)
    if a.command == "version":
        return 0, [str(INDEX_VERSION)]
    if a.command in ("init", "reindex"):
        root = os.path.abspath(a.path)
        tree = root if os.path.isdir(root) else os.path.dirname(root)
        index = Index(spark, _folder(a.index or os.path.join(tree, ".codequarry")))
        if a.command == "init":
            try:
                index.build(tree, a.stdlib, force=a.force)
            except FileExistsError as there:
                return 1, [str(there)]
        elif os.path.isdir(root):
            index.refresh(tree, a.stdlib, prune=a.prune)
        else:
            index.apply_changes(spark.createDataFrame([(1, "change", root)], "seq bigint, op string, path string"))
        return 0, [f"{index.files().count()} files, {index.definitions().count()} definitions, {index.refs().count()} references"]
    index = Index(spark, _folder(a.index))
    keys = spark.createDataFrame([(a.module, a.function)], "module string, function string")
    if a.command == "lookup":
        rows = lookup_locations(index.definitions(), keys, follow=not a.no_follow_delegates, strict=a.strict and bool(a.function))
    else:
        rows = reference_locations(index.refs(), keys)
    # The answer to one question, as it is printed.
    lines = [r.location for r in rows.select("location").collect()]
    lines.sort(key=lambda x: (x.rpartition(":")[0], int(x.rpartition(":")[2])))
    return (0 if lines else 1), lines


def main() -> int:
    from codequarry.session import local_session

    code, lines = run(local_session(), sys.argv[1:])
    for line in lines:
        print(line)
    return code


if __name__ == "__main__":
    sys.exit(main())
