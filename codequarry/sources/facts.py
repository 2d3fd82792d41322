"""The tokenizer and the parser as table functions over source texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.lang.lexer import tokenize
from codequarry.lang.parser import facts
from codequarry.lang.using import using_bodies
from codequarry.session import width, workspace, written

_FACTS = (
    "fact string, module string, function string, arity int, kind string, line int, file_path string, "
    "delegate_to string, delegate_as string, params string"
)
_NAMES = [x.split()[0] for x in _FACTS.split(", ")]


def parse_facts(sources: DataFrame, edges: bool = False) -> DataFrame:
    """Facts of `sources` (path, source_text): definitions and references, told apart by `fact`. NULL texts: none.

    With `edges` also what using modules brings (rows of `text_tables.using_edges`), read by `parsed_edges`.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["source_text"], strict=True):
                ds, rs = facts(text)
                rows += [("definition", d.module, d.function, d.arity, d.kind, d.line, path, d.delegate_to, d.delegate_as, d.params) for d in ds]
                rows += [("reference", r.module, r.function, None, r.kind, r.line, path, None, None, None) for r in rs]
                if edges and "using" in text:
                    for module, body in using_bodies(text):
                        rows += [("edge", module, f, a, kind, n, path, target, option, None) for kind, n, target, f, a, option in body.edges()]
            yield pd.DataFrame(rows, columns=_NAMES).astype({"arity": "Int32", "line": "Int32"})

    return sources.where("source_text IS NOT NULL").select("path", "source_text").mapInPandas(parse, _FACTS)


def parsed_definitions(parsed: DataFrame) -> DataFrame:
    return parsed.where("fact = 'definition'").drop("fact")


def parsed_references(parsed: DataFrame) -> DataFrame:
    return parsed.where("fact = 'reference'").select("module", "function", "line", "file_path", "kind")


def parsed_edges(parsed: DataFrame) -> DataFrame:
    return parsed.where("fact = 'edge'").select(
        "module", "kind", F.col("line").alias("ordinal"), F.col("delegate_to").alias("target"), "function", "arity", F.col("delegate_as").alias("option"), "file_path"
    )


def tokens(sources: DataFrame) -> DataFrame:
    """path, ordinal, kind, text, start, end, line of every token; offsets are characters."""

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "ordinal", "kind", "text", "start", "end", "line"]
        for b in batches:
            for path, text in zip(b["path"], b["source_text"], strict=True):
                found = tokenize(text)
                yield pd.DataFrame(
                    [(path, i, t.kind, text[t.start : t.end], t.start, t.end, t.line) for i, t in enumerate(found)], columns=names
                )

    return (
        sources.where("source_text IS NOT NULL")
        .select("path", "source_text")
        .mapInPandas(lex, "path string, ordinal int, kind string, text string, start int, end int, line int")
    )


def token_counts(sources: DataFrame) -> DataFrame:
    """path, kind, n: how many tokens of each kind a file has, counted before anything leaves the task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["source_text"], strict=True):
                kinds = pd.Series([t.kind for t in tokenize(text)], dtype=object).value_counts()
                rows += [(path, k, int(n)) for k, n in kinds.items()]
            yield pd.DataFrame(rows, columns=["path", "kind", "n"])

    return sources.where("source_text IS NOT NULL").select("path", "source_text").mapInPandas(count, "path string, kind string, n bigint")


#: Paths that were read more than once: up to so many of them (about 10 MB) are sent to every task.
MANY_AGAIN = 100_000


def latest_texts(sources: DataFrame) -> DataFrame:
    """path, source_text as last read, NULL texts left out; of equally late readings the greatest text.

    Paths are counted first, without their texts. Texts of paths that were read once are not compared with others; only
    readings of the rest are reduced by path, before they travel. Where few paths were read again these are broadcast, so
    that texts travel once: to the tasks that parse them, of which there is a fixed number, since adaptive execution would
    merge partitions by their bytes, not by the time that parsing takes.
    """
    spark = sources.sparkSession
    folder = workspace(spark, "again")
    again = sources.where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")
    few = written(again, folder) <= MANY_AGAIN
    again = spark.read.schema("path string").parquet(folder)
    asked = F.broadcast(again) if few else again
    readable = sources.where("path IS NOT NULL AND source_text IS NOT NULL")
    once = readable.select("path", "source_text").join(asked, "path", "left_anti")
    last = (
        readable.select("path", "source_text", "read_at")
        .join(asked, "path", "left_semi")
        .groupBy("path")
        .agg(F.max(F.struct("read_at", "source_text")).alias("s"))
        .select("path", F.col("s.source_text").alias("source_text"))
    )
    return once.unionByName(last).repartition(width(spark), F.xxhash64("path"))
