"""Filling fixed-capacity containers with documents.

Lexical retrieval packing: documents are dealt to shards of a bounded number of tokens; each shard builds a BM25
inverted index over its items. The largest unused item seeds a container, its best unused neighbours by BM25 fill it,
and when little room is left the largest item that fits goes in. An item is a document, or, of one larger than the
container, what is left after whole containers were cut from its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.tokens import VOCABULARY, with_tokens
from codequarry.session import width, workspace

SHARD_TOKENS = 1_000_000
#: With less room left than this share of the capacity, the largest item that fits is taken, whatever its words.
LAST_ROOM = 0.3
K1, B = 1.2, 0.75
PACKED = "container string, bin string, doc_id bigint, part int, token_start bigint, n_tokens bigint"


class LexicalIndex:
    """BM25 over items given as arrays of token ids."""

    def __init__(self, items: list[np.ndarray]):
        n = len(items)
        counted = [np.unique(x, return_counts=True) for x in items]
        self.terms = [t for t, _ in counted]
        item = np.repeat(np.arange(n), [len(t) for t, _ in counted])
        term = np.concatenate([t for t, _ in counted]).astype(np.int64) if n else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in counted]).astype(np.float32) if n else np.zeros(0, np.float32)
        length = np.array([len(x) for x in items], np.float32)
        mean = max(1.0, float(length.mean())) if n else 1.0
        size = int(term.max()) + 1 if len(term) else 1
        df = np.bincount(term, minlength=size)
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
        value = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
        useful = value > 0  # words in more than half of the items weigh nothing
        item, term, value = item[useful], term[useful], value[useful]
        order = np.argsort(term, kind="stable")
        self.item, self.value = item[order], value[order]
        self.start = np.r_[0, np.cumsum(np.bincount(term, minlength=size))]
        self.n = n

    def scores(self, query: int) -> np.ndarray:
        """The score of every item for the words of item `query`."""
        t = self.terms[query].astype(np.int64)
        lo, hi = self.start[t], self.start[t + 1]
        n = hi - lo
        t_all = int(n.sum())
        if not t_all:
            return np.zeros(self.n)
        at = np.arange(t_all) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.bincount(self.item[at], weights=self.value[at], minlength=self.n)


def fill(sizes: np.ndarray, items: list[np.ndarray], capacity: int) -> list[list[int]]:
    """Containers of item numbers; every item is in one. Sizes are from 1 to the capacity."""
    index = LexicalIndex(items)
    # Items by size, so that those that fit are a run from the start; used ones are dropped once they are the half.
    item = np.argsort(sizes, kind="stable")
    size, unused, n_used = sizes[item], np.ones(len(sizes), bool), 0
    top = len(item) - 1
    bins = []

    def take(at: int) -> int:
        nonlocal n_used
        unused[at] = False
        n_used += 1
        return int(item[at])

    while True:
        while top >= 0 and not unused[top]:
            top -= 1
        if top < 0:
            return bins
        room = capacity - int(size[top])
        seed = take(top)
        content, score = [seed], None
        while room > 0:
            fits = np.flatnonzero(unused[: np.searchsorted(size, room, "right")])
            if not len(fits):
                break
            if score is None:
                score = index.scores(seed)
            if room <= LAST_ROOM * capacity:
                fits = fits[size[fits] == size[fits[-1]]]
            at = int(fits[score[item[fits]].argmax()])
            room -= int(size[at])
            content.append(take(at))
        bins.append(content)
        if 2 * n_used > len(item):
            item, size = item[unused], size[unused]
            unused, n_used, top = np.ones(len(item), bool), 0, len(item) - 1


def pack_shard(shard: int, doc_ids: list[int], tokens: list[np.ndarray], containers: list[tuple[str, int]]) -> list[tuple]:
    """Rows of PACKED for one shard."""
    rows = []
    by_id = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i], len(tokens[i])))
    for name, capacity in containers:
        n_bins = 0
        items, item_of, sizes, empty = [], [], [], []
        for i in by_id:
            n = len(tokens[i])
            whole = n // capacity if n > capacity else 0
            for k in range(whole):
                rows.append((name, f"{shard}-{n_bins}", doc_ids[i], k, k * capacity, capacity))
                n_bins += 1
            if n - whole * capacity:
                items.append(tokens[i][whole * capacity :])
                item_of.append((doc_ids[i], whole, whole * capacity))
                sizes.append(n - whole * capacity)
            elif not n:
                empty.append(doc_ids[i])
        for content in fill(np.array(sizes, np.int64), items, capacity):
            rows += [(name, f"{shard}-{n_bins}", *item_of[i], sizes[i]) for i in content]
            n_bins += 1
        # Documents without tokens take no room; they lie in the shard's first container.
        rows += [(name, f"{shard}-0", d, 0, 0, 0) for d in empty]
    return rows


def pack(
    spark: SparkSession,
    documents: DataFrame,
    containers: list[tuple[str, int]],
    shard_tokens: int = SHARD_TOKENS,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Every document's place in containers of every capacity: rows of PACKED.

    A document of up to `capacity` tokens lies whole in one container; a larger one is cut into whole containers and a
    rest. `containers` is a short list of names and capacities (NULL or less than one: left out). Nulls: rows without
    doc_id are left out; a NULL or empty text has no tokens and comes out with n_tokens 0. Repeated rows are packed as
    often as they are there. Extra columns are ignored; without documents the result is empty.
    """
    usable = [(c, int(n)) for c, n in containers if c is not None and n is not None and n >= 1]
    folder = workspace(spark, "tokens")
    with_tokens(documents.where("doc_id IS NOT NULL"), ["doc_id"], vocabulary).write.parquet(folder)
    table = spark.read.schema("doc_id bigint, n_tokens bigint, tokens binary").parquet(folder)
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    n_shards = max(1, -(-total // shard_tokens))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = PACKED.replace(",", "").split()[::2]
        current, doc_ids, tokens = None, [], []
        for b in batches:
            for shard, doc_id, x in zip(b["shard"], b["doc_id"], b["tokens"], strict=True):
                if shard != current and doc_ids:
                    yield pd.DataFrame(pack_shard(current, doc_ids, tokens, usable), columns=names)
                    doc_ids, tokens = [], []
                current = shard
                doc_ids.append(doc_id)
                tokens.append(np.frombuffer(x, np.uint16))
        if doc_ids:
            yield pd.DataFrame(pack_shard(current, doc_ids, tokens, usable), columns=names)

    return (
        table.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).alias("shard"), "doc_id", "tokens")
        .repartition(min(n_shards, max(width(spark), n_shards // 16)), "shard")
        .sortWithinPartitions("shard")
        .mapInPandas(run, PACKED)
    )


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """For each capacity the number of containers, of documents' parts, and the share of the room that is filled."""
    bins = packed.groupBy("container", "bin").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("parts"))
    return (
        bins.groupBy("container")
        .agg(F.count("*").alias("n_bins"), F.sum("parts").alias("n_parts"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
        .join(F.broadcast(containers.select("container", "capacity_tokens")), "container")
        .withColumn("filled", F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")))
    )
