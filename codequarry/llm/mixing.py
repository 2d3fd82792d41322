"""Mixing sources to target weights.

Each source's tokens are packed into blocks of one length. Every output shard draws how many of its slots each source
gets from a multinomial distribution, conditioned so that every stretch of shards keeps the target shares (in slots; a
source's last blocks may be short, so its share of tokens is near, not equal); the slots of a source, counted through all
shards, run through pseudorandom permutations of its blocks, one for each repetition, and are joined with the blocks by
index. The mixture is as long as the scarcest source allows within its repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.llm.tokens import VOCABULARY, with_tokens
from codequarry.session import width, workspace

BLOCK_TOKENS = 1024
#: Tokens of one stretch of a source that is packed in one go; its last block may be short.
CHUNK_TOKENS = 4_000_000
SHARD_SLOTS = 256
#: Slots over which the shares are kept exactly; within such a stretch the shards' counts are drawn.
STRETCH_SLOTS = 1 << 20
SEED = 20240101
_PIECES = "array<struct<doc_id: bigint, token_start: bigint, n_tokens: bigint>>"
_BLOCKS = f"source string, chunk bigint, local bigint, n_tokens bigint, pieces {_PIECES}"


def source_name(column: Column) -> Column:
    """The one spelling of a source: lower case, stripped; NULL stays NULL."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def blocks_of(spark: SparkSession, documents: DataFrame, sources: list[str], block_tokens: int, chunk_tokens: int, vocabulary: str) -> DataFrame:
    """source, index, n_tokens, pieces: the blocks of each source, numbered from 0. Written once."""
    rows = documents.where("doc_id IS NOT NULL").withColumn("source", source_name(F.col("source"))).where(F.col("source").isin(sources))
    sized = workspace(spark, "sizes")
    with_tokens(rows, ["source", "doc_id"], vocabulary, tokens=False).where("n_tokens > 0").write.parquet(sized)
    table = spark.read.schema("source string, doc_id bigint, n_tokens bigint").parquet(sized)
    # One row for each source of the mixture: bounded by the target table.
    totals = table.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    chunks = totals.select("source", F.ceil(F.col("total") / chunk_tokens).alias("n_chunks"))
    dealt = table.join(F.broadcast(chunks), "source").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("n_chunks")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source", "chunk", "local", "n_tokens", "pieces"]
        key, local, room, pieces, out = None, 0, block_tokens, [], []

        def close():
            nonlocal local, room, pieces
            if pieces:
                out.append((*key, local, block_tokens - room, pieces))
                local, room, pieces = local + 1, block_tokens, []

        for b in batches:
            for source, chunk, doc_id, n in zip(b["source"], b["chunk"], b["doc_id"], b["n_tokens"], strict=True):
                if (source, chunk) != key:
                    close()
                    key, local = (source, chunk), 0
                at = 0
                while at < n:
                    take = min(room, n - at)
                    pieces.append({"doc_id": doc_id, "token_start": at, "n_tokens": take})
                    at, room = at + take, room - take
                    if not room:
                        close()
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    cut_blocks = (
        dealt.select("source", "chunk", "doc_id", "n_tokens")
        .repartition(width(spark), "source", "chunk")
        .sortWithinPartitions("source", "chunk", "doc_id", "n_tokens")
        .mapInPandas(cut, _BLOCKS)
    )
    folder = workspace(spark, "blocks")
    cut_blocks.write.parquet(folder)
    blocks = spark.read.schema(_BLOCKS).parquet(folder)
    counts = blocks.groupBy("source", "chunk").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("chunk") / 1000))
    # Blocks before a chunk: those of earlier groups of chunks, then those of earlier chunks of its group.
    earlier = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("source", "group").agg(F.sum("n").alias("n")).select("source", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    before = Window.partitionBy("source", "group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select("source", "group", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("more"))
    offsets = within.join(groups, ["source", "group"]).select("source", "chunk", (F.col("start") + F.col("more")).alias("offset"))
    return blocks.join(offsets, ["source", "chunk"]).select("source", (F.col("offset") + F.col("local")).alias("index"), "n_tokens", "pieces")


def permuted(position: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of [0, size): a four-round Feistel network, walked until it falls inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [np.uint64(x) for x in np.random.default_rng([key & 0xFFFFFFFF, key >> 32]).integers(1, 2**63, 4)]

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in rounds:
            mixed = (right + r) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        x = step(position.astype(np.uint64))
        outside = x >= size
        while outside.any():
            x[outside] = step(x[outside])
            outside = x >= size
    return x.astype(np.int64)


def quotas(shares: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Slots of each source: the longest mixture in which every source has its share and none more than `most`."""
    if not len(shares):
        return np.zeros(0, np.int64)
    return np.minimum(np.floor((most / shares).min() * shares + 1e-9).astype(np.int64), most)


def shard_counts(shard: int, totals: np.ndarray, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many slots of a shard each source gets, and how many it had in all shards before.

    The shards form stretches of about STRETCH_SLOTS slots. A stretch has of every source what lies between its ends on the
    way from 0 to `totals`, in whole slots. The counts of its shards are a multinomial draw under the condition that they
    add up to that: the range of its shards is halved again and again, and the sources' slots are split between the halves
    hypergeometrically, with a generator seeded by the range. Every shard repeats only the splits on its own way down.
    """
    n_shards = -(-int(totals.sum()) // shard_slots)
    stretch = max(1, STRETCH_SLOTS // shard_slots)
    lo = shard // stretch * stretch
    hi = min(lo + stretch, n_shards)
    until = lambda at: np.array([int(t) * at // n_shards for t in totals], np.int64)
    before = until(lo)
    here = until(hi) - before
    size = max(shard_slots, -(-int(here.sum()) // (hi - lo)))  # whole slots: a stretch may have a few more than its shards' slots
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = min((mid - lo) * size, int(here.sum()))
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, n, method="marginals")
        if shard < mid:
            here, hi = left, mid
        else:
            before, here, lo = before + left, here - left, mid
    return here, before


def wanted_sources(targets: list[tuple[str, float, int]]) -> dict[str, list]:
    """Share and greatest number of repeats of each source that can take part."""
    wanted: dict[str, list] = {}
    for source, share, repeats in targets:
        if source is not None and share and share > 0 and repeats and repeats > 0:
            entry = wanted.setdefault(source.strip().lower(), [0.0, 0])
            entry[0] += share
            entry[1] = max(entry[1], int(repeats))
    return wanted


def mix(
    spark: SparkSession,
    documents: DataFrame,
    targets: list[tuple[str, float, int]],
    block_tokens: int = BLOCK_TOKENS,
    chunk_tokens: int = CHUNK_TOKENS,
    shard_slots: int = SHARD_SLOTS,
    vocabulary: str = VOCABULARY,
    seed: int = SEED,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """shard, slot, source, repeat, index, n_tokens, pieces: one mixture of the sources of `targets`.

    `targets` is a short list of source, target share and greatest number of repeats. Sources that have no tokens, a
    share or repeats of 0 or NULL get nothing, and the others' shares are scaled up to 1. No block is used more often
    than its source's repeats allow. `pieces` are the stretches of documents that a block is made of. Nulls: documents
    without doc_id or source are left out, NULL and empty texts have no tokens. Repeated rows count as often as they are
    there. Extra columns are ignored; without usable documents the result is empty. Who needs the blocks of `blocks_of` too
    makes them first and passes them as `blocks`.
    """
    wanted = wanted_sources(targets)
    if blocks is None:
        blocks = blocks_of(spark, documents, list(wanted), block_tokens, chunk_tokens, vocabulary)
    n_blocks = {r["source"]: r["count"] for r in blocks.groupBy("source").count().collect()}  # one row for each source
    names = sorted(s for s in wanted if n_blocks.get(s))
    shares = np.array([wanted[s][0] for s in names])
    shares = shares / shares.sum() if len(names) else shares
    size = {s: n_blocks[s] for s in names}
    most = np.array([wanted[s][1] * size[s] for s in names])
    totals = quotas(shares, most)
    n_shards = -(-int(totals.sum()) // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for shard in b["id"]:
                counts, before = shard_counts(int(shard), totals, shard_slots, seed)
                rows += [(shard, *x) for x in zip(names, before.tolist(), counts.tolist(), strict=True)]
            yield pd.DataFrame(rows, columns=["shard", "source", "first", "n"])

    drawn = spark.range(n_shards).mapInPandas(draw, "shard bigint, source string, first bigint, n bigint")
    slots = drawn.where("n > 0").select("shard", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("g"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, part in b.groupby("source", sort=False):
                n, k = size[source], names.index(source)
                part = part.assign(repeat=part["g"].to_numpy() // n)
                for r, own in part.groupby("repeat", sort=False):
                    own = own.assign(index=permuted(own["g"].to_numpy() % n, n, seed * 1_000_003 + k * 1009 + int(r)))
                    out.append(own[["shard", "source", "g", "repeat", "index"]])
            if out:
                yield pd.concat(out)

    placed = slots.mapInPandas(place, "shard bigint, source string, g bigint, repeat bigint, index bigint")
    in_shard = Window.partitionBy("shard").orderBy(F.xxhash64("source", "g"), "source", "g")
    numbered = placed.withColumn("slot", F.row_number().over(in_shard) - 1)  # a shard has about shard_slots rows
    return numbered.join(blocks, ["source", "index"]).select("shard", "slot", "source", "repeat", "index", "n_tokens", "pieces")


def share_report(mixture: DataFrame, targets: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """For each source of the target table the tokens in the mixture and the share reached, beside the target.

    With `blocks` (of `blocks_of`) also how many tokens the source has, and how many of them the mixture leaves unused.
    """
    used = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.max("repeat").alias("last_repeat"), F.sum(F.when(F.col("repeat") == 0, F.col("n_tokens"))).alias("once")
    )
    # One row for each source: a single partition of them is as small as the target table.
    used = used.withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    rows = targets.withColumn("source", source_name(F.col("source"))).join(F.broadcast(used), "source", "left_outer")
    more = []
    if blocks is not None:
        rows = rows.join(F.broadcast(blocks.groupBy("source").agg(F.sum("n_tokens").alias("available"))), "source", "left_outer")
        available = F.coalesce("available", F.lit(0))
        # The first repetition has every block at most once, later ones only blocks that it had before.
        more = [available.alias("n_available"), (available - F.coalesce("once", F.lit(0))).alias("n_unused")]
    return rows.select(
        "source",
        "target_share",
        F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce(F.col("last_repeat") + 1, F.lit(0)).alias("n_repeats"),
        "max_repeats",
        *more,
    )
