"""Per-key results where a few keys hold most rows.

Rows are first freed of repeated deliveries, by a hash aggregation that reduces copies before they travel and leaves the
rows spread evenly over splits, whatever their key. Each split encodes its keys in a dictionary and adds its rows up in
dense arrays with numpy's bincount. What travels on is one number for each split and key, hashed by key; the receiving
task lays the arrays of its block of keys over each other and sums them. No task's work depends on how many rows a key
has, and no dictionary outgrows its bound: a split gives away what it has and begins anew, a block does so with the keys
that are complete, since its input is sorted by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a dictionary holds at most before its sums are given away.
MAX_KEYS = 500_000


class _Block:
    """A growing dictionary of keys with dense accumulators over its codes."""

    def __init__(self, n_sums: int):
        self.code: dict[tuple, int] = {}
        self.sums = [np.zeros(1024, np.int64) for _ in range(n_sums)]

    def add(self, keys: list[pa.Array], values: list[np.ndarray]) -> None:
        """Add values, given for the rows that the keys name."""
        if not len(keys[0]):
            return
        local = [k.dictionary_encode() for k in keys]
        codes = np.zeros(len(keys[0]), np.int64)
        for k in local:
            codes = codes * len(k.dictionary) + k.indices.to_numpy(zero_copy_only=False)
        distinct, inverse = np.unique(codes, return_inverse=True)
        at = np.empty(len(distinct), np.int64)
        words = [k.dictionary.to_pylist() for k in local]
        for i, c in enumerate(distinct.tolist()):
            parts = []
            for w in reversed(words):
                c, r = divmod(c, len(w))
                parts.append(w[r])
            at[i] = self.code.setdefault(tuple(reversed(parts)), len(self.code))
        while len(self.code) > len(self.sums[0]):
            self.sums = [np.concatenate((s, np.zeros(len(s), np.int64))) for s in self.sums]
        for s, v in zip(self.sums, values, strict=True):
            part = np.zeros(len(distinct), np.int64)
            if v is None:
                part = np.bincount(inverse, minlength=len(distinct))
            else:
                np.add.at(part, inverse, v)
            s[at] += part

    def batches(self, names: list[str], step: int = 50_000) -> Iterator[pa.RecordBatch]:
        keys = list(self.code)
        for lo in range(0, len(keys), step):
            hi = min(lo + step, len(keys))
            columns = [pa.array(c, pa.string()) for c in zip(*keys[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(s[lo:hi]) for s in self.sums)], names)


def dense_counts(rows: DataFrame, keys: list[str], row_id: str, sums: list[str], splits: int, max_keys: int = MAX_KEYS) -> DataFrame:
    """The keys with n_rows and the sum of each column of `sums`.

    Rows with equal keys and row_id count once (delivered twice), with the least of each value. Nulls: a NULL key is read
    as '', a NULL value as 0, rows with a NULL row_id count together once for each key. Extra columns are ignored; an empty
    input gives an empty result. Sums are exact over 64-bit integers. `max_keys` bounds the memory of a task; it has no
    influence on the result.
    """
    n_keys = len(keys)
    names = [*keys, "n_rows", *[f"sum_{s}" for s in sums]]
    schema = ", ".join([*[f"`{k}` string" for k in keys], *[f"`{n}` bigint" for n in names[n_keys:]]])

    def split_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(1 + len(sums))
        for b in batches:
            block.add([b.column(i) for i in range(n_keys)], [None, *(b.column(i).to_numpy() for i in range(n_keys, b.num_columns))])
            if len(block.code) >= max_keys:
                yield from block.batches(names)
                block = _Block(1 + len(sums))
        yield from block.batches(names)

    def block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(1 + len(sums))
        for b in batches:
            if not b.num_rows:
                continue
            if len(block.code) >= max_keys and tuple(b.column(i)[0].as_py() for i in range(n_keys)) not in block.code:
                yield from block.batches(names)  # sorted by key: none of these comes again
                block = _Block(1 + len(sums))
            block.add([b.column(i) for i in range(n_keys)], [b.column(i).to_numpy() for i in range(n_keys, b.num_columns)])
        yield from block.batches(names)

    prepared = rows.select(
        F.col(row_id).cast("bigint").alias("_row"),
        *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys],
        *[F.coalesce(F.col(s).cast("bigint"), F.lit(0)).alias(s) for s in sums],
    )
    once = prepared.groupBy("_row", *keys)
    once = once.agg(*[F.min(s).alias(s) for s in sums]) if sums else once.agg(F.lit(0)).drop("0")
    partial = once.select(*keys, *sums).mapInArrow(split_counts, schema)
    return partial.repartition(splits, *keys).sortWithinPartitions(*keys).mapInArrow(block_sums, schema)
