"""Frequency of every distinct value or term.

Rows are freed of repeated deliveries first, by hash aggregation, so that copies are reduced before they travel. Then
(field, term, record, row) tuples are range-partitioned and sorted, so that a frequent term spreads over as many
partitions as it needs (ranges are sampled from what the first step wrote); each partition is scanned once for runs. A
run gives the number of its rows and of its records; the runs of a term that ends in one partition and goes on in the
next are put together afterwards, with one less record where both sides of the boundary belong to the same record.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RUN = "part int, field string, term string, n_rows bigint, n_records bigint, first_record string, last_record string"
_NAMES = [c.split()[0] for c in _RUN.split(", ")]


def term_tuples(rows: DataFrame, fields: dict[str, Column], record: str, row: str) -> DataFrame:
    """field, term, record, row of every term of `rows`, each delivered row once.

    `fields` names the fields with the columns that hold their terms; `record` and `row` name the columns of the record and
    of the row's identifier. Rows are equal if identifier, record and terms are. Nulls are read as in `term_counts`.
    """
    names = [f"_t{i}" for i in range(len(fields))]
    own = rows.select(
        F.col(row).cast("bigint").alias("row"),
        F.coalesce(F.col(record), F.lit("")).alias("record"),
        *[F.coalesce(c, F.lit("")).alias(n) for n, c in zip(names, fields.values(), strict=True)],
    ).distinct()
    tuples = F.array(*[F.struct(F.lit(f).alias("field"), F.col(n).alias("term")) for f, n in zip(fields, names, strict=True)])
    return own.select(F.explode(tuples).alias("x"), "record", "row").select("x.field", "x.term", "record", "row")


def _differs(column: pa.Array) -> np.ndarray:
    """For each element but the first, whether it differs from the one before."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted tuples. All runs of a batch leave it as columns; only the last stays open, as one value
    of each, and is joined with the first of the next batch where that goes on."""
    open_run: list | None = None  # part, field, term, rows, records, first record, last record
    last_row = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, field, term, record, row = (batch.column(i) for i in range(5))
        n = batch.num_rows
        new_term, new_record, new_row = np.ones(n, bool), np.ones(n, bool), np.ones(n, bool)
        if open_run is not None:
            new_term[0] = (field[0].as_py(), term[0].as_py()) != (open_run[1], open_run[2])
            new_record[0] = new_term[0] or record[0].as_py() != open_run[6]
            new_row[0] = new_record[0] or row[0].as_py() != last_row
        if n > 1:
            new_term[1:] = _differs(field) | _differs(term)
            new_record[1:] = new_term[1:] | _differs(record)
            new_row[1:] = new_record[1:] | _differs(row)
        goes_on = open_run is not None and not new_term[0]
        starts = np.flatnonzero(new_term)
        starts = np.r_[0, starts] if goes_on else starts
        ends = np.r_[starts[1:], n] - 1
        n_rows, n_records = (np.add.reduceat(x.astype(np.int64), starts) for x in (new_row, new_record))
        firsts, lasts = record.take(pa.array(starts)), record.take(pa.array(ends))
        fields, terms = field.take(pa.array(starts)), term.take(pa.array(starts))
        if goes_on:
            n_rows[0] += open_run[3]
            n_records[0] += open_run[4]
            firsts = pa.concat_arrays([pa.array([open_run[5]], firsts.type), firsts.slice(1)])
        elif open_run is not None:
            yield _batch([[x] for x in open_run])
        k, at = len(starts) - 1, part[0].as_py()
        if k:
            yield _batch([np.full(k, at), fields.slice(0, k), terms.slice(0, k), n_rows[:k], n_records[:k], firsts.slice(0, k), lasts.slice(0, k)])
        open_run = [at, fields[k].as_py(), terms[k].as_py(), int(n_rows[k]), int(n_records[k]), firsts[k].as_py(), lasts[k].as_py()]
        last_row = row[n - 1].as_py()
    if open_run is not None:
        yield _batch([[x] for x in open_run])


def _batch(columns: list) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def term_counts(pairs: DataFrame, partitions: int) -> DataFrame:
    """field, term, n_rows, n_records of every distinct (field, term).

    `pairs`: field, term, record (strings) and row (bigint); equal rows of a term and record count once, so rows
    delivered twice count once. Nulls: a NULL field, term or record is read as ''; rows with a NULL row count
    together once for each term and record. Extra columns are ignored; an empty input gives an empty result.
    """
    keys = ["field", "term", "record", "row"]
    text = [F.coalesce(c, F.lit("")).alias(c) for c in keys[:3]]
    sorted_pairs = (
        pairs.select(*text, F.coalesce(F.col("row").cast("bigint"), F.lit(-(2**63))).alias("row"))
        .repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .select(F.spark_partition_id().alias("part"), *keys)
    )
    runs = sorted_pairs.mapInArrow(_runs, _RUN)
    w = Window.partitionBy("field", "term").orderBy("part")
    shared = (F.lag("last_record").over(w) == F.col("first_record")).cast("int")
    return (
        runs.withColumn("shared", F.coalesce(shared, F.lit(0)))
        .groupBy("field", "term")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum(F.col("n_records") - F.col("shared")).alias("n_records"))
    )


def mark_terms(counts: DataFrame, totals: DataFrame, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """`counts` with `mark`: `rare` in fewer than `rare_below` records, `common` in more than the share
    `common_above` of the field's records (`totals`: field, all_records; one row for each field), else ''."""
    share = Fraction(common_above).limit_denominator(1_000_000)  # compared in whole numbers, so that ties are exact
    return counts.join(F.broadcast(totals), "field").withColumn(
        "mark",
        F.when(F.col("n_records") < rare_below, "rare")
        .when(F.col("n_records") * share.denominator > F.col("all_records") * share.numerator, "common")
        .otherwise(""),
    )
