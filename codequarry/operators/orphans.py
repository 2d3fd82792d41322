"""References to records that do not exist.

References and parent keys are co-partitioned and sorted on the key and merged linearly (Spark's sort-merge join);
the parents of a key come as their validity intervals, in periods, so each reference meets one row. A reference is
an orphan if no parent was valid at the end of its period: `deleted` if one was valid before, else `late` if one
becomes valid afterwards, else `missing`.

Skew: intervals are collapsed before the shuffle (a set of period pairs for each key, whatever the number of its
rows), and a key with a large share of the references is split by adaptive skew handling on the reference side. That
takes effect only if both sides of the join are sorted right after their shuffles: the intervals are therefore collapsed
under a finer key than the join's, so that the join shuffles them (one row a key) once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALWAYS_FROM, NEVER_ENDS = -(2**31), 2**31 - 1


def month_index(at: Column) -> Column:
    """Months since year 0."""
    return F.year(at) * 12 + F.month(at) - 1


def month_label(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def validity(parents: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, each with the set of its [valid_from, valid_to) pairs (at most one pair for any two periods)."""
    finer = F.xxhash64(*keys).alias("_finer")
    return parents.groupBy(*keys, finer).agg(F.collect_set(F.struct("valid_from", "valid_to")).alias("valid")).drop("_finer")


def orphans(references: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """The references with no valid parent, with a column `status`.

    `references`: the keys, `period` (int) and any other columns; `parents`: the keys, `valid_from`, `valid_to`
    (periods, the end excluded). Rows come out as often as they went in. Nulls: a NULL key matches nothing, so it
    is `missing`; references without a period have no result; parents with a NULL bound are ignored. Extra columns
    of `references` named like those of `parents` do no harm; one named `status`, `_valid` or `_parent_...` is replaced. Empty parents make everything missing.
    """
    own = [c for c in references.columns if c not in keys and c not in ("status", "_valid") and not c.startswith("_parent_")]
    bounded = parents.where("valid_from IS NOT NULL AND valid_to IS NOT NULL")
    merged = validity(bounded, keys).select(*[F.col(k).alias(f"_parent_{k}") for k in keys], F.col("valid").alias("_valid"))
    on = [references[k] == merged[f"_parent_{k}"] for k in keys]
    p = F.col("period")
    some = lambda test: F.coalesce(F.exists("_valid", test), F.lit(False))
    return (
        references.where("period IS NOT NULL")
        .join(merged.hint("merge"), on, "left_outer")
        .where(~some(lambda v: (v["valid_from"] <= p) & (v["valid_to"] > p)))
        .withColumn(
            "status",
            F.when(some(lambda v: (v["valid_to"] <= p) & (v["valid_to"] > v["valid_from"])), "deleted")
            .when(some(lambda v: (v["valid_from"] > p) & (v["valid_to"] > v["valid_from"])), "late")
            .otherwise("missing"),
        )
        .select(*[references[k] for k in keys], *own, "status")
    )
