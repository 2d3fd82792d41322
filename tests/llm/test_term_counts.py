"""Term counts against brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.llm.term_counts import mark_terms, term_counts, term_tuples


class TestTermCounts:
    SCHEMA = "field string, term string, record string, row bigint, part string, n_rows string"

    def counts(self, spark, rows, partitions=4):
        df = spark.createDataFrame([(*r, "x", "y") for r in rows], self.SCHEMA)
        return {(r.field, r.term): (r.n_rows, r.n_records) for r in term_counts(df, partitions).collect()}

    @pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 4), (3, 13)])
    def test_against_brute_force(self, spark, seed, partitions):
        rng = random.Random(seed)
        rows = []
        for i in range(1500):
            term = "hot" if rng.random() < 0.4 else f"t{rng.randrange(60)}"
            row = ("f" if rng.random() < 0.8 else "g", term, f"r{rng.randrange(9)}", i)
            rows += [row] * rng.choice((1, 1, 1, 2))
        want: dict = {}
        for f, t, r, i in rows:
            a, b = want.setdefault((f, t), (set(), set()))
            a.add((r, i))
            b.add(r)
        assert self.counts(spark, rows, partitions) == {k: (len(a), len(b)) for k, (a, b) in want.items()}

    def test_nulls_and_empty(self, spark):
        assert self.counts(spark, []) == {}
        rows = [(None, None, None, None), ("", "", "", None), ("f", "x" * 100_000, "r", 1)]
        assert self.counts(spark, rows) == {("", ""): (1, 1), ("f", "x" * 100_000): (1, 1)}

    def test_marks(self, spark):
        counts = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("f", "c", 9, 21), ("f", "d", 9, 20)], "field string, term string, n_rows int, n_records int")
        totals = spark.createDataFrame([("f", 100)], "field string, all_records int")
        assert {r.term: r.mark for r in mark_terms(counts, totals).collect()} == {"a": "rare", "b": "", "c": "common", "d": ""}

    def test_repeated_deliveries_are_reduced_before_the_sort(self, spark):
        rows = [(1, "m", "k", "f")] * 50 + [(2, "m", "k", "f"), (2, "m", "k", "g"), (3, None, "k", None), (None, "m", None, "f"), (None, "m", None, "f")]
        table = spark.createDataFrame([(*r, 0) for r in rows], "id bigint, m string, k string, path string, row int")
        tuples = term_tuples(table, {"M": F.col("m"), "K": F.col("k")}, "path", "id")
        got = {(r.field, r.term): (r.n_rows, r.n_records) for r in term_counts(tuples, 3).collect()}
        assert got == {("M", "m"): (4, 2), ("M", ""): (1, 1), ("K", "k"): (4, 3), ("K", ""): (1, 1)}
        plan = tuples._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Aggregate")  # outermost first: copies go before rows are multiplied
