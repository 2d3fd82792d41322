"""The data operators against brute force, and their edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codequarry import storage
from codequarry.operators.dense_counts import dense_counts
from codequarry.operators.incremental import IncrementalBatches
from codequarry.operators.orphans import orphans

LISTING = "path string, observed_at timestamp, present boolean, size bigint, checksum string, changed string, s int"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def listing(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], LISTING)


def paths(df):
    return sorted(r.path for r in df.collect())


class TestIncremental:
    @pytest.fixture
    def batches(self, spark, tmp_path):
        return IncrementalBatches(spark, f"file://{tmp_path}", compact_every=2)

    def test_new_changed_unchanged_and_removed(self, spark, batches):
        assert paths(batches.run("1", listing(spark, [("a", day(0), True, 1, "x"), ("b", day(0), True, 1, "x")]))) == ["a", "b"]
        second = [("a", day(1), True, 1, "x"), ("b", day(1), True, 1, "y"), ("c", day(1), True, None, None)]
        assert paths(batches.run("2", listing(spark, second))) == ["b", "c"]
        assert paths(batches.run("3", listing(spark, [("b", day(2), False, None, None)]))) == []
        assert paths(batches.run("4", listing(spark, [("b", day(3), True, 1, "y"), ("c", day(3), True, None, None)]))) == ["b"]
        assert batches.committed() == ["1", "2", "3", "4"]
        assert sorted((r.batch, r.path) for r in batches.outputs().collect()) == [("1", "a"), ("1", "b"), ("2", "b"), ("2", "c"), ("4", "b")]

    def test_late_reports_change_nothing(self, spark, batches):
        batches.run("1", listing(spark, [("a", day(5), True, 1, "x")]))
        assert paths(batches.run("2", listing(spark, [("a", day(1), True, 1, "old"), ("a", None, True, 1, "older")]))) == []
        assert [(r.checksum, r.present) for r in batches.manifest().collect()] == [("x", True)]

    def test_ties_repeats_and_nulls(self, spark, batches):
        rows = [("a", day(0), False, 1, "x"), ("a", day(0), True, 1, "x"), ("a", day(0), True, 1, "x"), (None, day(0), True, 1, "x"), ("n", None, None, None, None)]
        assert paths(batches.run("1", listing(spark, rows))) == ["a"]

    def test_empty(self, spark, batches):
        assert paths(batches.run("1", listing(spark, []))) == []
        assert batches.committed() == ["1"] and batches.outputs().count() == 0

    def test_a_failed_batch_is_repeated_and_a_committed_one_is_not(self, spark, batches):
        rows = listing(spark, [("a", day(0), True, 1, "x")])

        def broken(changed):
            raise RuntimeError("lost")

        with pytest.raises(RuntimeError):
            batches.run("1", rows, broken)
        assert batches.committed() == []
        done = []

        def process(changed):
            done.append(1)
            return changed.select("path")

        assert paths(batches.run("1", rows, process)) == ["a"]
        assert paths(batches.run("1", rows, process)) == ["a"]
        assert len(done) == 1

    @pytest.mark.parametrize("step", ["segment", "output", "fold", "history", "commit"])
    def test_a_loss_at_any_step_neither_skips_nor_repeats(self, spark, tmp_path, monkeypatch, step):
        """The run dies right after the step named; the next attempt gives what an undisturbed run gives."""
        batches = IncrementalBatches(spark, f"file://{tmp_path}", compact_every=1)
        batches.run("1", listing(spark, [("a", day(0), True, 1, "x"), ("b", day(0), True, 1, "x")]))
        second = listing(spark, [("a", day(1), True, 1, "y"), ("c", day(1), True, 1, "x")])

        def die(*_, **__):
            raise OSError("executor lost")

        writes, write_text = [], storage.write_text

        def failing_text(spark, path, text):
            if step in path or (step == "commit" and "/commits/" in path):
                die()
            return write_text(spark, path, text)

        with monkeypatch.context() as m:
            m.setattr(storage, "write_text", failing_text)
            if step == "segment":
                m.setattr(storage, "exists", die)  # asked right after the segment is written
            if step == "fold":
                m.setattr(IncrementalBatches, "_latest", lambda self, rows, f=IncrementalBatches._latest: die() if writes else f(self, rows))
            process = lambda changed: (writes.append(1), changed)[1] if step != "output" else die()
            with pytest.raises(OSError):
                batches.run("2", second, process)
        assert batches.committed() == ["1"]
        assert paths(batches.run("2", second)) == ["a", "c"]
        assert paths(batches.run("3", second)) == [] and batches.committed() == ["1", "2", "3"]
        assert {r.path: r.checksum for r in batches.manifest().collect()} == {"a": "y", "b": "x", "c": "x"}

    def test_of_two_writers_the_second_is_turned_away(self, spark, tmp_path):
        one, two = (IncrementalBatches(spark, f"file://{tmp_path}") for _ in range(2))
        rows = listing(spark, [("a", day(0), True, 1, "x")])

        def interrupted(changed):
            two.run("2", rows)  # commits in between
            return changed

        with pytest.raises(RuntimeError, match="another writer"):
            one.run("1", rows, interrupted)
        assert one.committed() == ["2"]
        assert paths(one.run("1", rows)) == []

    def test_catching_up_is_running_one_by_one(self, spark, tmp_path):
        rng = random.Random(5)
        rows = [
            (rng.choice("abcdefghijkl"), day(rng.randrange(20)) if rng.random() < 0.95 else None, rng.random() < 0.8, rng.choice([1, 2, None]),
             rng.choice(["x", "y"]), day(rng.randrange(22)) if rng.random() < 0.95 else None)
            for _ in range(150)
        ]
        table = spark.createDataFrame(rows, "path string, observed_at timestamp, present boolean, size bigint, checksum string, arrived_at timestamp")
        due = [(str(n), day(n)) for n in (3, 4, 9, 15, 18)]
        one = IncrementalBatches(spark, f"file://{tmp_path}/one", compact_every=2)
        before = None
        for name, until in due:
            here = table.where("arrived_at IS NULL") if before is None else table.limit(0)
            later = table.where(F.col("arrived_at") <= F.lit(until))
            one.run(name, here.union(later if before is None else later.where(F.col("arrived_at") > F.lit(before))))
            before = until
        many = IncrementalBatches(spark, f"file://{tmp_path}/many", compact_every=2)
        many.catch_up(due[:2], table)
        many.catch_up(due, table)
        many.catch_up(due, table)
        key = lambda b: sorted(tuple(map(str, r)) for r in b.outputs().collect())
        assert key(many) == key(one) and len(key(one)) > 10
        assert many.committed() == one.committed()
        assert sorted(map(str, many.manifest().collect())) == sorted(map(str, one.manifest().collect()))

    def test_identifiers_name_folders(self, batches, spark):
        with pytest.raises(ValueError):
            batches.run("../up", listing(spark, []))

    def test_full_listings_notice_what_is_gone(self, spark, batches):
        batches.run("1", listing(spark, [("a", day(0), True, 1, "x"), ("b", day(0), True, 1, "x")]), full=True)
        batches.run("2", listing(spark, [("a", day(1), True, 1, "x")]), full=True)
        assert {r.path: r.present for r in batches.manifest().collect()} == {"a": True, "b": False}

    def test_compaction_keeps_the_manifest(self, spark, batches):
        for n in range(6):
            batches.run(str(n), listing(spark, [(f"p{n}", day(n), True, n, "x"), ("p", day(n), True, n // 2, "x")]))
        assert batches.manifest().count() == 7
        last = storage.names(spark, f"{batches.root}/commits")[-1]
        assert len(batches._last()["segments"]) <= 2 and last.startswith("00000006")


class TestOrphans:
    REFS = "id int, key string, period int, status string, valid_from int"

    def run(self, spark, refs, parents):
        r = spark.createDataFrame([(i, k, p, "own", 0) for i, k, p in refs], self.REFS)
        p = spark.createDataFrame(parents, "key string, valid_from int, valid_to int")
        return sorted((x.id, x.status) for x in orphans(r, p, ["key"]).collect())

    def test_missing_deleted_late(self, spark):
        parents = [("a", 1, 3), ("a", 5, 9), ("b", 4, 9), ("c", 2, 2)]
        refs = [(1, "a", 0), (2, "a", 1), (3, "a", 3), (4, "a", 5), (5, "b", 3), (6, "b", 4), (7, "z", 4), (8, "c", 2), (9, None, 2), (10, "a", None)]
        assert self.run(spark, refs, parents) == [(1, "late"), (3, "deleted"), (5, "late"), (7, "missing"), (8, "missing"), (9, "missing")]

    def test_empty_sides_and_repeats(self, spark):
        assert self.run(spark, [], [("a", 1, 2)]) == []
        assert self.run(spark, [(1, "a", 1), (1, "a", 1)], []) == [(1, "missing"), (1, "missing")]

    def test_null_bounds_are_ignored(self, spark):
        assert self.run(spark, [(1, "a", 1)], [("a", None, 5), ("a", 0, None)]) == [(1, "missing")]

    def test_against_brute_force_with_a_hot_key(self, spark):
        rng = random.Random(3)
        refs = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(12)) for i in range(800)]
        parents = [(rng.choice(["hot", f"k{rng.randrange(25)}"]), a := rng.randrange(12), a + rng.randrange(4)) for _ in range(60)]
        valid = {(k, p) for k, a, b in parents for p in range(a, b)}
        assert [i for i, _ in self.run(spark, refs, parents)] == sorted(i for i, k, p in refs if (k, p) not in valid)


class TestHotKeys:
    def test_a_hot_reference_key_is_split(self, spark):
        """With thresholds below the test's size, adaptive execution splits the partition of the key that holds most references."""
        conf = {
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        }
        old = {k: spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            spark.conf.set(k, v)
        try:
            refs = spark.range(0, 60_000, 1, 6).select(
                F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"),
                (F.col("id") % 7).cast("int").alias("period"),
                F.col("id"),
            )
            parents = spark.createDataFrame([("k1", 0, 5), ("k2", 3, 9)], "k string, valid_from int, valid_to int")
            found = orphans(refs, parents, ["k"])
            rows = found.collect()
            assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
            assert sum(r.k == "hot" for r in rows) == 20_000 and len({r.id for r in rows}) == len(rows)
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class TestDenseCounts:
    SCHEMA = "t string, k string, id bigint, v int, n_rows int"

    def sums(self, spark, rows, splits=4, **more):
        df = spark.createDataFrame([(*r, 0) for r in rows], self.SCHEMA)
        found = dense_counts(df, ["t", "k"], "id", ["v"], splits, **more).collect()
        assert len(found) == len({(r.t, r.k) for r in found})
        return {(r.t, r.k): (r.n_rows, r.sum_v) for r in found}

    @pytest.mark.parametrize("splits", [1, 3, 8])
    def test_against_brute_force(self, spark, splits):
        rng = random.Random(splits)
        rows = [("ab"[i % 2], "hot" if rng.random() < 0.5 else f"k{rng.randrange(3000)}", i, rng.randrange(-5, 100)) for i in range(6000)]
        want: dict = {}
        for t, k, _, v in rows:
            n, s = want.get((t, k), (0, 0))
            want[t, k] = (n + 1, s + v)
        assert self.sums(spark, rows + rows[::7], splits) == want
        assert self.sums(spark, rows + rows[::7], splits, max_keys=50) == want

    def test_without_sums_and_with_a_hot_row(self, spark):
        df = spark.createDataFrame([("a", "b", 1, 5, 0)] * 500 + [("a", "b", 2, 7, 0)], self.SCHEMA)
        assert [tuple(r) for r in dense_counts(df, ["t", "k"], "id", [], 3).collect()] == [("a", "b", 2)]

    def test_rows_delivered_twice_with_other_values_count_with_the_least(self, spark):
        assert self.sums(spark, [("a", "b", 1, 5), ("a", "b", 1, 3), ("a", "b", None, 9), ("a", "b", None, 8)]) == {("a", "b"): (2, 11)}

    def test_nulls_and_empty(self, spark):
        assert self.sums(spark, []) == {}
        assert self.sums(spark, [(None, None, 1, None), ("", "", 2, 5), ("a", "b", None, 1), ("a", "b", None, 1)]) == {("", ""): (2, 5), ("a", "b"): (1, 1)}
