import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm.mixing import mix, permuted, quotas, shard_counts, share_report
from codequarry.llm.packing import LexicalIndex, fill, fill_report, pack
from codequarry.llm.tokens import VOCABULARY, encoding, ids, with_tokens

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
DOCS = "doc_id bigint, text string, source string, shard string, pieces string"


def corpus(spark, n=300, seed=1, extra=()):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.choice((3, 20, 60, 200)))), rng.choice(["a", "A ", "b", "b", "c", None]), "x", "y") for i in range(n)]
    return spark.createDataFrame([*rows, *extra], DOCS)


def test_tokens_round_trip(spark):
    text = "Grüße 🙂\n\tdef x, do: nil   end" * 3
    assert encoding().decode(ids(text).tolist()) == text
    assert len(ids("")) == len(ids(None)) == 0
    counted = with_tokens(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.n_tokens for r in counted] == [len(ids(text)), 0]


def test_bm25_against_brute_force():
    rng = np.random.default_rng(1)
    items = [rng.integers(0, 40, rng.integers(1, 30)) for _ in range(50)]
    index, n = LexicalIndex(items), len(items)
    mean = sum(map(len, items)) / n
    for q in (0, 7, 49):
        want = np.zeros(n)
        for t in set(items[q].tolist()):
            df = sum(t in x for x in items)
            idf = max(0.0, math.log((n - df + 0.5) / (df + 0.5)))
            for i, x in enumerate(items):
                tf = (x == t).sum()
                want[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
        assert np.allclose(index.scores(q), want, atol=1e-4)


def test_fill_puts_every_item_once_and_prefers_neighbours():
    items = [np.array([k] * 30 + list(range(100, 110))) for k in (1, 2, 3) for _ in range(2)]
    bins = fill(np.array([40] * 6), items, 80)
    assert sorted(i for b in bins for i in b) == list(range(6))
    assert {frozenset(b) for b in bins} == {frozenset((0, 1)), frozenset((2, 3)), frozenset((4, 5))}


def shard_sizes(rows, name, shard):
    return [r.n_tokens for r in rows if r.container == name and r.bin.split("-")[0] == shard]


def first_fit(sizes, capacity):
    rooms: list = []
    for n in sorted(sizes, reverse=True):
        for i, room in enumerate(rooms):
            if n <= room:
                rooms[i] -= n
                break
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_pack(spark):
    extra = [(900, " ".join(WORDS * 60), "a", "x", "y"), (901, None, None, None, None), (902, "", "a", "x", "y"), (None, "alpha", "a", "x", "y"), (5, "alpha beta", "a", "x", "y")]
    docs = corpus(spark, extra=extra)
    sizes: dict = {}
    for r in docs.where("doc_id IS NOT NULL").collect():
        sizes.setdefault(r.doc_id, []).append(len(ids(r.text)))
    packed = pack(spark, docs, [("s", 64), ("l", 512), ("bad", 0), (None, 5)], shard_tokens=8000)
    rows = packed.collect()
    assert {r.container for r in rows} == {"s", "l"}
    for name, capacity in (("s", 64), ("l", 512)):
        bins: dict = {}
        parts: dict = {}
        for r in rows:
            if r.container == name:
                bins[r.bin] = bins.get(r.bin, 0) + r.n_tokens
                parts.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        assert max(bins.values()) <= capacity
        assert set(parts) == set(sizes)
        for doc, found in parts.items():
            assert sum(n for _, n in found) == sum(sizes[doc])
            if len(sizes[doc]) == 1:  # whole, or cut into full containers and a rest
                assert len(found) == max(1, math.ceil(sizes[doc][0] / capacity))
                at = 0
                for start, n in sorted(found):
                    assert start == at and (n == capacity or at + n == sizes[doc][0])
                    at += n
            # No more containers than first-fit decreasing needs on the same shards.
            assert len(bins) <= sum(first_fit(shard_sizes(rows, name, k), capacity) for k in {b.split("-")[0] for b in bins})
    report = {r.container: r for r in fill_report(packed, spark.createDataFrame([("s", 64), ("l", 512)], "container string, capacity_tokens int")).collect()}
    for name, capacity in (("s", 64), ("l", 512)):
        of_it = [r for r in rows if r.container == name]
        n_bins = len({r.bin for r in of_it})
        assert report[name].n_bins == n_bins and abs(report[name].filled - sum(r.n_tokens for r in of_it) / n_bins / capacity) < 1e-9


def test_pack_nothing(spark):
    assert pack(spark, spark.createDataFrame([], DOCS), [("s", 64)]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations(n):
    a, b = permuted(np.arange(n), n, 12345), permuted(np.arange(n), n, 54321)
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 60 or (a != b).any()


def test_quotas_and_shards():
    shares, most = np.array([0.5, 0.3, 0.2]), np.array([1000, 300, 5000])
    totals = quotas(shares, most)
    assert totals.tolist() == [500, 300, 200]
    before = np.zeros(3, np.int64)
    spread = []
    for shard in range(-(-1000 // 64)):
        here, prefix = shard_counts(shard, totals, 64, 7)
        assert (prefix == before).all() and here.sum() == min(64, 1000 - shard * 64)
        before += here
        spread.append(here[0])
    assert (before == totals).all() and len(set(spread)) > 4
    huge = np.array([10**12, 3 * 10**12])
    assert shard_counts(0, huge, 10**6, 1)[0].sum() == 10**6


def test_mix(spark):
    docs = corpus(spark, 600, 2, [(900, None, "a", "x", "y"), (None, "alpha", "a", "x", "y")])
    targets = [("a", 0.3, 2), ("B", 0.4, 1), ("c", 0.2, 5), ("absent", 0.1, 3), (None, 0.1, 1), ("c", None, 1)]
    mixed = mix(spark, docs, targets, block_tokens=128, chunk_tokens=9000, shard_slots=32).persist()
    rows = mixed.collect()
    used = [(r.source, r.repeat, r["index"]) for r in rows]
    assert len(set(used)) == len(used) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert all(r.repeat < {"a": 2, "b": 1, "c": 5}[r.source] for r in rows)
    for r in rows:
        assert sum(p.n_tokens for p in r.pieces) == r.n_tokens <= 128
    share = {r.source: r for r in share_report(mixed, spark.createDataFrame(targets[:4], "source string, target_share double, max_repeats int")).collect()}
    for s, want in (("a", 0.3 / 0.9), ("b", 0.4 / 0.9), ("c", 0.2 / 0.9)):
        assert abs(share[s].actual_share - want) < 0.03
    assert share["absent"].n_tokens == 0
    # One source is used up: its repeats allow no longer mixture.
    n_blocks = {}
    for r in rows:
        n_blocks[r.source] = n_blocks.get(r.source, 0) + 1
    # Every document's tokens are used alike within one repetition.
    covered = mixed.where("repeat = 0 AND source = 'b'").select(F.explode("pieces").alias("p")).select("p.*").groupBy("doc_id", "token_start").count()
    assert covered.where("count > 1").isEmpty()
    assert [tuple(r) for r in mix(spark, docs, targets, 128, 9000, 32).select("shard", "slot", "source", "index").orderBy("shard", "slot").collect()] == [
        (r.shard, r.slot, r.source, r["index"]) for r in sorted(rows, key=lambda r: (r.shard, r.slot))
    ]


def test_mix_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mix(spark, empty, [("a", 1.0, 1)]).count() == 0
    assert mix(spark, corpus(spark, 5), []).count() == 0
