"""Comparisons of rasters against loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import components, experiments, near, resolve, splitting


def flips(rng, h, n):
    for bit in rng.sample(range(256), n):
        h ^= 1 << bit
    return h


def words(h):
    return [w - (w >> 63 << 64) for w in ((h >> 64 * k) & (2**64 - 1) for k in range(4))]


@pytest.mark.parametrize("distance", [0, 4, 12, 30, 100])
def test_hamming_by_bands_probes_and_blocks(spark, monkeypatch, distance):
    """Hashes at every distance around the limit, and copies, by each number of turned bits and by comparing all."""
    rng = random.Random(1)
    h = {k: rng.getrandbits(256) for k in range(20)}
    h |= {100 + k: flips(rng, h[k % 20], max(0, distance + k % 4 - 2)) for k in range(40)} | {200 + k: h[3] for k in range(5)}
    frame = spark.createDataFrame([(k, words(v)) for k, v in h.items()], "k long, h array<long>")
    want = {(a, b, n) for a in h for b in h if a < b and (n := (h[a] ^ h[b]).bit_count()) <= distance}
    for how in [None, *[(r, max(distance // (r + 1) + 1, 5)) for r in range(near.MOST_TURNED + 1) if distance < 100 and (r < 2 or distance > 20)]]:
        monkeypatch.setattr(near, "bands_for", lambda rows, distance, how=how: how)
        got = [tuple(r) for r in near.hamming_within(frame, "k", "h", distance).collect()]
        assert len(got) == len(want) and set(got) == want, how


def test_copies_are_one_until_they_are_written_out(spark):
    """50,000 equal rasters are one hash and give as many links less one; few of them give all their pairs."""
    rng = random.Random(5)
    base = [rng.randrange(256) for _ in range(64)]
    other = [min(255, v + 1) for v in base]
    many = spark.range(50_000).select(F.col("id").alias("k"), F.array(*[F.lit(v) for v in base]).alias("c"))
    one = spark.createDataFrame([(-1, other), (-2, [5] * 64), (-3, [5] * 64)], "k long, c array<int>")
    links = near.near_links(many.unionByName(one), "k", "c", 8, 12, 0.95)
    assert links.count() == 50_000 and links.where("a = -1").count() == 1 and links.where("a < -1 or b < -1").count() == 0
    few = near.near_pairs(many.where("k < 6").unionByName(one), "k", "c", 8, 12, 0.95).collect()
    assert {(r.a, r.b) for r in few} == {(a, b) for a in [-1, *range(6)] for b in range(6) if a < b} and len(few) == 21


def test_order_statistics_over_ties_and_keys(spark):
    rng = random.Random(3)
    rows = [(k % 3 if k % 7 else None, rng.choice([0.5, 0.5, 0.5, rng.random(), None])) for k in range(2000)]
    frame = spark.createDataFrame(rows, "g int, v double").repartition(7)
    shares = [0.0, 0.025, 0.5, 0.77, 1.0]
    got = {(r.g, r.share): r.value for r in experiments.order_statistics(frame, "v", shares, "g").collect()}
    for g in (None, 0, 1, 2):
        values = [v for k, v in rows if k == g and v is not None]
        assert all(abs(got.pop((g, q)) - np.quantile(values, q)) < 1e-12 for q in shares)
    assert not got
    assert experiments.order_statistics(frame.where("g = 9"), "v", shares, "g").count() == 0
    whole = experiments.order_statistics(frame, "v", [0.9]).first()
    assert abs(whole.value - np.quantile([v for _, v in rows if v is not None], 0.9)) < 1e-12


def test_bootstrap_of_several_groups(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(g, p, rng.random()) for g, n in (("a", 9), ("b", 4), (None, 6)) for p in range(n)]
    frame = spark.createDataFrame(rows, "g string, p int, d double").repartition(3)
    for most in (experiments.MOST_SENT_PATIENTS, 0):
        monkeypatch.setattr(experiments, "MOST_SENT_PATIENTS", most)
        for r in experiments.bootstrap_intervals(frame, "d", "p", "g", resamples=60).collect():
            d = [v for g, _, v in rows if g == r.g]
            draw = lambda i, j: int(hashlib.sha256(f"42|{i}|{j}".encode()).hexdigest()[:8], 16) % len(d)
            means = [sum(d[draw(i, j)] for j in range(1, len(d) + 1)) / len(d) for i in range(60)]
            assert r.n == len(d) and abs(r.mean - np.mean(d)) < 1e-12
            assert np.allclose((r.low, r.high), np.quantile(means, [0.025, 0.975]), atol=1e-12)
    assert experiments.bootstrap_intervals(frame.limit(0), "d", "p", "g").count() == 0


def test_many_groups_in_one_stratum(spark):
    """200,000 groups pass through one task in order; the result is that of a loop."""
    n = 200_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("group_id"), F.lit("all").alias("c"))
    got = {r.group_id: r.split for r in splitting.allocate_by_deficit(rows, ["c"], 42).collect()}
    sha = lambda *parts: hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()
    have = dict.fromkeys(("train", "val", "test"), 0)
    target = {s: r * n for s, r in zip(have, (0.70, 0.15, 0.15))}
    for g in sorted(map(str, range(n)), key=lambda g: (sha(42, "all", g), g)):
        short = {s: round((target[s] - have[s]) / target[s], 12) for s in have}
        best = [s for s in have if short[s] == max(short.values())]
        choice = best[0] if len(best) == 1 else min(best, key=lambda s: sha(42, g, s))
        have[choice] += 1
        assert got[g] == choice


def test_fingerprints_of_any_depth(spark, monkeypatch):
    monkeypatch.setattr(splitting, "LEAF", 2)
    for n in (0, 1, 2, 3, 40, 700):
        records = [f"{k % (n - n // 3 + 1)}|x" for k in range(n)]
        counts = Counter(hashlib.sha256((r + "\n").encode()).hexdigest() for r in records)
        depth = 0
        while 16**depth * 2 < len(counts):
            depth += 1

        def node(prefix):
            below = sorted(d for d in counts if d.startswith(prefix))
            if len(prefix) == depth:
                parts = [f"{d}:{counts[d]}" for d in below]
            else:
                parts = [node(p) for p in sorted({d[: len(prefix) + 1] for d in below})]
            return hashlib.sha256("\n".join(parts).encode()).hexdigest()

        frame = spark.createDataFrame([(r.split("|")[0], "x") for r in records], "a string, b string").repartition(5)
        got = splitting.fingerprint(frame, "a", "b").first()
        assert (got.rows, got.fingerprint) == (n, node("") if n else hashlib.sha256(b"").hexdigest())


def test_least_iou_is_over_all_members(spark):
    rng = random.Random(2)
    cells = lambda low, high: [1.0 if low <= k < high else -1.0 for k in range(100)]
    chain = {1: cells(0, 96), 2: cells(0, 100), 3: cells(4, 100)}  # edges 1-2 and 2-3 have 0.96, 1-3 has 0.92
    masks = chain | {k: [rng.choice([0.0, 1.0]) for _ in range(100)] for k in range(10, 60)}
    masks |= {70: cells(0, 9), 71: cells(0, 9), 80: cells(0, 9), 81: None, 90: cells(0, 9), 91: [1.0] * 9, 95: [0.0] * 100, 96: [0.0] * 100}
    of = lambda k: 1 if k < 10 else 10 if k < 60 else k // 10 * 10 + (5 if k >= 95 else 0)
    members = spark.createDataFrame([(k, of(k), 0) for k in [*masks, 82]], "id long, component long, label int")
    frame = spark.createDataFrame(list(masks.items()), "k long, c array<double>")
    least = resolve.least_member_iou(members, frame, "k", "c", block=7)
    got = {r.component: (r.min_iou, r.failed) for r in least.collect()}
    iou = lambda a, b: sum(x > 0 and y > 0 for x, y in zip(a, b)) / sum(x > 0 or y > 0 for x, y in zip(a, b))
    assert got[1] == (0.92, False) and got[70] == (1.0, False) and got[95] == (1.0, False)
    assert got[10] == (min(iou(masks[a], masks[b]) for a in range(10, 60) for b in range(a + 1, 60)), False)
    assert got[80][1] and got[90][1]
    reasons = {r.id: r.reason for r in resolve.resolve(members, "id", "label", [], least).collect()}
    assert {reasons[k] for k in (1, 2, 3)} == {"mask_conflict"} and reasons[80] == "mask_compare_error" and (reasons[70], reasons[71]) == (None, "duplicate_redundant")


def test_wide_rows_cross_to_python_in_small_batches(spark):
    """1,200 rasters of 16 KB came as one batch of 20 MB; a batch is bounded by its bytes, so workers don't grow with the table."""
    from pyspark.sql.functions import arrow_udf

    from quern.storage import BATCH_BYTES, checkpoint

    def weigh(cells: pa.Array) -> pa.Array:
        return pa.array([cells.nbytes] * len(cells), pa.int64())

    rows = checkpoint(spark.range(1200).coalesce(1)).select("id", F.array_repeat(F.col("id").cast("int"), 4096).alias("c"))
    assert rows.select(arrow_udf(weigh, "long")("c").alias("n")).agg(F.max("n")).first()[0] <= 1.1 * BATCH_BYTES


def test_components_find_their_edges_once(spark):
    """What makes the edges ran again for the loops at the end."""
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 7), (5, 4), (None, 6), (3, 2)], "a long, b long").mapInArrow(count, "a long, b long")
    found = components.connected_components(edges, "a", "b")
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7)]
    assert ran.value == 6


def test_masks_are_compared_as_bits(spark):
    """Sizes that fill no long, not-a-number (over any foreground), nulls and empty masks."""
    nan = float("nan")
    masks = {1: [1.0] * 65 + [nan] * 5, 2: [1.0] * 69 + [0.0], 10: [], 11: [], 20: [1.0, None], 21: [1.0, 0.0], 30: [1.0] * 64, 31: [1.0] * 64 + [0.0] * 6}
    members = spark.createDataFrame([(k, k // 10) for k in masks], "id long, component long")
    least = resolve.least_member_iou(members, spark.createDataFrame(list(masks.items()), "k long, c array<double>"), "k", "c")
    got = {r.component: (r.min_iou, r.failed) for r in least.collect()}
    assert got == {0: (69 / 70, False), 1: (1.0, False), 2: (1.0, True), 3: (1.0, True)}


def test_pairs_of_blocks_are_not_moved_again(spark):
    """Pairs within a wide distance grow with the square of the rows; they were joined with their hashes twice, by shuffle."""
    rng = random.Random(5)
    frame = spark.createDataFrame([(k, words(rng.getrandbits(256))) for k in range(60)] + [(100, None), (None, words(7))], "k long, h array<long>")
    pairs = near.hamming_within(frame, "k", "h", 120)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and pairs.count() > 20
