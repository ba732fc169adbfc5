"""Confusion metrics, losses and selection on the literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import confusion, selection

CELLS = "sample int, score double, target boolean"


def frame(spark, samples):
    rows = [(s, 0.9 if p else 0.1, bool(t)) for s, (pred, target) in enumerate(samples) for p, t in zip(pred, target)]
    return confusion.sample_ratios(confusion.confusion_counts(spark.createDataFrame(rows, CELLS), ["sample"], F.col("score"), F.col("target")))


def test_counts_and_both_means(spark):
    samples = frame(spark, [((1, 0, 0, 0), (1, 0, 0, 0)), ((1, 1, 0, 0), (1, 0, 1, 0))])
    assert [(r.tp, r.fp, r.fn, r.tn) for r in samples.orderBy("sample").collect()] == [(1, 0, 0, 3), (1, 1, 1, 1)]
    m = confusion.metrics(samples).first()
    near = pytest.approx
    assert m.macro_iou == near(2 / 3) and m.micro_iou == near(0.5) and m.macro_dice == near(0.75) and m.micro_dice == near(2 / 3)
    assert m.macro_precision == near(0.75) and m.micro_precision == near(2 / 3) and m.macro_specificity == near(0.75) and m.micro_specificity == near(0.8)
    assert m.macro_accuracy == near(0.75) and m.micro_accuracy == near(0.75)


def test_empty_targets_and_empty_tables(spark):
    m = confusion.metrics(frame(spark, [((1, 0, 0, 0), (1, 0, 0, 0)), ((1, 0, 0, 0), (0, 0, 0, 0))])).first()
    assert (m.positive_macro_iou, m.positive_macro_dice, m.empty_false_positive_rate, m.empty_predicted_fraction, m.positive_samples, m.empty_samples) == (1, 1, 1, 0.25, 1, 1)
    both = frame(spark, [((0, 0), (0, 0))]).first()
    assert (both.iou, both.dice, both.precision, both.recall, both.specificity, both.accuracy) == (1, 1, 1, 1, 1, 1)
    none = confusion.metrics(frame(spark, [((0, 0), (0, 0))])).first()
    assert none.positive_macro_iou == 0.0


def test_threshold_choice_and_search(spark):
    table = spark.createDataFrame([(0.35, 0.72), (0.45, 0.75), (0.55, 0.75)], "threshold double, m double")
    assert selection.best_threshold(table, "m").first().threshold == 0.45
    rng = random.Random(0)
    cells = spark.createDataFrame([(k % 7, rng.choice([0.0, 0.2, 0.3, 0.5, 0.7, 1.0]), rng.random() < 0.4) for k in range(500)], CELLS)
    found = {(r["sample"], r.threshold): (r.tp, r.fp, r.fn, r.tn) for r in selection.threshold_search(cells, ["sample"], F.col("score"), F.col("target"), [0.2, 0.5, 0.9]).collect()}
    for t in (0.2, 0.5, 0.9):
        for r in confusion.confusion_counts(cells, ["sample"], F.col("score"), F.col("target"), t).collect():
            assert found[(r["sample"], t)] == (r.tp, r.fp, r.fn, r.tn)


def test_weights_draws_histogram_and_buckets(spark):
    rows = spark.createDataFrame([(k, k % 3 == 0, k / 29.0) for k in range(30)], "id int, pos boolean, v double")
    weighed = confusion.balanced_weights(rows, F.col("pos"))
    sums = {r.pos: r.w for r in weighed.groupBy("pos").agg(F.sum("weight").alias("w")).collect()}
    assert sums[True] == pytest.approx(0.5) and sums[False] == pytest.approx(0.5)
    drawn = confusion.systematic_draw(weighed, "weight", 1000, "42", "id").collect()
    assert sum(r.draws for r in drawn) in (999, 1000, 1001) and all(abs(r.draws - 1000 * r.weight) < 1.001 for r in drawn)
    assert {r.bin: r.n for r in confusion.histogram(rows, "v").collect()}[19] == 2
    sized = confusion.size_buckets(rows, F.col("id") * 200, "v").orderBy("bucket_order").collect()
    assert [r.num_samples for r in sized] == [1, 4, 15, 9]


def test_losses_of_a_perfect_and_an_inverted_map(spark):
    good = confusion.losses(spark.createDataFrame([(0, 1.0, 1), (0, 0.0, 0)], "s int, p double, t int"), "s", F.col("p"), F.col("t")).first()
    bad = confusion.losses(spark.createDataFrame([(0, 0.0, 1), (0, 1.0, 0)], "s int, p double, t int"), "s", F.col("p"), F.col("t")).first()
    assert good.dice_loss == pytest.approx(0) and good.bce_loss < 1e-5 and good.focal_loss < 1e-9
    assert bad.dice_loss == pytest.approx(2 / 3) and bad.bce_loss > 10 and bad.bce_dice_loss == pytest.approx((bad.bce_loss + bad.dice_loss) / 2)
    with pytest.raises(ValueError):
        confusion.build_loss("other")


def test_running_best_stop_and_plateau(spark):
    values = [0.1, 0.3, 0.3, 0.2, 0.4, 0.1, 0.2, 0.3, 0.4, 0.1, 0.9]
    epochs = spark.createDataFrame([(1, k + 1, v, k / 10) for k, v in enumerate(values)], "run int, epoch int, m double, threshold double")
    best, bad, at, want = float("-inf"), 0, None, []
    for k, v in enumerate(values):
        if v > best:
            best, bad, at = v, 0, k + 1
        else:
            bad += 1
        want.append((v > (max(values[:k]) if k else float("-inf")), best, bad, at, (at - 1) / 10))
    got = selection.running_best(epochs, "m", "run", extra="threshold").orderBy("epoch").collect()
    assert [(r.improved, r.best, r.bad_epochs, r.best_epoch, r.best_threshold) for r in got] == want
    assert selection.early_stop(epochs, "m", 3, "run").agg(F.max("epoch")).first()[0] == 8
    ends = selection.best_and_last(epochs, "m", "run").first()
    assert (ends.best_epoch, ends.best_metric, ends.last_epoch, ends.last_metric) == (11, 0.9, 11, 0.9)
    rate, best, bad, rates = 0.1, float("-inf"), 0, []
    for v in values:
        if v > (best if best == float("-inf") else best * (1 + 1e-4)):
            best, bad = v, 0
        else:
            bad += 1
        if bad > 1:
            rate, bad = max(rate * 0.5, 0.01), 0
        rates.append(rate)
    got = selection.reduce_on_plateau(epochs, "m", 0.1, 0.5, 1, 0.01, "run").orderBy("epoch").collect()
    assert [r.rate for r in got] == pytest.approx(rates)
