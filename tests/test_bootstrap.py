"""The bootstrap with all its resamples against a loop."""

import hashlib

import numpy as np
import pytest

from quern.operators import experiments
from quern.plans import experiments as plans

FOLDER = "/root/testdata/sf0.001"


def test_bootstrap_with_all_resamples(spark):
    d = [r.difference for r in plans.patient_differences(spark, FOLDER).orderBy("patient").collect()]
    draw = lambda i, j: int(hashlib.sha256(f"42|{i}|{j}".encode()).hexdigest()[:8], 16) % len(d)
    means = [sum(d[draw(i, j)] for j in range(1, len(d) + 1)) / len(d) for i in range(10_000)]
    (r,) = plans.bootstrap_ci(spark, FOLDER).collect()
    assert r.n == len(d) and r.mean == pytest.approx(np.mean(d), abs=2e-6)
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=2e-6)


def test_one_group_makes_no_row_for_each_draw(spark, monkeypatch):
    """The draws of a single group carry it as a literal and meet patients by their number alone."""
    plain, seen = experiments.order_statistics, []

    def order_statistics(means, *rest):
        seen.append(means._jdf.queryExecution().optimizedPlan().toString())
        return plain(means, *rest)

    monkeypatch.setattr(experiments, "order_statistics", order_statistics)
    rows = spark.createDataFrame([(k, k / 7) for k in range(9)], "patient int, difference double")
    (one,) = experiments.bootstrap_interval(rows, "difference", "patient", resamples=50).collect()
    null = experiments.bootstrap_intervals(rows.selectExpr("*", "cast(null as string) g"), "difference", "patient", "g", resamples=50).collect()
    both = experiments.bootstrap_intervals(rows.selectExpr("*", "explode(array(1, 2)) g"), "difference", "patient", "g", resamples=50).collect()
    assert [r.g for r in null] == [None] and {tuple(r)[1:] for r in [*null, *both]} == {tuple(one)}
    assert ["Generate" in plan for plan in seen] == [False, False, True]
