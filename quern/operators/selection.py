"""Choice of thresholds and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.folds import Step, in_order


def threshold_search(cells: DataFrame, keys: list[str], score: Column, target: Column, thresholds: list[float], among: DataFrame | None = None) -> DataFrame:
    """Confusion counts for each key and threshold in one scan: each cell is counted in the first threshold interval above
    its score, and running sums over the few thresholds give the counts.  ``among`` has the keys that count, all if None."""
    marks = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    level = F.size(F.filter(marks, lambda t: t <= score))
    cells = cells.groupBy(*keys, level.alias("level")).agg(F.count_if(target).alias("pos"), F.count_if(~target).alias("neg"))
    grouped = cells.groupBy(*keys).agg(F.collect_list(F.struct("level", "pos", "neg")).alias("levels"))
    grouped = grouped if among is None else grouped.join(among, keys, "left_semi")
    out = grouped.select(*keys, "levels", F.posexplode(marks).alias("k", "threshold"))
    total = lambda field, keep: F.aggregate(F.filter("levels", keep), F.lit(0).cast("long"), lambda a, x: a + x[field])
    above, below = (lambda x: x["level"] > F.col("k")), (lambda x: x["level"] <= F.col("k"))
    return out.select(*keys, "threshold", total("pos", above).alias("tp"), total("neg", above).alias("fp"), total("pos", below).alias("fn"), total("neg", below).alias("tn"))


def best_threshold(candidates: DataFrame, metric: str, reference: float = 0.5, *keys: str) -> DataFrame:
    """The threshold with the highest metric; of equals the nearest to ``reference``, then the lower."""
    order = F.struct(F.col(metric), -F.abs(F.col("threshold") - reference), -F.col("threshold"))
    return candidates.groupBy(*keys).agg(F.max_by("threshold", order).alias("threshold"), F.max(metric).alias(metric))


def running_best(epochs: DataFrame, metric: str, *runs: str, extra: str | None = None) -> DataFrame:
    """``best`` so far, ``improved`` (strictly over all earlier), ``bad_epochs`` since then, and ``extra`` as of then."""
    run = W.partitionBy(*runs).orderBy("epoch")
    earlier, so_far = run.rowsBetween(W.unboundedPreceding, -1), run.rowsBetween(W.unboundedPreceding, 0)
    before = F.coalesce(F.max(metric).over(earlier), F.lit(float("-inf")))
    out = epochs.withColumn("improved", F.coalesce(F.col(metric) > before, F.lit(False)))
    out = out.withColumns({"best": F.max(metric).over(so_far), "at": F.max(F.when(F.col("improved"), F.col("epoch"))).over(so_far), "place": F.row_number().over(run)})
    since = F.max(F.when(F.col("improved"), F.col("place"))).over(so_far)
    out = out.withColumn("bad_epochs", (F.col("place") - F.coalesce(since, F.lit(0))).cast("int"))
    if extra:
        out = out.withColumn(f"best_{extra}", F.last(F.when(F.col("improved"), F.col(extra)), ignorenulls=True).over(so_far))
    return out.drop("place").withColumnRenamed("at", "best_epoch")


def early_stop(epochs: DataFrame, metric: str, patience: int, *runs: str) -> DataFrame:
    """The epochs that are run: up to the first with ``patience`` epochs without improvement."""
    tracked = running_best(epochs, metric, *runs)
    stop = F.min(F.when(F.col("bad_epochs") >= patience, F.col("epoch"))).over(W.partitionBy(*runs))
    return tracked.withColumn("stop_epoch", stop).where("stop_epoch is null or epoch <= stop_epoch")


def best_and_last(epochs: DataFrame, metric: str, *runs: str) -> DataFrame:
    """Epoch and metric of the first maximum and of the last record."""
    first_best = F.struct(F.col(metric), -F.col("epoch"))
    return epochs.groupBy(*runs).agg(
        F.max_by("epoch", first_best).alias("best_epoch"), F.max(metric).alias("best_metric"), F.max("epoch").alias("last_epoch"), F.max_by(metric, "epoch").alias("last_metric")
    )


def reduce_on_plateau(epochs: DataFrame, metric: str, start: float, factor: float, patience: int, floor: float, *runs: str, threshold: float = 1e-4) -> DataFrame:
    """Learning rate after each epoch when it shrinks after more than ``patience`` epochs without relative improvement.

    Epochs pass one after the other with best, bad epochs and rate for a state.
    """

    def begin() -> Step:
        best, bad, rate = float("-inf"), 0, float(start)

        def step(row: tuple) -> tuple:
            nonlocal best, bad, rate
            epoch, value = row
            better = value is not None and value > (best if best == float("-inf") else best * (1 + threshold))
            best, bad = (value, 0) if better else (best, bad + 1)
            if bad > patience:
                rate, bad = max(rate * factor, float(floor)), 0
            return epoch, rate

        return step

    rows = epochs.select(*runs, F.col("epoch").cast("long").alias("epoch"), F.col(metric).cast("double").alias("_m"))
    return in_order(rows, list(runs), [F.col("epoch"), F.col("_m")], ["epoch", "_m"], begin, "epoch long, rate double")


def cumulative_metrics(batches: DataFrame, order: list[str], *keys: str) -> DataFrame:
    """Running tp, fp, fn, tn and sample-weighted loss within each key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = {f"run_{c}": F.sum(c).over(w) for c in ("tp", "fp", "fn", "tn")}
    return batches.withColumns(sums)
