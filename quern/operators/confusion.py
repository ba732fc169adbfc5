"""Confusion counts and what is computed from them.

Every accumulator is a sum, so partial aggregation in the map tasks leaves one row per key to shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.columns import hash_int, ratio
from quern.operators.kernels import kernel
from quern.storage import checkpoint

COUNTS = ("tp", "fp", "fn", "tn")
RATIOS = ("iou", "dice", "precision", "recall", "specificity", "accuracy")


def confusion_counts(cells: DataFrame, keys: list[str], score: Column, target: Column, threshold: Column | float = 0.5) -> DataFrame:
    """tp, fp, fn and tn for each key; a cell is predicted where score >= threshold."""
    predicted = score >= threshold
    return cells.groupBy(*keys).agg(
        F.count_if(predicted & target).alias("tp"),
        F.count_if(predicted & ~target).alias("fp"),
        F.count_if(~predicted & target).alias("fn"),
        F.count_if(~predicted & ~target).alias("tn"),
    )


def ratios(tp: Column, fp: Column, fn: Column, tn: Column, empty_accuracy: float = 0.0) -> dict[str, Column]:
    """The six ratios; nothing predicted and nothing there counts as a perfect match."""
    predicted, there = tp + fp, tp + fn
    flag = lambda c: F.when(c == 0, 1.0).otherwise(0.0)
    return {
        "iou": ratio(tp, tp + fp + fn, 1.0),
        "dice": ratio(2 * tp, predicted + there, 1.0),
        "precision": ratio(tp, predicted, flag(there)),
        "recall": ratio(tp, there, flag(predicted)),
        "specificity": ratio(tn, tn + fp, 1.0),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn, empty_accuracy),
    }


def sample_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns(ratios(*map(F.col, COUNTS)))


def _metrics(empty: float = 0.0, cells_of_a_sample: int | None = None) -> list[Column]:
    there = F.col("tp") + F.col("fn")
    sums = [F.sum(c) for c in COUNTS]
    cells = F.lit(cells_of_a_sample) if cells_of_a_sample else F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, c)), F.lit(empty))
    out = [F.count("*").alias("num_samples"), F.count_if(there > 0).alias("positive_samples"), F.count_if(there == 0).alias("empty_samples")]
    out += [F.avg(r).alias(f"macro_{r}") for r in RATIOS]
    out += [value.alias(f"micro_{name}") for name, value in ratios(*sums, empty_accuracy=1.0).items()]
    out += [mean(F.col(r), there > 0).alias(f"positive_macro_{r}") for r in ("iou", "dice")]
    out.append(mean(F.when(F.col("fp") > 0, 1.0).otherwise(0.0), there == 0).alias("empty_false_positive_rate"))
    out.append(mean(ratio(F.col("tp") + F.col("fp"), cells, 0.0), there == 0).alias("empty_predicted_fraction"))
    return out


def metrics(samples: DataFrame, *keys: str) -> DataFrame:
    """Macro, micro, positive-only and empty-sample metrics of rows of :func:`sample_ratios`, for each key or over all."""
    return samples.groupBy(*keys).agg(*_metrics())


def metrics_or_nan(samples: DataFrame, cells_of_a_sample: int, *keys: str) -> DataFrame:
    """The metrics as a second implementation has them: means over no sample are NaN, and every sample has as many cells."""
    return samples.groupBy(*keys).agg(*_metrics(float("nan"), cells_of_a_sample))


def metrics_with_total(samples: DataFrame, key: str) -> DataFrame:
    """The metrics for each value of ``key`` and over all, in one pass; ``is_total`` marks the latter."""
    return samples.rollup(key).agg(F.grouping(key).alias("is_total"), *_metrics())


def group_mean(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Mean over groups of the groups' means, with the number of groups."""
    per_group = samples.groupBy(group).agg(F.avg(value).alias("m"))
    return per_group.agg(F.count("*").alias("groups"), F.avg("m").alias(f"mean_{value}"))


def weighted_mean_loss(batches: DataFrame, loss: str, n: str, *keys: str) -> DataFrame:
    return batches.groupBy(*keys).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


#: Lower bounds of the lesion sizes in pixels; 0 pixels lie in no bucket.
SIZE_BUCKETS = (("tiny", 1, 255), ("small", 256, 1023), ("medium", 1024, 4095), ("large", 4096, None))


def size_buckets(samples: DataFrame, pixels: Column, value: str, buckets=SIZE_BUCKETS) -> DataFrame:
    """Count and mean of ``value`` by size bucket; a bucket without samples is kept with count 0 and a null mean."""
    spark = samples.sparkSession
    names = spark.createDataFrame([(k, name) for k, (name, _, _) in enumerate(buckets)], "bucket_order int, bucket string")
    bucket = None
    for name, low, high in buckets:
        fits = (pixels >= low) if high is None else pixels.between(low, high)
        bucket = F.when(fits, name) if bucket is None else bucket.when(fits, name)
    found = samples.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    return names.join(F.broadcast(found), "bucket", "left").select("bucket_order", "bucket", F.coalesce("n", F.lit(0)).alias("num_samples"), F.col("m").alias(f"mean_{value}"))


def histogram(samples: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins of [0, 1], the last one closed."""
    bin_ = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    return samples.where(F.col(value).between(0, 1)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def balanced_weights(samples: DataFrame, positive: Column, fraction: float = 0.5) -> DataFrame:
    """Sampling weights that give positive samples ``fraction`` of the whole; the totals are one broadcast row."""
    totals = samples.agg(F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_empty"))
    weight = F.when(positive, F.lit(fraction) / F.col("n_pos")).otherwise(F.lit(1 - fraction) / F.col("n_empty"))
    return samples.crossJoin(F.broadcast(totals)).withColumn("weight", weight).drop("n_pos", "n_empty")


def draw_with_replacement(samples: DataFrame, weight: str, draws: int, seed: str, key: str) -> DataFrame:
    """``samples`` with ``draws``: how often each is hit by so many independent draws by weight; samples without a hit are kept.

    Draw i falls at hash(seed|i) of the cumulated weights, samples in key order.  Sums run within 256 ranges of keys first; draws
    meet samples by the range of weights that both lie in, so no task holds all of either.
    """
    rows = samples.where(F.col(weight) > 0)
    parts = rows.repartitionByRange(256, key).withColumn("_p", F.spark_partition_id())
    parts = checkpoint(parts.select(key, weight, "_p"))
    sums = parts.groupBy("_p").agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    sums = checkpoint(sums.select("_p", "_n", F.coalesce(F.sum("_w").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_w").over(W.partitionBy()).alias("_all")))
    whole = sums.agg(F.max("_all").alias("w"), F.sum("_n").alias("n")).first()
    if not whole["n"]:
        return samples.withColumn("draws", F.lit(0).cast("long"))
    cell = float(whole["w"]) / whole["n"]
    end = F.col("_base") + F.sum(weight).over(W.partitionBy("_p").orderBy(key).rowsBetween(W.unboundedPreceding, 0))
    placed = parts.join(F.broadcast(sums), "_p").withColumn("_end", end).withColumn("_start", F.col("_end") - F.col(weight))
    at = lambda x: F.floor(x / F.lit(cell))
    placed = placed.select(F.col(key).alias("_key"), "_start", "_end", F.explode(F.sequence(at(F.col("_start")), at(F.col("_end")))).alias("_cell"))
    point = hash_int(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))) / F.lit(4294967296.0) * F.lit(whole["w"])
    drawn = samples.sparkSession.range(draws).select(point.alias("_x")).withColumn("_cell", at(F.col("_x")))
    hits = placed.join(drawn, "_cell").where("_x >= _start and _x < _end").groupBy("_key").agg(F.count("*").alias("draws"))
    return samples.join(hits, samples[key] == hits["_key"], "left").drop("_key").withColumn("draws", F.coalesce("draws", F.lit(0).cast("long")))


def systematic_draw(samples: DataFrame, weight: str, draws: int, seed: str, key: str) -> DataFrame:
    """``draws`` draws by weight at systematic positions: a sample's count differs from its expected one by less than one.

    A sample is drawn once for every point (k + u) / draws inside its interval of the cumulated weights, samples in hash
    order; u comes from the seed.  Sums run within hash buckets first, so no window covers all rows.
    """
    offset = int.from_bytes(seed.encode()[:4].ljust(4, b"0"), "big") / 2**32
    rows = samples.withColumns({"_h": F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)}).withColumn("_b", F.substring("_h", 1, 2))
    buckets = rows.groupBy("_b").agg(F.sum(weight).alias("_w"))
    upto = F.sum("_w").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    buckets = buckets.select("_b", upto.alias("_upto"), F.sum("_w").over(W.partitionBy()).alias("_all")).withColumn("_base", F.coalesce(F.lag("_upto").over(W.orderBy("_b")), F.lit(0.0)))
    order = W.partitionBy("_b").orderBy("_h", key)
    placed = rows.join(F.broadcast(buckets), "_b").withColumn("_sum", F.col("_base") + F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # A row starts where the one before it ends, to the last bit, so that every point lies in exactly one interval.
    last = F.lead("_sum").over(order).isNull()
    placed = placed.withColumns({"_end": F.when(last, F.col("_upto")).otherwise(F.col("_sum")) / F.col("_all"), "_start": F.coalesce(F.lag("_sum").over(order), F.col("_base")) / F.col("_all")})
    start = F.col("_start")
    point = lambda x: F.ceil(F.round(x * draws - offset, 9))
    return placed.withColumn("draws", (point(F.col("_end")) - point(start)).cast("int")).drop("_h", "_b", "_base", "_upto", "_all", "_sum", "_start", "_end")


# ---- losses over cells: one row per cell with sample, p in (0, 1) and t in {0, 1} -----------------------------------------


def bce(p: Column, t: Column, clip: float = 1e-7) -> Column:
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(t * F.log(p) + (1 - t) * F.log(1 - p))


def focal(p: Column, t: Column, alpha: float = 0.75, gamma: float = 2.0) -> Column:
    at, pt = F.when(t == 1, alpha).otherwise(1 - alpha), F.when(t == 1, p).otherwise(1 - p)
    return at * F.pow(1 - pt, F.lit(gamma)) * bce(p, t)


def losses(cells: DataFrame, sample: str, p: Column, t: Column, smooth: float = 1.0) -> DataFrame:
    """Soft Dice, Dice over positive samples, BCE, focal and their usual mixtures, over all cells."""
    per = cells.groupBy(sample).agg(
        F.sum(p * t).alias("pt"), F.sum(p).alias("p"), F.sum(t).alias("t"), F.sum(bce(p, t)).alias("bce"), F.sum(focal(p, t)).alias("focal"), F.count("*").alias("n")
    )
    dice = (2 * F.col("pt") + smooth) / (F.col("p") + F.col("t") + smooth)
    out = per.agg(
        (1 - F.avg(dice)).alias("dice_loss"),
        F.coalesce(1 - F.avg(F.when(F.col("t") > 0, dice)), F.lit(0.0)).alias("positive_dice_loss"),
        (F.sum("bce") / F.sum("n")).alias("bce_loss"),
        (F.sum("focal") / F.sum("n")).alias("focal_loss"),
    )
    half = lambda a, b: (F.col(a) + F.col(b)) / 2
    return out.withColumns({"bce_dice_loss": half("bce_loss", "dice_loss"), "bce_positive_dice_loss": half("bce_loss", "positive_dice_loss")})


def edges(m: np.ndarray, size: int) -> np.ndarray:
    """Largest less smallest value around each cell of square rasters, 3 x 3 cells where they lie inside."""
    grid = np.pad(m.reshape(-1, size, size), ((0, 0), (1, 1), (1, 1)), mode="edge")
    around = np.stack([grid[:, y : y + size, x : x + size] for y in range(3) for x in range(3)])
    return (around.max(0) - around.min(0)).reshape(len(m), -1)


def raster_losses(rasters: DataFrame, p: str, t: str, size: int, smooth: float = 1.0, weights: tuple[float, float, float] = (0.55, 0.30, 0.15)) -> DataFrame:
    """Soft Dice, focal, boundary Dice and their weighted mixture over rasters: one row per sample with arrays ``p`` and ``t``.

    Weights must not be negative and are divided by their sum.
    """
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be non-negative and not all zero")

    def of_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dice = lambda a, b: (2 * (a * b).sum(1) + smooth) / (a.sum(1) + b.sum(1) + smooth)
        held_in = np.clip(x, 1e-7, 1 - 1e-7)
        cross = -np.where(y == 1, np.log(held_in), np.log(1 - held_in))
        hard = np.where(y == 1, 0.75, 0.25) * (1 - np.where(y == 1, x, 1 - x)) ** 2 * cross
        return np.column_stack([dice(x, y), dice(edges(x, size), edges(y, size)), hard.sum(1)])

    found = rasters.select(kernel(of_rows, "array<double>", size * size, F.col(p), F.col(t), rasters=2).alias("v"), F.size(p).alias("n"))
    per = found.select(*[F.get("v", k).alias(c) for k, c in enumerate("dbf")], "n")
    out = per.agg((1 - F.avg("d")).alias("dice_loss"), (F.sum("f") / F.sum("n")).alias("focal_loss"), (1 - F.avg("b")).alias("boundary_loss"))
    parts = [w / sum(weights) * F.col(c) for w, c in zip(weights, ("dice_loss", "focal_loss", "boundary_loss"), strict=True)]
    return out.withColumn("dice_focal_boundary_loss", parts[0] + parts[1] + parts[2])


#: The names of losses, with the columns of :func:`losses` or :func:`raster_losses` that hold them.
LOSSES = {
    "bce": "bce_loss", "bce_dice": "bce_dice_loss", "bce_positive_dice": "bce_positive_dice_loss", "bce_pos_dice": "bce_positive_dice_loss", "focal": "focal_loss", "dice": "dice_loss",
    "boundary": "boundary_loss", "dice_focal_boundary": "dice_focal_boundary_loss", "focal_dice_boundary": "dice_focal_boundary_loss",
}


def build_loss(name: str):
    """Column of :func:`losses` for a loss name."""
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(LOSSES)}")
    return F.col(LOSSES[name])
