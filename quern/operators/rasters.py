"""Square rasters as arrays: statistics, orientations and pair comparison."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.kernels import correlation, kernel, nearest_places, overlap, population_sd, turns

ORIENTATIONS = ("identity", "flip_h", "flip_v", "rotate_180", "rotate_90", "rotate_270", "transpose", "anti_transpose")
INVERSE = {name: name for name in ORIENTATIONS} | {"rotate_90": "rotate_270", "rotate_270": "rotate_90"}


def permutation(name: str, size: int) -> list[int]:
    """Index of the source cell of each cell of a turned raster, row by row."""
    return turns(name, size).tolist()


def turned(cells: Column, name: str, size: int) -> Column:
    """A square raster of whole values in one of ORIENTATIONS."""
    return kernel(lambda m: np.take(m, turns(name, size), 1), "array<int>", size * size, cells)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def statistics(rasters: DataFrame, cells: str, size: int, foreground: float = 0.0, source: tuple[int, int] | None = None) -> DataFrame:
    """min, max, mean, population SD, distinct values, foreground cells (over ``foreground``) and their bounding box.

    With ``source``, the cells are rasters of that (width, height), and the statistics those of their nearest cells in the
    square; a task then holds a few of the large rasters at a time, and none becomes a column.
    """
    value = F.col(cells)

    def of(measure, kind: str) -> Column:
        if source is None:
            return kernel(measure, kind, None, value)
        return kernel(lambda m: measure(np.take(m, nearest_places(source, (size, size)), 1)), kind, source[0] * source[1], value, wide=size * size)

    def box(m: np.ndarray) -> np.ndarray:
        on = (m > foreground).reshape(len(m), -1, size)
        across, down = on.any(1), on.any(2)
        some = across.any(1)
        edge = lambda x: (x.argmax(1), x.shape[1] - 1 - x[:, ::-1].argmax(1))
        return np.column_stack([on.sum((1, 2)), *(np.where(some, e, -1) for e in (*edge(across), *edge(down)))])

    out = rasters.withColumn("_box", of(box, "array<int>"))
    places = {n: F.get("_box", k) for k, n in enumerate(("foreground", "min_x", "max_x", "min_y", "max_y"))}
    if source is None:
        least, most, distinct = F.array_min(value).cast("double"), F.array_max(value).cast("double"), F.size(F.array_distinct(value))
    else:
        least, most, distinct = of(lambda m: m.min(1), "double"), of(lambda m: m.max(1), "double"), of(lambda m: [len(np.unique(row)) for row in m], "int")
    return out.withColumns(
        {"min": least, "max": most, "mean": of(lambda m: m.mean(1, dtype=np.float64), "double"), "sd": of(population_sd, "double"), "distinct_values": distinct, **places}
    ).drop("_box")


def mask_iou(a: Column, b: Column, foreground: float = 0.0) -> Column:
    """Intersection over union of the foregrounds; 1 if both are empty, null where the sizes differ."""
    return kernel(lambda x, y: overlap(x > foreground, y > foreground), "double", None, a, b, rasters=2)


def psnr(mean_square: Column, peak: float = 255.0) -> Column:
    """Decibels; infinite for equal rasters."""
    return F.when(mean_square == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / mean_square))


def hash_distance(a: Column, b: Column) -> Column:
    """Bits in which two hashes of four longs differ."""
    return hamming(a[0], b[0]) + hamming(a[1], b[1]) + hamming(a[2], b[2]) + hamming(a[3], b[3])


def block_sides(rows: DataFrame, spread: Column, blocks: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, with ``_i`` and ``_j``, so that a join on these compares every two blocks once.

    A row's block is a hash of ``spread`` modulo ``blocks``.  Where _i = _j both sides hold the same rows.
    """
    own = F.pmod(F.xxhash64(spread), blocks.cast("long")).cast("int")
    left = rows.withColumn("_i", own).withColumn("_j", F.explode(F.sequence("_i", (blocks - 1).cast("int"))))
    right = rows.withColumn("_j", own).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j"))))
    return left, right


def hamming_blocks(left: DataFrame, right: DataFrame, keys: tuple[str, ...], distance: int, block: int = 4096) -> DataFrame:
    """keys, hl, hr and d of the hashes ``h`` of two frames within ``distance``, by comparison of all with all, in blocks.

    For distances at which no band of a hash is selective; the number of comparisons is the product of the rows.
    """
    n = [max(1, -(-side.count() // block)) for side in (left, right)]
    n = [max(x, 4) for x in n]
    deal = lambda side, name, own, other: side.select(*keys, F.col("h").alias(name), F.pmod(F.xxhash64("h"), F.lit(n[own])).alias(f"_{own}"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n[other] - 1).cast("long"))).alias(f"_{other}"))
    apart = hash_distance(F.col("hl"), F.col("hr"))
    return deal(left, "hl", 0, 1).join(deal(right, "hr", 1, 0), ["_0", "_1", *keys]).where(apart <= distance).select(*keys, "hl", "hr", apart.alias("d"))


def verify_pairs(pairs: DataFrame, rasters: DataFrame, key: str, cells: str, size: int, foreground: float = 0.0) -> DataFrame:
    """Correlation, MAE, RMSE, PSNR, mask IoU and mismatching cells of given pairs (a, b, transform) at full size.

    A mask cell is one of ``foreground`` or more.
    """

    def measures(ca: np.ndarray, cb: np.ndarray, turn: np.ndarray) -> np.ndarray:
        m = np.take_along_axis(ca, np.stack([turns(n, size) for n in ORIENTATIONS])[turn], 1).astype(np.float64)
        apart = m - cb
        ma, mb = m >= foreground, cb >= foreground
        parts = (correlation(m, cb, 1e-12), np.abs(apart).mean(1), (apart * apart).mean(1), overlap(ma, mb), (apart != 0).sum(1), (ma != mb).sum(1))
        return np.column_stack(parts)

    x = rasters.select(F.col(key).alias("a"), F.col(cells).alias("ca"))
    y = rasters.select(F.col(key).alias("b"), F.col(cells).alias("cb"))
    turn = (F.array_position(F.array(*[F.lit(n) for n in ORIENTATIONS]), F.col("transform")) - 1).cast("int")
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "transform", kernel(measures, "array<double>", size * size, "ca", "cb", turn, rasters=2).alias("v"))
    at = lambda k: F.get("v", k)
    return joined.select(
        "a", "b", "transform", at(0).alias("full_correlation"), at(1).alias("mae"), F.sqrt(at(2)).alias("rmse"), psnr(at(2)).alias("psnr"), at(3).alias("full_mask_iou"),
        at(4).cast("long").alias("image_mismatch"), at(5).cast("long").alias("mask_mismatch"),
    )


def strong_duplicate(correlation: float = 0.998, most_mae: float = 3.0) -> Column:
    return (F.col("full_correlation") >= correlation) & (F.col("mae") <= most_mae)


def likely_duplicate(correlation: float = 0.98, iou: float = 0.90) -> Column:
    return (F.col("full_correlation") >= correlation) & (F.col("full_mask_iou") >= iou)


def strong_candidate(distance: int = 8, correlation: float = 0.98) -> Column:
    """Of a near pair before its verification at full size."""
    return (F.col("distance") <= distance) & (F.col("correlation") >= correlation)


def letterbox(width: Column, height: Column, target: int) -> dict[str, Column]:
    """Size and offset of a raster scaled into a square and centred; half to even."""
    scale = F.least(F.lit(float(target)) / width, F.lit(float(target)) / height)
    w = F.greatest(F.bround(width * scale).cast("int"), F.lit(1))
    h = F.greatest(F.bround(height * scale).cast("int"), F.lit(1))
    half = lambda x: F.floor((F.lit(target) - x) / 2).cast("int")
    return {"scaled_width": w, "scaled_height": h, "offset_x": half(w), "offset_y": half(h)}


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Integer luma of 8-bit channels."""
    return F.floor((299 * red + 587 * green + 114 * blue + 500) / 1000).cast("int")
