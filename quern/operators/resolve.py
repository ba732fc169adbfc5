"""Resolution of duplicate components into kept and quarantined samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.columns import group_digest
from quern.operators.kernels import as_bits, has_null, kernel, overlap_of_bits
from quern.operators.rasters import block_sides
from quern.storage import table


def component_table(members: DataFrame, sample: str, label: str) -> DataFrame:
    """component, size, digest and number of labels of every component."""
    return members.groupBy("component").agg(
        F.count("*").alias("component_size"), group_digest(F.col(sample).cast("string")).alias("duplicate_group"), F.count_distinct(label).alias("n_labels")
    )


def least_member_iou(members: DataFrame, rasters: DataFrame, key: str, cells: str, foreground: float = 0.0, block: int = 512) -> DataFrame:
    """component, min_iou and failed, for :func:`resolve`: the least mask IoU over all pairs of members, as they lie.

    ``members`` has id and component.  Equal masks have an IoU of 1 and are compared once; the different masks of a component
    are compared in blocks of about ``block``.  A component failed if a member has no mask, one with null cells, or one of
    another size; masks of the same size are compared all the same.
    """
    # Masks travel as one bit a cell.
    masks = rasters.select(F.col(key).alias("id"), F.size(cells).alias("n"), has_null(cells).alias("bad"), kernel(lambda m: as_bits(~(m <= foreground)), "array<bigint>", None, cells).alias("mask"))
    mine = members.select("id", "component").join(masks, "id", "left").withColumn("bad", F.coalesce("bad", F.lit(True)))
    mine = table(mine.select("component", "n", "bad", "mask"), "masks")
    failed = mine.groupBy("component").agg((F.bool_or("bad") | F.coalesce(F.min("n") < F.max("n"), F.lit(False))).alias("failed"))
    distinct = mine.where("not bad").select("component", "n", "mask").distinct()
    blocks = distinct.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    left, right = block_sides(distinct.join(blocks, "component"), F.col("mask"), F.col("blocks"))
    left, right = left.select("component", "_i", "_j", "n", F.col("mask").alias("ma")), right.select("component", "_i", "_j", "n", F.col("mask").alias("mb"))
    pairs = left.join(right, ["component", "_i", "_j", "n"]).where("_i < _j or ma < mb")
    least = pairs.groupBy("component").agg(F.min(kernel(overlap_of_bits, "double", None, "ma", "mb", rasters=2)).alias("least"))
    return failed.join(least, "component", "left").select("component", F.coalesce("least", F.lit(1.0)).alias("min_iou"), "failed")


def resolve(members: DataFrame, sample: str, label: str, order: list[Column | str], minimum_iou: DataFrame | None = None, least_iou: float = 0.95, prefix: str = "") -> DataFrame:
    """``members`` with ``reason`` and ``kept``.

    Singles are kept.  A component with several labels is quarantined as label_conflict; with an uncomparable mask as
    mask_compare_error; with a least mask IoU under ``least_iou`` as mask_conflict; else its first member is kept and the
    others are duplicate_redundant.  ``minimum_iou`` has component, min_iou and failed.
    """
    info = component_table(members, sample, label)
    if minimum_iou is None:
        info = info.withColumns({"min_iou": F.lit(None).cast("double"), "failed": F.lit(False)})
    else:
        info = info.join(minimum_iou, "component", "left")
    first = F.row_number().over(W.partitionBy("component").orderBy(*order, sample)) == 1
    reason = (
        F.when(F.col("component_size") == 1, F.lit(None))
        .when(F.col("n_labels") > 1, "label_conflict")
        .when(F.coalesce("failed", F.lit(False)), "mask_compare_error")
        .when(F.col("min_iou") < least_iou, "mask_conflict")
        .when(~F.col("first"), "duplicate_redundant")
    )
    out = members.join(info, "component").withColumn("first", first).withColumn("reason", F.concat(F.lit(prefix), reason))
    return out.withColumn("kept", F.col("reason").isNull()).drop("first", "failed")


def canonical(rows: DataFrame, group: str, *order: Column | str) -> DataFrame:
    """The first member of each group."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")
