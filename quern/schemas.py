"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(columns: str) -> T.StructType:
    """A schema from ``name type, name type``; Spark's own parser needs a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


MANIFEST = _schema(
    "sample_id string, source_id int, tumor_type string, group_id string, split string, image_path string, mask_path string, image_sha256 string, "
    "mask_sha256 string"
)
GROUP_MAP = _schema("sample_id string, group_id string")
SAMPLE_METRICS = _schema(
    "sample_id string, tumor_type string, image_path string, mask_path string, iou double, dice double, precision double, recall double, "
    "specificity double, accuracy double, true_positive long, false_positive long, false_negative long, true_negative long"
)
PIXEL_AUDIT = _schema(
    "sample_id string, tumor_type string, source_dataset string, original_split string, split string, group_id string, image_path string, "
    "mask_path string, image_pixel_sha256 string, mask_pixel_sha256 string, image_distinct_values int, image_min int, image_max int, image_mean "
    "double, image_stddev double, mask_distinct_values int, mask_binary boolean, foreground_pixels long, foreground_fraction double, mask_min_x "
    "int, mask_min_y int, mask_max_x int, mask_max_y int, actual_image_sha256 string, actual_mask_sha256 string"
)
QUARANTINE = _schema("candidate_id string, source_dataset string, tumor_type string, duplicate_group string, reason string, minimum_mask_iou double")
ISSUES = _schema("severity string, code string, count long, detail string")
EPOCH_METRICS = _schema(
    "loss double, macro_iou double, macro_dice double, micro_iou double, micro_dice double, positive_macro_iou double, positive_macro_dice "
    "double, empty_false_positive_rate double"
)
EPOCH_RECORD = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("train", EPOCH_METRICS),
        T.StructField("val", EPOCH_METRICS),
        T.StructField("primary_metric", T.StringType()),
        T.StructField("selection_metric_value", T.DoubleType()),
        T.StructField("selection_threshold", T.DoubleType()),
        T.StructField("best_threshold", T.DoubleType()),
        T.StructField("best_val_metric", T.DoubleType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
    ]
)
CASE_MAP = _schema("case_id string, sample_id string, group_id string, split string")
SPLITS = ("train", "val", "test")
