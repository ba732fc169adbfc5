"""CSV, JSON and JSONL tables with the checks that their consumers rely on."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.columns import case_identifier
from quern.operators.images import resized_bilinear, resized_nearest
from quern.operators.splitting import validate
from quern.schemas import EPOCH_RECORD, GROUP_MAP, MANIFEST, SPLITS
from quern.sources.charts import ALARM, HIT, IMAGE_SHARE, MISS
from quern.sources.png import with_png
from quern.storage import delete, put, replace


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_manifest(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """A manifest CSV: exactly the manifest's columns in any order, an optional byte order mark, integer source_id."""
    header = _header(spark, path)
    if sorted(header) != sorted(MANIFEST.names):
        raise ValueError(f"manifest columns {header}, expected {MANIFEST.names}")
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.when(F.col(c).isNull() | F.col(c).try_cast("int").isNotNull(), F.col(c).try_cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{c} isn't an integer: "), F.col(c))))
    rows = raw.select(*[(number(f.name).cast("int") if f.dataType.typeName() == "integer" else F.col(f.name)).alias(f.name) for f in MANIFEST])
    if validate:
        bad = rows.where(~F.col("split").isin(*SPLITS) | F.col("split").isNull()).limit(1).count()
        repeated = rows.groupBy("sample_id").count().where("count > 1").limit(1).count()
        if bad or repeated:
            raise ValueError("manifest has an unknown split or a repeated sample_id")
    return rows


def read_group_map(spark: SparkSession, path: str) -> DataFrame:
    """sample_id and group_id, trimmed; blanks and repeated sample ids are errors, further columns are ignored."""
    header = _header(spark, path)
    if not {"sample_id", "group_id"} <= set(header):
        raise ValueError(f"group map needs {GROUP_MAP.names}, has {header}")
    rows = spark.read.option("header", True).csv(path).select(F.trim("sample_id").alias("sample_id"), F.trim("group_id").alias("group_id"))
    empty = F.coalesce(F.col("sample_id"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("group_id"), F.lit("")).eqNullSafe("")
    if rows.where(empty).limit(1).count():
        raise ValueError("group map has blank ids")
    if rows.groupBy("sample_id").count().where("count > 1").limit(1).count():
        raise ValueError("group map repeats a sample_id")
    return rows


def apply_group_map(samples: DataFrame, groups: DataFrame, preview: int = 10) -> DataFrame:
    """``samples`` with the mapped group_id; ids must match in both directions."""
    missing = samples.join(groups, "sample_id", "left_anti").select("sample_id").orderBy("sample_id").limit(preview).collect()
    extra = groups.join(samples, "sample_id", "left_anti").select("sample_id").orderBy("sample_id").limit(preview).collect()
    if missing or extra:
        raise ValueError(f"unmapped: {[r[0] for r in missing]}, unknown: {[r[0] for r in extra]}")
    return samples.drop("group_id").join(groups, "sample_id")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header, all strings; a quote inside a quoted value is doubled."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


_BEFORE = "^[\ufeff \\t\\r\\n]+"


def _objects(texts: DataFrame, schema) -> DataFrame:
    """The columns of the JSON objects in ``value``; any other JSON value, and what isn't JSON, is an error when read."""
    bare = F.regexp_replace("value", _BEFORE, "")
    checked = F.when(bare.startswith("{"), bare).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(bare, 1, 100))))
    return texts.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Objects, one per line; blank lines and a byte order mark are skipped and anything else is an error."""
    schema = schema if schema is not None else spark.read.option("mode", "FAILFAST").json(path).schema
    return _objects(spark.read.text(path).where(F.regexp_replace("value", _BEFORE, "") != ""), schema)


def read_history(spark: SparkSession, path: str, schema=EPOCH_RECORD, parts: bool = False) -> DataFrame:
    """Epoch records; of lines with the same epoch the last of the file wins.

    With ``parts`` the files of the folder are one log in the order of their names, as several tasks write it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    records = lines.withColumn("r", F.from_json("value", schema, {"mode": "FAILFAST"}))
    keys, place = ([], F.struct("file", "line")) if parts else (["file"], F.col("line"))
    return records.groupBy(*keys, F.col("r.epoch").alias("_e")).agg(F.max_by("r", place).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON documents over several lines, one object and one row each; anything else in a file is an error."""
    schema = schema if schema is not None else spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path).schema
    return _objects(spark.read.text(path, wholetext=True), schema)


def read_runs(spark: SparkSession, root: str, file: str, schema=None) -> DataFrame:
    """One table from root/code=*/seed=*/file, with code and seed as columns; a missing run is an absent row."""
    reader = spark.read.option("basePath", root).option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(f"{root}/code=*/seed=*/{file}")


def flatten_epochs(history: DataFrame) -> DataFrame:
    """Numeric fields of the train and val structs as train_* and val_* beside the scalars."""
    out = []
    for field in history.schema:
        if field.dataType.typeName() == "struct":
            out += [F.col(f"{field.name}.{f.name}").alias(f"{field.name}_{f.name}") for f in field.dataType if f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
        else:
            out.append(F.col(field.name))
    return history.select(*out)


def scalars(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` that aren't nested."""
    return rows.select(*[f.name for f in rows.schema if f.dataType.typeName() not in ("struct", "array", "map")])


# ---- sinks ------------------------------------------------------------------------------------------------------------


def write_manifest(rows: DataFrame, path: str) -> str:
    """Write a manifest in its order, as one CSV file, and return the file's SHA-256.

    Assignments that :func:`validate` finds fault with, and an existing target, are errors.
    """
    faults = [f"{r['check']}: {r['violations']}" for r in validate(rows).where("violations > 0").collect()]
    if faults:
        raise ValueError("; ".join(faults))
    rank = F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col("split"))
    ordered = rows.select(*MANIFEST.names).repartition(1).sortWithinPartitions(rank, "tumor_type", "source_id", "sample_id")
    ordered.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(F.sha2("content", 256)).first()[0]


def write_json(spark: SparkSession, value: dict, path: str, overwrite: bool = False) -> None:
    """A JSON document in UTF-8 with sorted keys and a last line end; an existing target is an error unless ``overwrite``."""
    put(spark, path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode(), overwrite)


def write_quoted(rows: DataFrame, path: str) -> None:
    """CSV with every value in quotes."""
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_rows(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV under Spark's commit protocol; without ``overwrite`` an existing target is an error."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


#: Different keys that records may have to become a table.
MOST_COLUMNS = 10_000


def ragged_header(records: DataFrame, fields: str, *order: str, most: int = MOST_COLUMNS) -> list[str]:
    """The keys of all records in the order in which they are first met, records in ``order`` and keys as a record has them."""
    keys = records.select(*order, F.posexplode(F.map_keys(fields)).alias("_place", "_key"))
    first = keys.groupBy("_key").agg(F.min(F.struct(*order, "_place")).alias("_first"))
    found = [r["_key"] for r in first.orderBy("_first").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"records have more than {most} different keys")
    return found


def write_ragged(records: DataFrame, fields: str, path: str, *order: str, header: list[str] | None = None, overwrite: bool = False) -> list[str]:
    """Write records (a map of strings each) as CSV in ``order`` and return the header.

    Without ``header`` that is the union of all keys by first appearance; with it, other keys are left out.  A key that a
    record hasn't got, or whose value is null, is empty.  The folder appears at ``path`` when it is complete.
    """
    spark = records.sparkSession
    header = ragged_header(records, fields, *order) if header is None else header
    held = records.select(*[F.col(o).alias(f"_order{k}") for k, o in enumerate(order)], F.col(fields).alias("_fields"))
    rows = held.orderBy(*[f"_order{k}" for k in range(len(order))]).select(*[F.coalesce(F.col("_fields")[h], F.lit("")).alias(h) for h in header])
    part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    try:
        rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(part)
        replace(spark, part, path, overwrite)
    finally:
        delete(spark, part)
    return header


def prediction_files(samples: DataFrame, size: tuple[int, int], original: tuple[int, int], *order: str, most: int | None = None, threshold: float = 0.5, probabilities: bool = False) -> DataFrame:
    """path and content of the prediction files of the first ``most`` samples (all if None) in a total order.

    ``samples`` has sample_id, tumor_type and probability (array, ``size`` cells).  A sample gives ``<tumor_type>/<id>_pred.png``,
    the mask at its ``original`` size by nearest cells, and with ``probabilities`` ``<id>_prob.png`` beside it, resized
    bilinearly.  Slashes of either kind in an id become underscores.
    """
    chosen = samples.orderBy(*order).limit(most) if most is not None else samples
    stem = F.concat("tumor_type", F.lit("/"), F.regexp_replace("sample_id", r"[/\\\\]", "_"))
    mask = resized_nearest(F.transform("probability", lambda p: F.when(p >= threshold, 255).otherwise(0)), size, original)
    kinds = [F.struct(F.lit("_pred.png").alias("kind"), mask.cast("array<int>").alias("cells"))]
    if probabilities:
        bytes_ = F.transform("probability", lambda p: F.floor(F.greatest(F.least(p * 255, F.lit(255.0)), F.lit(0.0))).cast("int"))
        kinds.append(F.struct(F.lit("_prob.png").alias("kind"), F.transform(resized_bilinear(bytes_, size, original), lambda v: F.floor(v + 0.5).cast("int")).alias("cells")))
    files = chosen.select(stem.alias("stem"), F.explode(F.array(*kinds)).alias("f")).select(F.concat("stem", "f.kind").alias("path"), "f.cells")
    return with_png(files, "cells", *original, name="content").drop("cells")


def saved_predictions(samples: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` samples in a total order."""
    return samples.orderBy(*order).limit(most)


def case_map(manifest: DataFrame) -> DataFrame:
    """case_id, sample_id, group_id and split; a case_id that two samples would share is an error when read."""
    cases = manifest.select(case_identifier(F.col("sample_id")).alias("case_id"), "sample_id", "group_id", "split")
    clash = F.count("*").over(W.partitionBy("case_id"))
    return cases.withColumn("n", clash).withColumn("case_id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("case id clash: "), F.col("case_id")))).otherwise(F.col("case_id"))).drop("n")


def folds(cases: DataFrame) -> DataFrame:
    """The sorted case ids of each development split."""
    return cases.where(F.col("split").isin("train", "val")).groupBy("split").agg(F.array_sort(F.collect_list("case_id")).alias("cases"))


def dataset_description(manifest: DataFrame, channels: list[str]) -> dict:
    """What an exported data set says of itself; ``channels`` are the names of three channels."""
    if len(channels) != 3:
        raise ValueError("three channel names are needed")
    return {
        "channel_names": {str(k): name for k, name in enumerate(channels)}, "labels": {"background": 0, "tumor": 1}, "file_ending": ".png",
        "numTraining": manifest.where(F.col("split").isin("train", "val")).count(), "overwrite_image_reader_writer": "NaturalImage2DIO",
    }


def exported_files(samples: DataFrame, size: int = 256) -> DataFrame:
    """path and png of every channel file and label file of an export.

    ``samples`` has sample_id, split, red, green, blue and mask (arrays of ``size`` x ``size`` values).  Development cases go to
    imagesTr and labelsTr, test cases to imagesTs and labelsTs; a label is 0 or 1.  Other sizes are errors when read.
    """
    case = case_identifier(F.col("sample_id"))
    folder = F.when(F.col("split") == "test", "Ts").otherwise("Tr")
    whole = lambda c: F.when(F.size(c) == size * size, F.col(c)).otherwise(F.raise_error(F.lit(f"expected {size} x {size} values")))
    parts = [F.struct(F.concat(F.lit("images"), folder, F.lit("/"), case, F.lit(f"_{k:04d}.png")).alias("path"), whole(c).cast("array<int>").alias("cells")) for k, c in enumerate(("red", "green", "blue"))]
    label = F.transform(whole("mask"), lambda v: F.when(v >= 128, 1).otherwise(0))
    parts.append(F.struct(F.concat(F.lit("labels"), folder, F.lit("/"), case, F.lit(".png")).alias("path"), label.alias("cells")))
    return with_png(samples.select(F.explode(F.array(*parts)).alias("f")).select("f.path", "f.cells"), "cells", size, size).drop("cells")


#: The curves that are drawn, each with its series as columns of flattened epochs.
CURVES = {
    "loss": ("train_loss", "val_loss"),
    "iou": ("train_macro_iou", "val_macro_iou", "train_micro_iou", "val_micro_iou"),
    "dice": ("train_macro_dice", "val_macro_dice", "train_micro_dice", "val_micro_dice"),
    "precision_recall": ("train_macro_precision", "val_macro_precision", "train_macro_recall", "val_macro_recall"),
    "specificity_accuracy": ("train_macro_specificity", "val_macro_specificity", "train_macro_accuracy", "val_macro_accuracy"),
    "learning_rate": ("learning_rate",),
    "model_selection": ("selection_metric_value", "best_val_metric", "selection_threshold"),
}


def curve_series(epochs: DataFrame) -> DataFrame:
    """curve, series, epoch and value of what is drawn; series that the epochs don't have are left out, and so are nulls."""
    points = [F.struct(F.lit(curve).alias("curve"), F.lit(s).alias("series"), F.col(s).cast("double").alias("value")) for curve, series in CURVES.items() for s in series if s in epochs.columns]
    return epochs.select("epoch", F.explode(F.array(*points)).alias("p")).where("p.value is not null").select("p.curve", "p.series", "epoch", "p.value")


def with_expected(runs: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every expected run; one that isn't there has nulls."""
    return expected.join(runs, keys, "left")


def overlay(image: Column, target: Column, predicted: Column) -> Column:
    """Red, green and blue of a comparison pixel: hits green, false alarms red, misses yellow, over 45 % of the image, rounded down."""
    colour = lambda at: F.floor(
        IMAGE_SHARE * image + (1 - IMAGE_SHARE) * F.when(predicted & target, HIT[at]).when(predicted, ALARM[at]).otherwise(MISS[at])
    ).cast("int")
    return F.struct(*[F.when(target | predicted, colour(k)).otherwise(image.cast("int")).alias(name) for k, name in enumerate(("red", "green", "blue"))])
