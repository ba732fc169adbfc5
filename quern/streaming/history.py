"""Epoch histories that grow by appended JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.schemas import EPOCH_RECORD
from quern.sources.tables import flatten_epochs
from quern.storage import delete


def stream_records(spark: SparkSession, folder: str, schema=EPOCH_RECORD) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def rebuild_history(spark: SparkSession, folder: str, out: str, checkpoint: str, schema=EPOCH_RECORD) -> StreamingQuery:
    """Keep a table of the last record of each epoch while lines arrive: of files the later one, of a file's lines the last.

    A batch meets the table only, not the log it came from.  Each batch writes a new version of the table from the one before,
    so a batch that is run again gives the same table; older versions go.  Read it with :func:`current_history`.
    """
    places = ("_time", "_file", "_line")

    def rebuild(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbered = batch.withColumn("_line", F.monotonically_increasing_id()).where(F.trim("value") != "")
        lines = numbered.withColumn("r", F.from_json("value", schema, {"mode": "FAILFAST"})).select("r.*", *places)
        before = _version(spark, out, below=number)
        if before is not None:
            lines = lines.unionByName(spark.read.parquet(f"{out}/version={before}"))
        last = lines.groupBy("epoch").agg(F.max_by(F.struct(*[f.name for f in schema], *places), F.struct(*places)).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{out}/version={number}")
        if before is not None and (older := _version(spark, out, below=before)) is not None:
            delete(spark, f"{out}/version={older}")

    text = spark.readStream.text(folder).select("value", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"))
    return text.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _version(spark: SparkSession, out: str, below: int | None = None) -> int | None:
    """The last complete version of the table, before batch ``below`` if given."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/version=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    numbers = [int(f.getPath().getParent().getName().split("=")[1]) for f in found]
    return max((n for n in numbers if below is None or n < below), default=None)


def current_history(spark: SparkSession, out: str) -> DataFrame:
    """The flat history that :func:`rebuild_history` has written last."""
    rows = spark.read.parquet(f"{out}/version={_version(spark, out)}")
    return flatten_epochs(rows.drop("_time", "_file", "_line"))


def running_counts(batches: DataFrame, time: str, delay: str, window: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Windowed sums over a stream of batch logs; rows later than ``delay`` are left out.  Works on a static frame too."""
    return batches.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *keys).agg(*[F.sum(c).alias(c) for c in sums]).select(F.col("w.start").alias("start"), *keys, *sums)


def on_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
