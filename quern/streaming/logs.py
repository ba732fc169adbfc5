"""Logs of a stream's batches and samples that hold every row once, also when a batch is run again.

A batch has a folder of its own, named by the query and the batch's number; a batch that is repeated after a failure
replaces that folder instead of adding to the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quern.operators.confusion import COUNTS, ratios


def log_writer(out: str, name: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """What a stream calls with each batch and its number; ``prepare`` turns the batch into the rows of the log."""

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").json(f"{out}/query={name}/batch={number}")

    return write


def stream_log(stream: DataFrame, out: str, name: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Log ``stream`` below ``out`` under the query's name, which must be its own; it goes on where the checkpoint says."""
    return stream.writeStream.foreachBatch(log_writer(out, name, prepare)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, out: str, schema: StructType | str) -> DataFrame:
    """The rows of all finished batches with ``query`` and ``batch``; a folder without its mark is a batch not yet finished."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/query=*/batch=*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    folders = [f.getPath().getParent().toString() for f in found]
    if not folders:
        return spark.createDataFrame([], schema).select("*", F.lit(None).cast("string").alias("query"), F.lit(None).cast("int").alias("batch"))
    return spark.read.schema(schema).option("basePath", out).json(folders).withColumns({"query": F.col("query").cast("string"), "batch": F.col("batch").cast("int")})


def batch_rows(samples: DataFrame, loss: Column, *keys: str) -> DataFrame:
    """One row for each value of ``keys``: batch_size, loss_sum and the confusion counts of its samples."""
    return samples.groupBy(*keys).agg(F.count("*").alias("batch_size"), F.sum(loss).alias("loss_sum"), *[F.sum(c).alias(c) for c in COUNTS])


def running_log(batches: DataFrame, order: list[str], *run: str) -> DataFrame:
    """The log of a run's batches: batch_loss, processed_samples, running_loss and the micro metrics of all samples so far."""
    so_far = W.partitionBy(*run).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = {c: F.sum(c).over(so_far) for c in ("batch_size", "loss_sum", *COUNTS)}
    out = batches.select(*run, *order, "batch_size", (F.col("loss_sum") / F.col("batch_size")).alias("batch_loss"), *[t.alias(f"_{c}") for c, t in totals.items()])
    micro = ratios(*[F.col(f"_{c}") for c in COUNTS])
    return out.select(
        *run, *order, "batch_size", F.col("_batch_size").alias("processed_samples"), "batch_loss", (F.col("_loss_sum") / F.col("_batch_size")).alias("running_loss"), *[v.alias(f"micro_{k}") for k, v in micro.items()]
    )
