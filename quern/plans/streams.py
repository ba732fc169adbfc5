"""Streams over the tables: epochs that arrive in any order, and logs that hold every row once."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.confusion import COUNTS
from quern.plans.metrics import _TRACKED, epochs, ratios_sql
from quern.plans.registry import query, read
from quern.storage import new_path
from quern.streaming import logs, stopping


@query(f"""WITH {_TRACKED}, st AS (SELECT user_id, min(epoch) FILTER (bad_epochs >= 10) AS stop_epoch FROM tr GROUP BY user_id)
  SELECT t.user_id, t.epoch, t.metric, t.improved, t.best, t.best_epoch, t.bad_epochs, CAST(b.threshold AS DOUBLE) AS best_threshold, coalesce(t.epoch = stop_epoch, false) AS stopped FROM tr t JOIN st USING (user_id) LEFT JOIN tr b ON t.user_id = b.user_id AND t.best_epoch = b.epoch
  WHERE stop_epoch IS NULL OR t.epoch <= stop_epoch""")
def streamed_early_stop(spark, sf_dir):
    """Epochs arrive in two runs of the stream, dealt without regard to their order; the second goes on from the checkpoint."""
    rows = epochs(spark, sf_dir)
    arrivals, out, place = (new_path(spark, n) for n in ("arrivals", "followed", "stream"))
    part = F.pmod(F.xxhash64("user_id", "epoch"), F.lit(2))
    for turn in (0, 1):
        rows.where(part == turn).repartition(2, "epoch").write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
        with stopping.typed_state(spark):
            logs.stream_log(stopping.follow_runs(stream, "metric", "user_id", threshold="threshold", patience=10), out, "early_stop", place).awaitTermination()
    schema = "user_id long, epoch int, metric double, improved boolean, best double, best_epoch int, bad_epochs int, best_threshold double, stopped boolean"
    return logs.read_log(spark, out, schema).drop("query", "batch")


_LOSS = "event_id % 7 / 8"
_BATCHES = f"""s AS (SELECT event_type AS run, CAST(event_id // 50 AS INTEGER) AS number, {_LOSS} AS loss, event_id % 5 AS tp, event_id % 3 AS fp, event_id % 4 AS fn, event_id % 11 AS tn FROM events),
  b AS (SELECT run, number, count(*) AS batch_size, sum(loss) AS loss_sum, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM s GROUP BY run, number),
  c AS (SELECT run, number, batch_size, loss_sum / batch_size AS batch_loss, CAST(sum(batch_size) OVER w AS BIGINT) AS processed_samples, sum(loss_sum) OVER w AS loss_so_far, {', '.join(f'sum({c}) OVER w AS {c}' for c in COUNTS)} FROM b WINDOW w AS (PARTITION BY run ORDER BY number ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {_BATCHES} SELECT run, number, batch_size, processed_samples, batch_loss, loss_so_far / processed_samples AS running_loss, {', '.join(f'{v} AS micro_{k}' for k, v in ratios_sql().items())} FROM c""")
def streamed_batch_log(spark, sf_dir):
    """The log of every run's batches, written while the samples arrive, with running loss and metrics."""
    e = F.col("event_id")
    counts = [(e % k).alias(c) for c, k in zip(COUNTS, (5, 3, 4, 11), strict=True)]
    samples = read(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.floor(e / 50).cast("int").alias("number"), (e % 7 / 8).alias("loss"), *counts)
    arrivals, out, place = (new_path(spark, n) for n in ("arrivals", "log", "stream"))
    samples.repartitionByRange(4, "number").write.parquet(arrivals)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    logs.stream_log(stream, out, "batches", place, lambda rows: logs.batch_rows(rows, F.col("loss"), "run", "number")).awaitTermination()
    log = logs.read_log(spark, out, "run string, number int, batch_size long, loss_sum double, tp long, fp long, fn long, tn long")
    return logs.running_log(log, ["number"], "run")
