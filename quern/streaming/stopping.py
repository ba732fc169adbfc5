"""Best epoch and early stopping while the epochs of many runs arrive, with state per run."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Epochs that wait under one key of the state; each call to the state store is a round trip.
BLOCK = 256


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Within it streams are started on the state store that typed state needs; the session's setting comes back after it."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _over(value: float | None, best: float | None) -> bool:
    """Spark's order of doubles: nothing is over a not-a-number, which is over all else; a null isn't over anything."""
    if value is None:
        return False
    if best is None:
        return value > -math.inf or math.isnan(value)
    return value > best or (math.isnan(value) and not math.isnan(best))


class BestSoFar(StatefulProcessor):
    """Follows one run: epochs are taken in turn from ``first``, and those that come too early wait."""

    def __init__(self, patience: int | None, first: int):
        self.patience, self.first = patience, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        number, real = IntegerType(), DoubleType()
        self.run = handle.getValueState(
            "run",
            StructType([StructField("next", number), StructField("best", real), StructField("best_epoch", number), StructField("best_threshold", real), StructField("bad", number), StructField("stopped", BooleanType())]),
        )
        held = StructType([StructField("epochs", ArrayType(number)), StructField("metrics", ArrayType(real)), StructField("thresholds", ArrayType(real))])
        self.waiting = handle.getMapState("waiting", StructType([StructField("block", number)]), held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        nxt, best, best_epoch, best_threshold, bad, stopped = self.run.get() or (self.first, None, None, None, 0, False)
        if stopped:
            return
        come: dict[int, tuple] = {}
        for r in rows:
            # Of records of one epoch in a batch the smallest counts, whatever the order in which tasks deliver them.
            if r.epoch is not None and r.epoch >= nxt:
                held = (r.metric, r.threshold)
                order = tuple((x is not None, 0.0 if x is None or math.isnan(x) else x, x is not None and math.isnan(x)) for x in held)
                if r.epoch not in come or order < come[r.epoch][0]:
                    come[r.epoch] = (order, held)
        blocks: dict[int, dict[int, tuple]] = {}
        stored, changed = set(), set()

        def block(number: int) -> dict[int, tuple]:
            if number not in blocks:
                blocks[number] = {}
                if self.waiting.containsKey((number,)):
                    stored.add(number)
                    epochs, metrics, thresholds = self.waiting.getValue((number,))
                    blocks[number] = dict(zip(epochs, zip(metrics, thresholds, strict=True), strict=True))
            return blocks[number]

        while not stopped:
            early = block(nxt // BLOCK)
            if nxt in early:  # an earlier batch's record of an epoch came first
                metric, threshold = early.pop(nxt)
                come.pop(nxt, None)
                changed.add(nxt // BLOCK)
            elif nxt in come:
                metric, threshold = come.pop(nxt)[1]
            else:
                break
            improved = _over(metric, best)
            if improved:
                best, best_epoch, bad = metric, nxt, 0
                best_threshold = threshold if threshold is not None else best_threshold
            else:
                bad += 1
                best = metric if best is None else best
            stopped = self.patience is not None and bad >= self.patience
            yield Row(**dict(zip(self._keys, key, strict=True)), epoch=nxt, metric=metric, improved=improved, best=best, best_epoch=best_epoch, bad_epochs=bad, best_threshold=best_threshold, stopped=stopped)
            nxt += 1
            if nxt % BLOCK == 0:  # nothing waits in a block that is passed
                done = nxt // BLOCK - 1
                del blocks[done]
                changed.discard(done)
                if done in stored:
                    self.waiting.removeKey((done,))
        if stopped:
            self.waiting.clear()
        else:
            for epoch, (_, held) in come.items():
                block(epoch // BLOCK).setdefault(epoch, held)
                changed.add(epoch // BLOCK)
            for number in changed:
                if blocks[number]:
                    self.waiting.updateValue((number,), (list(blocks[number]), *map(list, zip(*blocks[number].values(), strict=True))))
                elif number in stored:
                    self.waiting.removeKey((number,))
        self.run.update((nxt, best, best_epoch, best_threshold, bad, stopped))

    def close(self) -> None:
        pass


def follow_runs(epochs: DataFrame, metric: str, *runs: str, threshold: str | None = None, patience: int | None = None, first: int = 1) -> DataFrame:
    """A stream of the epochs of ``runs`` with improved, best, best_epoch, bad_epochs, best_threshold and stopped.

    ``epochs`` has the run's columns, epoch and ``metric``; the rows are those of ``selection.running_best``, and with
    ``patience`` those of ``selection.early_stop``, whatever batches the epochs come in: an epoch is judged once all before
    it have been, from ``first`` on, and one that was judged isn't judged again.  Nothing that comes after a run's end
    counts.  ``stopped`` marks the epoch that ended the run.  State is a few numbers a run and the epochs that wait.
    Start it inside :func:`typed_state`.
    """
    processor = BestSoFar(patience, first)
    processor._keys = runs
    value = F.col(threshold).cast("double") if threshold else F.lit(None).cast("double")
    rows = epochs.select(*runs, F.col("epoch").cast("int").alias("epoch"), F.col(metric).cast("double").alias("metric"), value.alias("threshold"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{r} {kinds[r]}" for r in runs) + ", epoch int, metric double, improved boolean, best double, best_epoch int, bad_epochs int, best_threshold double, stopped boolean"
    return rows.groupBy(*runs).transformWithState(processor, schema, "Append", "None")
