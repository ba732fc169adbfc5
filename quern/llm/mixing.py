"""Mixing sources to target weights.

Words are summed by source, water-filling turns weights into targets, and each document is emitted floor(rate) times
plus once more when a hash of its id falls below the fractional part of its source's rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.text import count_words
from quern.storage import checkpoint, table

#: Hash seeds tried for the Bernoulli copies; a source uses the one whose copies come nearest to its target.
SEEDS = 32


#: Sources up to which the per-source tables (about 60 bytes a row) are broadcast; beyond, they are joined by shuffle.
MOST_SOURCES = 100_000


def _draw(doc_id: Column, seed: Column) -> Column:
    """Eight hex digits, 32 bits of a digest of the id; one digest serves eight seeds."""
    digest = F.sha2(F.concat(F.floor(seed / 8).cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.substring(digest, 8 * (seed % 8) + 1, F.lit(8))


def _limit(fraction: Column) -> Column:
    """The hex digits that a draw must lie below to fall under ``fraction`` of all draws."""
    least = F.ceil(fraction * F.lit(4294967296.0)).cast("long")
    return F.when(least >= 1 << 32, "~").otherwise(F.lower(F.lpad(F.hex(least), 8, "0")))


def source_targets(sizes: DataFrame, limit: float = 3.0) -> DataFrame:
    """One row per source with ``source_size``, ``target`` and ``rate``.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...; targets share the sum of all sizes, stop at ``limit``
    times the source, and the excess goes to the others by weight.  The level is found by sorting sources by the level
    at which each is full, so no iteration is needed.  ``sizes`` has one row per source, so the windows run over a
    table whose length is the number of sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "source_size", (F.row_number().over(order) % 3).alias("r"))
    weighed = ranked.select("source", "source_size", F.when(F.col("r") == 0, 3).otherwise(F.col("r")).cast("double").alias("weight"))
    weighed = weighed.withColumn("cap", F.lit(limit) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    # The level if exactly the sources that are full earlier stop at their caps; the first that fits is the one.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = weighed.withColumns({"level": level, "place": F.row_number().over(by_level)})
    reached = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)["level"]
    filled = filled.withColumn("reached", reached)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(F.col("reached"), F.col("full_at")))
    return filled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def plan_mix(docs: DataFrame, limit: float = 3.0) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    Null text has size 0; a source without words has target 0 and no copies; a null source is one more source; repeated
    ids get the same draw; of seeds that miss a target equally the lowest is used; an empty table stays empty.  Columns of ``docs`` with one of these names are replaced.  The table by source is small
    (one row each with ``SEEDS`` sums), and Spark chooses how to join it back.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "_s", "_seed", "_below")
    sized = docs.withColumn("size", count_words(F.col("text")))
    sizes = table(sized.select("doc_id", "source", "size"), "sizes")
    rates = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), limit)
    fraction = F.col("rate") - F.floor("rate")
    rates = checkpoint(rates.withColumnRenamed("source", "_s").withColumn("_below", _limit(fraction)))
    small = rates.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(F.broadcast(right) if small else right, left["source"].eqNullSafe(right["_s"]), "left").drop("_s")

    below = lambda seed: _draw(F.col("doc_id"), seed) < F.col("_below")
    drawn = with_source(sizes, rates).groupBy("source").agg(
        F.first("rate").alias("rate"), F.first("source_size").alias("total"),
        *[F.sum(F.when(below(F.lit(k)), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)],
    )
    misses = F.array(*[F.struct(F.abs(F.col(f"s{k}") - fraction * F.col("total")).alias("miss"), F.lit(k).alias("seed")) for k in range(SEEDS)])
    seeds = checkpoint(drawn.select(F.col("source").alias("_s"), F.array_min(misses)["seed"].alias("_seed")))
    chosen = with_source(with_source(sized, rates), seeds)
    return chosen.withColumn("copies", (F.floor("rate") + F.when(below(F.col("_seed")), 1).otherwise(0)).cast("int")).drop("_seed", "_below")


def mix(docs: DataFrame, limit: float = 3.0) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row repeated ``copies`` times."""
    planned = plan_mix(docs, limit).where("copies > 0")
    return planned.withColumn("_n", F.explode(F.expr("sequence(1, copies)"))).select(*docs.columns)
