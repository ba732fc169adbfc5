"""Comparison of models over seeds and patients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.columns import fixed_digits, hash_int, sample_sd
from quern.storage import checkpoint, table


def mean_sd(runs: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean and sample SD (0 for one value) over seeds."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias(f"{value}_mean"), sample_sd(F.col(value)).alias(f"{value}_sd"))


def curve_bands(runs: DataFrame, value: str, seeds: int, *keys: str, high: float | None = 1.0) -> DataFrame:
    """Mean and band of mean ± SD by epoch, over the epochs that all ``seeds`` runs have, clipped to [0, high]."""
    out = mean_sd(runs, value, *keys).where(F.col("n") == seeds)
    low, top = F.greatest(F.col(f"{value}_mean") - F.col(f"{value}_sd"), F.lit(0.0)), F.col(f"{value}_mean") + F.col(f"{value}_sd")
    return out.withColumns({"low": low, "high": top if high is None else F.least(top, F.lit(high))})


def contrast(runs: DataFrame, value: str, seed: str, model: str, signs: dict[str, int]) -> DataFrame:
    """Signed sum of models' values for each seed that has them all: two models give a paired effect, four an interaction."""
    parts = [F.max(F.when(F.col(model) == m, F.col(value))) * s for m, s in signs.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return runs.where(F.col(model).isin(*signs)).groupBy(seed).agg(total.alias("effect"), F.count_distinct(model).alias("_n")).where(F.col("_n") == len(signs)).drop("_n")


def summarise_effects(effects: DataFrame, *keys: str) -> DataFrame:
    """n, mean, SD, number above zero and a verdict by the consistency of the sign."""
    out = effects.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("effect").alias("mean_effect"), sample_sd(F.col("effect")).alias("sd_effect"), F.count_if(F.col("effect") > 0).alias("n_positive"))
    verdict = F.when(F.col("n_positive") == F.col("n"), "consistent_gain").when(F.col("n_positive") == 0, "no_gain").otherwise("mixed")
    return out.withColumn("verdict", verdict)


def patient_differences(samples: DataFrame, value: str, left: str, right: str, model: str = "code", seed: str = "seed", patient: str = "patient") -> DataFrame:
    """Difference of two models for each patient that both have for every seed: means over samples, then over seeds."""
    pair = samples.where(F.col(model).isin(left, right))
    per_seed = pair.groupBy(model, seed, patient).agg(F.avg(value).alias("v"))
    runs = per_seed.select(model, seed).distinct().agg(F.count("*").alias("runs"))
    per_patient = per_seed.groupBy(patient).agg(
        F.avg(F.when(F.col(model) == left, F.col("v"))).alias("l"), F.avg(F.when(F.col(model) == right, F.col("v"))).alias("r"), F.count("*").alias("n")
    )
    return per_patient.crossJoin(F.broadcast(runs)).where("n = runs").select(patient, (F.col("l") - F.col("r")).alias("difference"))


#: Groups whose intervals are computed together, and patients up to which their values are sent to all tasks.
MOST_GROUPS, MOST_SENT_PATIENTS = 1_000, 100_000


def order_statistics(rows: DataFrame, value: str, shares: list[float], *keys: str) -> DataFrame:
    """keys, share and the value at that share of the sorted values, mixed between neighbours: exact percentiles.

    Rows are dealt in ranges of (keys, value); counts by range tell in which one each wanted rank lies, and only those
    ranges are numbered.  Nulls don't count.  Ties are dealt apart, so that a frequent value doesn't fill one range.
    """
    held = table(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_id", F.monotonically_increasing_id()), "values")
    ranges = table(held.repartitionByRange(*keys, "_v", "_id").withColumn("_range", F.spark_partition_id()), "ranges")
    same = W.partitionBy(*keys)
    counts = ranges.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_to": F.sum("_n").over(same.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(same)})
    at = lambda share: F.lit(share) * (F.col("_all") - 1)
    wanted = [F.struct(F.lit(q).alias("share"), rank.cast("long").alias("_rank"), part.alias("_part")) for q in shares for rank, part in ((F.floor(at(q)), 1 - (at(q) - F.floor(at(q)))), (F.floor(at(q)) + 1, at(q) - F.floor(at(q))))]
    found = counts.select("*", F.inline(F.array(*wanted))).where("_part > 0 and _rank >= _to - _n and _rank < _to")
    found = checkpoint(found.select(*keys, "_range", "share", "_part", (F.col("_rank") - F.col("_to") + F.col("_n")).alias("_place")))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys] + [F.col("r._range") == F.col("f._range")]
    cells = found.select(*keys, "_range").distinct()
    numbered = ranges.alias("r").join(cells.alias("f"), on, "left_semi").withColumn("_place", F.row_number().over(W.partitionBy(*keys, "_range").orderBy("_v", "_id")) - 1)
    met = found.alias("f").join(numbered.alias("r"), [*on, F.col("r._place") == F.col("f._place")])
    return met.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys], F.col("f.share").alias("share")).agg(F.sum(F.col("f._part") * F.col("r._v")).alias("value"))


def bootstrap_intervals(differences: DataFrame, value: str, key: str, *groups: str, resamples: int = 10_000, seed: str = "42", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """n, mean, low and high of each group: percentile intervals of the means of resampled patients, all groups in one pass.

    Draw j of resample i is patient number hash(seed|i|j) mod n of its group in key order, so runs agree and a draw's hash
    serves all groups.  A draw is a row that meets its patient's value; nothing holds all patients.
    """
    number = F.row_number().over(W.partitionBy(*groups).orderBy(key)) - 1
    patients = table(differences.select(*groups, number.cast("long").alias("_p"), F.col(value).cast("double").alias("_v")), "patients")
    sizes = patients.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    known = sizes.limit(MOST_GROUPS + 1).collect()
    if len(known) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    kinds = {g: t for g, t in patients.dtypes if g in groups}
    if not known:
        return sizes.withColumns({"low": F.lit(0.0), "high": F.lit(0.0)})
    sides = [[*[F.lit(r[g]).cast(kinds[g]).alias(g) for g in groups], F.lit(r["n"]).cast("long").alias("_n")] for r in known]
    # One group needs no row of its own for each draw, and its patients are found by one long.
    single = len(known) == 1
    serves = sides[0] if single else [F.inline(F.array(*[F.struct(*side) for side in sides]))]
    most = max(r["n"] for r in known)
    # Rows by number, so that tasks share the draws evenly whatever the numbers of resamples and patients.
    draws = differences.sparkSession.range(resamples * most).select(F.expr(f"id div {most}").alias("_i"), (F.col("id") % most + 1).alias("_j"))
    draws = draws.withColumn("_h", hash_int(F.concat_ws("|", F.lit(seed), "_i", "_j"))).select("_i", "_j", "_h", *serves).where("_j <= _n")
    few = patients.limit(MOST_SENT_PATIENTS + 1).count() <= MOST_SENT_PATIENTS
    side = patients.withColumnsRenamed({g: f"_{g}" for g in groups})
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups if not single] + [F.col("_h") % F.col("_n") == F.col("_p")]
    means = draws.join(F.broadcast(side) if few else side, on).groupBy(*groups, "_i").agg((F.sum("_v") / F.first("_n")).alias("m"))
    found = order_statistics(means, "m", [low, high], *groups)
    edges = found.groupBy(*groups).agg(F.max(F.when(F.col("share") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("share") == high, F.col("value"))).alias("high"))
    edges = edges.withColumnsRenamed({g: f"_{g}" for g in groups})
    return sizes.join(edges, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]).select(*groups, "n", "mean", "low", "high")


def bootstrap_interval(differences: DataFrame, value: str, key: str, resamples: int = 10_000, seed: str = "42", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """:func:`bootstrap_intervals` of one group."""
    one = differences.withColumn("_group", F.lit(0))
    return bootstrap_intervals(one, value, key, "_group", resamples=resamples, seed=seed, low=low, high=high).drop("_group")


def rank_models(summary: DataFrame, metric: str, order: str) -> DataFrame:
    """Ranks by descending metric; equals keep the given order.  One row per model, so one window is enough."""
    return summary.withColumn("rank", F.row_number().over(W.orderBy(F.desc(metric), order)))


def delta_to_first(summary: DataFrame, metric: str, order: str) -> DataFrame:
    return summary.withColumn("delta", F.col(metric) - F.first(metric).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def common_patients(samples: DataFrame, runs: int, patient: str = "patient", *run: str) -> DataFrame:
    return samples.groupBy(patient).agg(F.count_distinct(*run).alias("n")).where(F.col("n") == runs).select(patient)


def consistency(runs: DataFrame, config: Column, expected_counts: dict[str, int], *keys: str) -> DataFrame:
    """Issues of each experiment: differing configurations, wrong counts, checkpoints other than the best epoch."""
    rules = [(F.count_distinct(config) > 1, "config_differs")]
    rules += [(F.bool_or(F.col(c) != n), f"{c}_unexpected") for c, n in expected_counts.items()]
    found = runs.groupBy(*keys).agg(F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules])).alias("issues"))
    return found.select(*keys, F.explode("issues").alias("issue"))


def fit_gap(runs: DataFrame, train: str, val: str) -> DataFrame:
    """``runs`` with the training metric less the validation metric at the best epoch."""
    return runs.withColumn("gap", F.col(train) - F.col(val))


def seeds_in_order(runs: DataFrame, seed: str, order: str) -> DataFrame:
    """Each seed once, with its position by first occurrence."""
    first = runs.groupBy(seed).agg(F.min(order).alias("_first"))
    return first.select(seed, F.row_number().over(W.orderBy("_first")).alias("position"))


#: Numbers of samples by split and the threshold that every audited run must have.
RUN_COUNTS = {"train_samples": 525, "val_samples": 173, "test_samples": 352}
RUN_THRESHOLD = 0.5
RUN_FILES = ("config.json", "metrics.jsonl", "summary.json", "best.pt", "test_metrics.json")


def run_issues(runs: DataFrame, expected: DataFrame, *matrix: str, counts: dict[str, int] | None = None, threshold: float = RUN_THRESHOLD, files: tuple[str, ...] = RUN_FILES) -> DataFrame:
    """code, seed and issue of every rule that a run breaks, and missing_run for expected runs that aren't there.

    ``runs`` has code, seed, files (array), config (digest without seed and folder), threshold, best_epoch, checkpoint_epoch,
    the columns of ``counts`` and those of ``matrix``; ``expected`` has code, seed and the matrix's values.
    """
    counts = RUN_COUNTS if counts is None else counts
    same = runs.groupBy("code").agg((F.count_distinct("config") > 1).alias("_differs"))
    wanted = expected.select("code", "seed", *[F.col(m).alias(f"_{m}") for m in matrix], F.lit(True).alias("_expected"))
    rows = runs.withColumn("_there", F.lit(True)).join(wanted, ["code", "seed"], "full_outer").join(same, "code", "left")
    there = F.col("_there").isNotNull()
    rules = [(there & ~F.array_contains("files", f), f"missing_file:{f}") for f in files]
    rules += [(F.col(c) != n, f"{c}_unexpected") for c, n in counts.items()]
    rules += [(F.col("threshold") != threshold, "threshold_unexpected"), (F.col("best_epoch") != F.col("checkpoint_epoch"), "checkpoint_not_best"), (there & F.col("_differs"), "config_differs")]
    rules += [(there & F.col("_expected").isNotNull() & ~F.col(m).eqNullSafe(F.col(f"_{m}")), f"matrix_differs:{m}") for m in matrix]
    rules += [(~there, "missing_run"), (F.col("_expected").isNull(), "unexpected_run")]
    issues = F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))
    return rows.select("code", "seed", F.explode(issues).alias("issue"))


def run_states(runs: DataFrame, epochs: int) -> DataFrame:
    """``runs`` with ``state`` by last epoch (history), checkpoint's epoch and metric rows: missing, resume, complete or inconsistent."""
    history, point, rows = F.col("history"), F.col("checkpoint"), F.col("metrics")
    complete = (rows > 0) & (history >= 1) & ((rows == history) | (history >= epochs))
    state = (
        F.when(history.isNull() & point.isNull() & rows.isNull(), "missing").when(history.isNull() | point.isNull() | (point > history), "inconsistent").when(F.coalesce(complete, F.lit(False)), "complete").otherwise("resume")
    )
    return runs.withColumn("state", state)


def baseline_plan(runs: DataFrame, stages: tuple[str, ...] = ("prepare", "smoke_test", "train", "test", "report")) -> DataFrame:
    """``runs`` with ``next_stage``: the first stage whose column is false, null if none; a later one that is done is ``out_of_order``."""
    first = F.coalesce(*[F.when(~F.coalesce(F.col(s), F.lit(False)), k) for k, s in enumerate(stages)], F.lit(len(stages)))
    ahead = F.greatest(*[F.when(F.coalesce(F.col(s), F.lit(False)), k).otherwise(-1) for k, s in enumerate(stages)]) > first
    names = F.array(*[F.lit(s) for s in stages], F.lit(None).cast("string"))
    return runs.withColumn("next_stage", F.when(ahead, "out_of_order").otherwise(F.get(names, first)))


def report_lines(summary: DataFrame, title: str, columns: dict[str, str], metrics: tuple[str, ...], order: str, missing: str = "-") -> DataFrame:
    """place and line of a Markdown table: a heading, the header, and a row for each row of ``summary`` in order."""
    header = [f"# {title}", "", "| " + " | ".join(columns.values()) + " |", "| " + " | ".join("---:" if c in metrics else "---" for c in columns) + " |"]
    cells = [F.coalesce(fixed_digits(F.col(c)) if c in metrics else F.col(c).cast("string"), F.lit(missing)) for c in columns]
    body = summary.select((F.row_number().over(W.orderBy(order)) + len(header)).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = summary.sparkSession.createDataFrame([(k + 1, line) for k, line in enumerate(header)], "place int, line string")
    return head.unionByName(body)
