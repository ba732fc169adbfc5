"""Confusion metrics, losses and epoch selection.

Orders stand for samples, their lines for cells, priorities for classes and customers for patients: a cell is foreground if
it was returned, and its score is ten times the discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import confusion, selection
from quern.plans.registry import query, read

THRESHOLDS = [0.2, 0.35, 0.5, 0.65, 0.8]

CELLS_SQL = """px AS (SELECT l_orderkey AS sample_id, o_orderpriority AS tumor_type, o_custkey AS patient, l_returnflag = 'R' AS t, l_discount * 10 AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def counts_sql(threshold: str = "0.5", source: str = "px", extra: str = "") -> str:
    return f"""SELECT sample_id, tumor_type, patient{extra}, count(*) FILTER (score >= {threshold} AND t) AS tp, count(*) FILTER (score >= {threshold} AND NOT t) AS fp,
  count(*) FILTER (score < {threshold} AND t) AS fn, count(*) FILTER (score < {threshold} AND NOT t) AS tn FROM {source} GROUP BY ALL"""


def ratios_sql(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn", empty_accuracy: str = "0.0") -> dict[str, str]:
    div = lambda a, b, empty: f"CASE WHEN {b} = 0 THEN {empty} ELSE CAST({a} AS DOUBLE) / ({b}) END"
    flag = lambda x: f"(CASE WHEN {x} = 0 THEN 1.0 ELSE 0.0 END)"
    return {
        "iou": div(tp, f"({tp} + {fp} + {fn})", "1.0"),
        "dice": div(f"(2 * {tp})", f"(2 * {tp} + {fp} + {fn})", "1.0"),
        "precision": div(tp, f"({tp} + {fp})", flag(f"({tp} + {fn})")),
        "recall": div(tp, f"({tp} + {fn})", flag(f"({tp} + {fp})")),
        "specificity": div(tn, f"({tn} + {fp})", "1.0"),
        "accuracy": div(f"({tp} + {tn})", f"({tp} + {fp} + {fn} + {tn})", empty_accuracy),
    }


CF_SQL = f"{CELLS_SQL}, cf AS ({counts_sql()})"
SR_SQL = f"{CF_SQL}, sr AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in ratios_sql().items())} FROM cf)"

_MICRO = ratios_sql(*[f"sum({c})" for c in confusion.COUNTS], empty_accuracy="1.0")
METRIC_SQL = ", ".join(
    ["count(*) AS num_samples", "count(*) FILTER (tp + fn > 0) AS positive_samples", "count(*) FILTER (tp + fn = 0) AS empty_samples"]
    + [f"round(avg({r}), 6) AS macro_{r}" for r in confusion.RATIOS]
    + [f"round({_MICRO[r]}, 6) AS micro_{r}" for r in confusion.RATIOS]
    + [f"round(coalesce(avg({r}) FILTER (tp + fn > 0), 0.0), 6) AS positive_macro_{r}" for r in ("iou", "dice")]
    + ["round(coalesce(avg(CASE WHEN fp > 0 THEN 1.0 ELSE 0.0 END) FILTER (tp + fn = 0), 0.0), 6) AS empty_false_positive_rate"]
    + ["round(coalesce(avg(CAST(tp + fp AS DOUBLE) / (tp + fp + fn + tn)) FILTER (tp + fn = 0), 0.0), 6) AS empty_predicted_fraction"]
)


KEYS = ["sample_id", "tumor_type", "patient"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted before the join with orders, so that one row per sample meets it."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_returnflag") == "R").alias("t"), (F.col("l_discount") * 10).alias("score"))
    counts = confusion.confusion_counts(lines, ["sample_id"], F.col("score"), F.col("t"), 0.5)
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("tumor_type"), F.col("o_custkey").alias("patient"))
    return counts.join(orders, "sample_id").select(*KEYS, *confusion.COUNTS)


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    names = names or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"WITH {CF_SQL} SELECT * FROM cf")
def confusion_per_sample(spark, sf_dir):
    return samples(spark, sf_dir)


@query(f"WITH {SR_SQL} SELECT sample_id, tumor_type, patient, tp, fp, fn, tn, {', '.join(f'round({r}, 6) AS {r}' for r in confusion.RATIOS)} FROM sr")
def sample_ratios(spark, sf_dir):
    return rounded(confusion.sample_ratios(samples(spark, sf_dir)))


@query(f"WITH {SR_SQL} SELECT {METRIC_SQL} FROM sr")
def metrics_overall(spark, sf_dir):
    return rounded(confusion.metrics(confusion.sample_ratios(samples(spark, sf_dir))))


@query(f"WITH {SR_SQL} SELECT tumor_type, {METRIC_SQL} FROM sr GROUP BY tumor_type")
def metrics_per_class(spark, sf_dir):
    return rounded(confusion.metrics(confusion.sample_ratios(samples(spark, sf_dir)), "tumor_type"))


@query(f"WITH {SR_SQL} SELECT tumor_type, 0 AS is_total, {METRIC_SQL} FROM sr GROUP BY tumor_type UNION ALL SELECT NULL, 1, {METRIC_SQL} FROM sr")
def metrics_grouping_sets(spark, sf_dir):
    return rounded(confusion.metrics_with_total(confusion.sample_ratios(samples(spark, sf_dir)), "tumor_type")).withColumn("is_total", F.col("is_total").cast("int"))


@query("SELECT event_type, round(sum(value * (event_id % 7 + 1)) / sum(event_id % 7 + 1), 6) AS loss FROM events GROUP BY event_type")
def weighted_loss_mean(spark, sf_dir):
    batches = read(spark, sf_dir, "events").withColumn("n", F.col("event_id") % 7 + 1)
    return rounded(confusion.weighted_mean_loss(batches, "value", "n", "event_type"))


_P = "(0.01 + 0.98 * l_discount * 10)"


@query(f"""WITH c AS (SELECT l_orderkey AS s, {_P} AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS t FROM lineitem),
  e AS (SELECT *, -(t * ln(p) + (1 - t) * ln(1 - p)) AS b FROM c),
  f AS (SELECT *, (CASE WHEN t = 1 THEN 0.75 ELSE 0.25 END) * power(1 - (CASE WHEN t = 1 THEN p ELSE 1 - p END), 2.0) * b AS fo FROM e),
  g AS (SELECT s, sum(p * t) AS pt, sum(p) AS p, sum(t) AS t, sum(b) AS b, sum(fo) AS fo, count(*) AS n FROM f GROUP BY s),
  h AS (SELECT 1 - avg((2 * pt + 1) / (p + t + 1)) AS d, coalesce(1 - avg((2 * pt + 1) / (p + t + 1)) FILTER (t > 0), 0.0) AS pd, sum(b) / sum(n) AS bce, sum(fo) / sum(n) AS fo FROM g)
  SELECT round(d, 6) AS dice_loss, round(pd, 6) AS positive_dice_loss, round(bce, 6) AS bce_loss, round(fo, 6) AS focal_loss, round((bce + d) / 2, 6) AS bce_dice_loss,
  round((bce + pd) / 2, 6) AS bce_positive_dice_loss FROM h""")
def losses(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.lit(0.01) + F.lit(0.98) * F.col("l_discount") * 10).alias("p"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("t"))
    return rounded(confusion.losses(rows, "l_orderkey", F.col("p"), F.col("t")))


_TH = f"WITH {CELLS_SQL}, th AS (SELECT unnest([0.2, 0.35, 0.5, 0.65, 0.8])::DOUBLE AS threshold), cf AS ({counts_sql('threshold', 'px, th', ', threshold')}), sc AS (SELECT threshold, avg({ratios_sql()['iou']}) AS m FROM cf GROUP BY threshold)"


def _searched(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_returnflag") == "R").alias("t"), (F.col("l_discount") * 10).alias("score"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))
    found = selection.threshold_search(lines, ["sample_id"], F.col("score"), F.col("t"), THRESHOLDS, orders)
    return rounded(confusion.sample_ratios(found).groupBy("threshold").agg(F.avg("iou").alias("macro_iou")), 6, "macro_iou")


@query(f"{_TH} SELECT threshold, round(m, 6) AS macro_iou FROM sc")
def threshold_search(spark, sf_dir):
    return _searched(spark, sf_dir)


@query(f"{_TH} SELECT threshold, round(m, 6) AS macro_iou FROM sc ORDER BY round(m, 6) DESC, abs(threshold - 0.5), threshold LIMIT 1")
def threshold_best(spark, sf_dir):
    return selection.best_threshold(_searched(spark, sf_dir), "macro_iou")


@query(f"WITH {SR_SQL}, p AS (SELECT patient, avg(iou) AS m FROM sr WHERE tp + fn > 0 GROUP BY patient) SELECT count(*) AS groups, round(avg(m), 6) AS mean_iou FROM p")
def patient_two_level_mean(spark, sf_dir):
    return rounded(confusion.group_mean(confusion.sample_ratios(samples(spark, sf_dir)).where("tp + fn > 0"), "patient", "iou"))


_BUCKETS = (("tiny", 1, 1), ("small", 2, 3), ("medium", 4, 5), ("large", 6, 6), ("huge", 7, None))


@query(f"""WITH {SR_SQL}, b AS (SELECT CASE WHEN tp + fn = 1 THEN 'tiny' WHEN tp + fn BETWEEN 2 AND 3 THEN 'small' WHEN tp + fn BETWEEN 4 AND 5 THEN 'medium' WHEN tp + fn = 6 THEN 'large'
  WHEN tp + fn >= 7 THEN 'huge' END AS bucket, iou FROM sr), n(bucket_order, bucket) AS (VALUES (0, 'tiny'), (1, 'small'), (2, 'medium'), (3, 'large'), (4, 'huge'))
  SELECT bucket_order, n.bucket, count(iou) AS num_samples, round(avg(iou), 6) AS mean_iou FROM n LEFT JOIN b ON n.bucket = b.bucket GROUP BY 1, 2""")
def size_buckets(spark, sf_dir):
    return rounded(confusion.size_buckets(confusion.sample_ratios(samples(spark, sf_dir)), F.col("tp") + F.col("fn"), "iou", _BUCKETS))


@query(f"WITH {SR_SQL} SELECT CAST(least(floor(iou * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM sr GROUP BY 1")
def histogram20(spark, sf_dir):
    return confusion.histogram(confusion.sample_ratios(samples(spark, sf_dir)), "iou", 20)


_WEIGHTS = f"WITH {CF_SQL}, n AS (SELECT count(*) FILTER (tp + fn > 0) AS p, count(*) FILTER (tp + fn = 0) AS e FROM cf) SELECT sample_id, round(CASE WHEN tp + fn > 0 THEN 0.5 / p ELSE 0.5 / e END, 12) AS weight FROM cf, n"


@query(_WEIGHTS)
def balanced_weights(spark, sf_dir):
    weighed = confusion.balanced_weights(samples(spark, sf_dir), F.col("tp") + F.col("fn") > 0)
    return rounded(weighed.select("sample_id", "weight"), 12)


_OFFSET = int.from_bytes(b"42".ljust(4, b"0"), "big") / 2**32


@query(f"""WITH w AS ({_WEIGHTS.replace('round(', '').replace(', 12) AS weight', ' AS weight')}), h AS (SELECT sample_id, weight, sha256('42|' || sample_id) AS h FROM w),
  c AS (SELECT sample_id, sum(weight) OVER o / sum(weight) OVER () AS upto, coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(weight) OVER () AS start FROM h WINDOW o AS (ORDER BY h, sample_id))
  SELECT sample_id, CAST(ceil(round(upto * 10000 - {_OFFSET!r}::DOUBLE, 9)) - ceil(round(start * 10000 - {_OFFSET!r}::DOUBLE, 9)) AS INTEGER) AS draws FROM c""")
def balanced_draw(spark, sf_dir):
    """Draws with replacement by balanced weight, at systematic positions in hash order."""
    weighed = confusion.balanced_weights(samples(spark, sf_dir), F.col("tp") + F.col("fn") > 0)
    return confusion.systematic_draw(weighed, "weight", 10_000, "42", "sample_id").select("sample_id", "draws")


_BATCH = "b AS (SELECT event_type, ts, event_id, event_id % 5 AS tp, event_id % 3 AS fp, event_id % 4 AS fn, event_id % 11 AS tn FROM events)"


@query(f"""WITH {_BATCH}, r AS (SELECT event_id, event_type, sum(tp) OVER w AS run_tp, sum(fp) OVER w AS run_fp, sum(fn) OVER w AS run_fn, sum(tn) OVER w AS run_tn FROM b
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, event_type, CAST(run_tp AS BIGINT) AS run_tp, CAST(run_fp AS BIGINT) AS run_fp,
  CAST(run_fn AS BIGINT) AS run_fn, CAST(run_tn AS BIGINT) AS run_tn, round({ratios_sql('run_tp', 'run_fp', 'run_fn', 'run_tn')['iou']}, 6) AS run_iou FROM r""")
def running_metrics(spark, sf_dir):
    id_ = F.col("event_id")
    batches = read(spark, sf_dir, "events").select("event_id", "event_type", "ts", *[(id_ % k).alias(c) for c, k in zip(confusion.COUNTS, (5, 3, 4, 11), strict=True)])
    run = selection.cumulative_metrics(batches, ["ts", "event_id"], "event_type").drop("ts", *confusion.COUNTS)
    iou = confusion.ratios(*[F.col(f"run_{c}") for c in confusion.COUNTS])["iou"]
    return rounded(run.withColumn("run_iou", iou))


_EPOCHS = "ep AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS epoch, value AS metric, event_id % 9 / 10.0 AS threshold FROM events)"
_TRACKED = f"""{_EPOCHS}, im AS (SELECT *, coalesce(metric > coalesce(max(metric) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE), false) AS improved FROM ep),
  tr AS (SELECT user_id, epoch, metric, threshold, improved, max(metric) OVER w AS best, max(CASE WHEN improved THEN epoch END) OVER w AS best_epoch,
  CAST(epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER w, 0) AS INTEGER) AS bad_epochs FROM im WINDOW w AS (PARTITION BY user_id ORDER BY epoch ROWS UNBOUNDED PRECEDING))"""


def epochs(spark, sf_dir):
    number = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").select("user_id", number.alias("epoch"), F.col("value").alias("metric"), (F.col("event_id") % 9 / 10).alias("threshold"))


@query(f"WITH {_TRACKED} SELECT t.user_id, t.epoch, t.metric, t.improved, t.best, t.best_epoch, t.bad_epochs, CAST(b.threshold AS DOUBLE) AS best_threshold FROM tr t JOIN tr b ON t.user_id = b.user_id AND t.best_epoch = b.epoch")
def running_best(spark, sf_dir):
    return selection.running_best(epochs(spark, sf_dir), "metric", "user_id", extra="threshold").drop("threshold")


@query(f"WITH {_TRACKED}, st AS (SELECT user_id, min(epoch) FILTER (bad_epochs >= 10) AS stop_epoch FROM tr GROUP BY user_id) SELECT user_id, epoch, metric, bad_epochs, stop_epoch FROM tr JOIN st USING (user_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch")
def early_stop(spark, sf_dir):
    return selection.early_stop(epochs(spark, sf_dir), "metric", 10, "user_id").select("user_id", "epoch", "metric", "bad_epochs", "stop_epoch")


@query(f"""WITH {_EPOCHS} SELECT user_id, (SELECT min(epoch) FROM ep x WHERE x.user_id = e.user_id AND x.metric = max(e.metric)) AS best_epoch, max(metric) AS best_metric, max(epoch) AS last_epoch, arg_max(metric, epoch) AS last_metric FROM ep e GROUP BY user_id""")
def best_last_epoch(spark, sf_dir):
    return selection.best_and_last(epochs(spark, sf_dir), "metric", "user_id")


@query(f"""WITH RECURSIVE {_EPOCHS}, f AS (SELECT user_id, epoch, metric AS best, 0 AS bad, CAST(0.1 AS DOUBLE) AS rate FROM ep WHERE epoch = 1
    UNION ALL SELECT e.user_id, e.epoch, CASE WHEN better THEN metric ELSE best END, CASE WHEN better OR bad + 1 > 3 THEN 0 ELSE bad + 1 END, CASE WHEN NOT better AND bad + 1 > 3 THEN greatest(rate * 0.5, 1e-4) ELSE rate END
      FROM (SELECT e.user_id, e.epoch, e.metric, f.best, f.bad, f.rate, e.metric > f.best * (1 + CAST(1e-4 AS DOUBLE)) AS better FROM f JOIN ep e ON e.user_id = f.user_id AND e.epoch = f.epoch + 1) e)
  SELECT user_id, CAST(epoch AS BIGINT) AS epoch, round(rate, 12) AS rate FROM f""")
def reduce_on_plateau(spark, sf_dir):
    return rounded(selection.reduce_on_plateau(epochs(spark, sf_dir), "metric", 0.1, 0.5, 3, 1e-4, "user_id"), 12)
