"""Comparison of models: event types stand for models, user_id mod 3 for seeds and users for patients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import experiments
from quern.plans.metrics import rounded
from quern.plans.registry import query, read
from quern.streaming import history

RUNS_SQL = "ev AS (SELECT event_type AS code, user_id % 3 AS seed, user_id AS patient, value FROM events), runs AS (SELECT code, seed, avg(value) AS score, count(*) AS n FROM ev GROUP BY 1, 2)"


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("code"), (F.col("user_id") % 3).alias("seed"), F.col("user_id").alias("patient"), "value", "ts")


def _runs(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("code", "seed").agg(F.avg("value").alias("score"), F.count("*").alias("n"))


@query(f"WITH {RUNS_SQL} SELECT code, count(*) AS n, round(avg(score), 6) AS score_mean, round(coalesce(stddev_samp(score), 0.0), 6) AS score_sd FROM runs GROUP BY code")
def mean_sd_by_model(spark, sf_dir):
    return rounded(experiments.mean_sd(_runs(spark, sf_dir), "score", "code"))


@query(f"""WITH {RUNS_SQL}, e AS (SELECT seed, max(score) FILTER (code = 'purchase') - max(score) FILTER (code = 'view') AS effect FROM runs WHERE code IN ('purchase', 'view') GROUP BY seed HAVING count(DISTINCT code) = 2),
  s AS (SELECT count(*) AS n, round(avg(effect), 6) AS mean_effect, round(coalesce(stddev_samp(effect), 0.0), 6) AS sd_effect, count(*) FILTER (effect > 0) AS n_positive FROM e)
  SELECT *, CASE WHEN n_positive = n THEN 'consistent_gain' WHEN n_positive = 0 THEN 'no_gain' ELSE 'mixed' END AS verdict FROM s""")
def paired_effects(spark, sf_dir):
    return rounded(experiments.summarise_effects(experiments.contrast(_runs(spark, sf_dir), "score", "seed", "code", {"purchase": 1, "view": -1})))


@query(f"WITH {RUNS_SQL} SELECT seed, round(max(score) FILTER (code = 'purchase') - max(score) FILTER (code = 'view') - max(score) FILTER (code = 'click') + max(score) FILTER (code = 'error'), 6) AS effect FROM runs WHERE code IN ('purchase', 'view', 'click', 'error') GROUP BY seed HAVING count(DISTINCT code) = 4")
def interaction_2x2(spark, sf_dir):
    return rounded(experiments.contrast(_runs(spark, sf_dir), "score", "seed", "code", {"purchase": 1, "view": -1, "click": -1, "error": 1}))


_PATIENTS = """ev AS (SELECT event_type AS code, event_id % 2 AS seed, user_id AS patient, value FROM events WHERE event_type IN ('purchase', 'view')), ps AS (SELECT code, seed, patient, avg(value) AS v FROM ev GROUP BY 1, 2, 3),
  pd AS (SELECT patient, avg(v) FILTER (code = 'purchase') - avg(v) FILTER (code = 'view') AS difference FROM ps GROUP BY patient HAVING count(*) = 4)"""


def _differences(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("code"), (F.col("event_id") % 2).alias("seed"), F.col("user_id").alias("patient"), "value")
    return experiments.patient_differences(rows, "value", "purchase", "view")


@query(f"WITH {_PATIENTS} SELECT patient, round(difference, 6) AS difference FROM pd")
def patient_differences(spark, sf_dir):
    return rounded(_differences(spark, sf_dir))


@query()
def bootstrap_ci(spark, sf_dir):
    """10,000 resamples; DuckDB takes minutes for as many digests, so tests hold it against a loop."""
    return rounded(experiments.bootstrap_interval(rounded(_differences(spark, sf_dir)), "difference", "patient")).withColumn("n", F.col("n").cast("long"))


_CONTRASTS = {"gain": ("purchase", "view"), "loss": ("error", "view"), "clicks": ("click", "view"), "signups": ("signup", "view"), "errors": ("error", "click")}
_RESAMPLES = 200


@query(f"""WITH ev AS (SELECT event_type AS code, user_id AS patient, avg(value) AS v FROM events GROUP BY 1, 2), c(contrast, l, r) AS (VALUES {', '.join(f"('{k}', '{l}', '{r}')" for k, (l, r) in _CONTRASTS.items())}),
  d AS (SELECT contrast, a.patient, round(a.v - b.v, 6) AS d, row_number() OVER (PARTITION BY contrast ORDER BY a.patient) - 1 AS p, count(*) OVER (PARTITION BY contrast) AS n FROM c JOIN ev a ON a.code = l JOIN ev b ON b.code = r AND b.patient = a.patient),
  s AS (SELECT contrast, max(n) AS n, avg(d) AS mean FROM d GROUP BY contrast), i AS (SELECT i, unnest(range(1, (SELECT max(n) FROM s) + 1)) AS j FROM range({_RESAMPLES}) r(i)),
  h AS (SELECT i, j, CAST('0x' || substr(sha256('7|' || i || '|' || j), 1, 8) AS BIGINT) AS h FROM i), m AS (SELECT s.contrast, i, sum(d) / max(s.n) AS m FROM s JOIN h ON j <= s.n JOIN d ON d.contrast = s.contrast AND d.p = h % s.n GROUP BY 1, 2)
  SELECT contrast, n, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM s JOIN (SELECT contrast, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) USING (contrast)""")
def bootstrap_contrasts(spark, sf_dir):
    """Intervals of five contrasts in one pass."""
    means = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code"), F.col("user_id").alias("patient")).agg(F.avg("value").alias("v"))
    of = lambda code: means.where(F.col("code") == code).select("patient", "v")
    parts = [of(a).withColumnRenamed("v", "l").join(of(b).withColumnRenamed("v", "r"), "patient").select(F.lit(name).alias("contrast"), "patient", F.round(F.col("l") - F.col("r"), 6).alias("d")) for name, (a, b) in _CONTRASTS.items()]
    return rounded(experiments.bootstrap_intervals(reduce(DataFrame.unionByName, parts), "d", "patient", "contrast", resamples=_RESAMPLES, seed="7"))


_PERCENTILES = (0.025, 0.5, 0.9)


@query(f"WITH {RUNS_SQL} " + " UNION ALL ".join(f"SELECT code, CAST({q} AS DOUBLE) AS share, round(quantile_cont(value, {q}), 6) AS value FROM ev GROUP BY code" for q in _PERCENTILES))
def percentiles(spark, sf_dir):
    found = experiments.order_statistics(_events(spark, sf_dir), "value", list(_PERCENTILES), "code")
    return rounded(found, 6, "value")


@query(f"WITH {RUNS_SQL}, s AS (SELECT code, round(avg(score), 6) AS score FROM runs GROUP BY code), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, code) AS rank, round(score - first_value(score) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS delta FROM s) SELECT code, score, CAST(rank AS INTEGER) AS rank, delta FROM k")
def rank_models(spark, sf_dir):
    summary = rounded(_runs(spark, sf_dir).groupBy("code").agg(F.avg("score").alias("score")))
    return rounded(experiments.delta_to_first(experiments.rank_models(summary, "score", "code"), "score", "code"))


@query("""WITH e AS (SELECT event_type AS code, user_id % 3 AS seed, CAST(extract(hour FROM ts) AS INTEGER) AS epoch, avg(value) / 100 AS v FROM events GROUP BY 1, 2, 3)
  SELECT code, epoch, count(*) AS n, round(avg(v), 6) AS v_mean, round(coalesce(stddev_samp(v), 0.0), 6) AS v_sd, round(greatest(avg(v) - coalesce(stddev_samp(v), 0.0), 0.0), 6) AS low, round(least(avg(v) + coalesce(stddev_samp(v), 0.0), 1.0), 6) AS high
  FROM e GROUP BY 1, 2 HAVING count(*) = 3""")
def curve_bands(spark, sf_dir):
    hourly = _events(spark, sf_dir).groupBy("code", "seed", F.hour("ts").alias("epoch")).agg((F.avg("value") / 100).alias("v"))
    return rounded(experiments.curve_bands(hourly, "v", 3, "code", "epoch"))


@query("SELECT user_id AS patient FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def common_patients(spark, sf_dir):
    return experiments.common_patients(_events(spark, sf_dir), 5, "patient", "code")


@query("SELECT event_type AS code, 'n_unexpected' AS issue FROM (SELECT event_type, user_id % 3 AS s, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type HAVING bool_or(n <> 700) UNION ALL SELECT event_type, 'config_differs' FROM events GROUP BY event_type HAVING count(DISTINCT length(event_type) + user_id % 3) > 1")
def run_consistency(spark, sf_dir):
    return experiments.consistency(_runs(spark, sf_dir), F.length("code") + F.col("seed"), {"n": 700}, "code")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(sum(event_id % 5) AS BIGINT) AS tp, CAST(sum(event_id % 3) AS BIGINT) AS fp FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    batches = read(spark, sf_dir, "events").select("ts", "event_type", (F.col("event_id") % 5).alias("tp"), (F.col("event_id") % 3).alias("fp"))
    return history.running_counts(batches, "ts", "1 hour", "1 hour", ["event_type"], ["tp", "fp"])
