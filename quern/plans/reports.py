"""Losses on rasters, reports, run audits and small operators on keys, orders and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import columns
from quern.operators import audit, confusion, experiments, rasters
from quern.plans.metrics import SR_SQL, rounded, samples
from quern.plans.rasters import _EMB, embeddings
from quern.plans.registry import query, read
from quern.sources.charts import ALARM, HIT, MISS
from quern.sources import tables

_AROUND = "list_transform(range(9), lambda j: CASE WHEN i // 8 + j // 3 - 1 BETWEEN 0 AND 7 AND i % 8 + j % 3 - 1 BETWEEN 0 AND 7 THEN {c}[(i // 8 + j // 3 - 1) * 8 + i % 8 + j % 3 - 1 + 1] END)"


def _edge(c: str) -> str:
    around = _AROUND.format(c=c)
    return f"list_transform(range(64), lambda i: list_max({around}) - list_min({around}))"


def _dice(a: str, b: str) -> str:
    return f"(2 * list_dot_product({a}, {b}) + 1) / (list_sum({a}) + list_sum({b}) + 1)"


@query(f"""WITH {_EMB}, x AS (SELECT k, list_transform(c, lambda v: 0.05::DOUBLE + 0.9::DOUBLE * abs(v) / (1 + abs(v))) AS p, list_transform(c, lambda v: CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t FROM emb),
  y AS (SELECT p, t, {_edge('p')} AS bp, {_edge('t')} AS bt, list_sum(list_transform(range(1, 65), lambda i: (CASE WHEN t[i] = 1 THEN 0.75 ELSE 0.25 END) * power(1 - CASE WHEN t[i] = 1 THEN p[i] ELSE 1 - p[i] END, 2.0) * -(CASE WHEN t[i] = 1 THEN ln(p[i]) ELSE ln(1 - p[i]) END))) AS f FROM x),
  z AS (SELECT 1 - avg({_dice('p', 't')}) AS d, sum(f) / (count(*) * 64) AS f, 1 - avg({_dice('bp', 'bt')}) AS b FROM y)
  SELECT round(d, 6) AS dice_loss, round(f, 6) AS focal_loss, round(b, 6) AS boundary_loss, round(0.55 * d + 0.30 * f + 0.15 * b, 6) AS dice_focal_boundary_loss FROM z""")
def raster_losses(spark, sf_dir):
    p = F.transform("c", lambda v: F.lit(0.05) + F.lit(0.9) * F.abs(v) / (1 + F.abs(v)))
    rows = embeddings(spark, sf_dir).select("k", p.alias("p"), F.transform("c", lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("t"))
    return rounded(confusion.raster_losses(rows, "p", "t", 8))


@query(f"""WITH {SR_SQL}, g AS (SELECT *, CASE WHEN tp + fn > 0 THEN sample_id % 3 ELSE 3 END AS g FROM sr)
  SELECT g, count(*) AS num_samples, round(avg(iou), 6) AS macro_iou, round(avg(iou) FILTER (tp + fn > 0), 6) AS positive_macro_iou, count(*) FILTER (tp + fn > 0) = 0 AS no_positive, round(avg(CASE WHEN fp > 0 THEN 1.0 ELSE 0.0 END) FILTER (tp + fn = 0), 6) AS empty_false_positive_rate,
    round(avg((tp + fp) / 16.0) FILTER (tp + fn = 0), 6) AS empty_predicted_fraction, count(*) FILTER (tp + fn = 0) = 0 AS no_empty FROM g GROUP BY g""")
def metrics_or_nan(spark, sf_dir):
    """Groups without positive or without empty samples have NaN there, shown as a flag and null."""
    rows = confusion.sample_ratios(samples(spark, sf_dir)).withColumn("g", F.when(F.col("tp") + F.col("fn") > 0, F.col("sample_id") % 3).otherwise(3))
    found = rounded(confusion.metrics_or_nan(rows, 16, "g"))
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(
        "g", "num_samples", "macro_iou", number("positive_macro_iou"), F.isnan("positive_macro_iou").alias("no_positive"), number("empty_false_positive_rate"), number("empty_predicted_fraction"),
        F.isnan("empty_false_positive_rate").alias("no_empty"),
    )


_OVER = "CASE WHEN t OR p THEN CAST(floor(0.45::DOUBLE * v + (1 - 0.45::DOUBLE) * CASE WHEN p AND t THEN {hit} WHEN p THEN {alarm} ELSE {miss} END) AS INTEGER) ELSE v END"
_OVERLAID = ", ".join(f"{_OVER.format(hit=HIT[k], alarm=ALARM[k], miss=MISS[k])} AS {name}" for k, name in enumerate(("red", "green", "blue")))


@query(f"""WITH {_EMB}, x AS (SELECT k, unnest(range(64)) AS place, unnest(list_transform(c, lambda v: CAST(floor(abs(v) * 1000000) AS BIGINT) % 256)) AS v FROM emb), y AS (SELECT *, v >= 128 AS t, v % 2 = 0 AS p FROM x)
  SELECT k, place, {_OVERLAID} FROM y""")
def overlay_pixels(spark, sf_dir):
    cells = F.transform("c", lambda v: F.floor(F.abs(v) * 1000000) % 256)
    rows = embeddings(spark, sf_dir).select("k", F.posexplode(cells).alias("place", "v"))
    return rows.select("k", F.col("place").cast("long").alias("place"), F.inline(F.array(tables.overlay(F.col("v"), F.col("v") >= 128, F.col("v") % 2 == 0))))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def saved_predictions(spark, sf_dir):
    return tables.saved_predictions(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 100, "o_orderdate", "o_orderkey")


# ---- keys, orders, formats ------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey || '__slice_' || l_linenumber AS key, o_orderpriority, max(l_quantity) AS l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY 1, 2")
def composed_key(spark, sf_dir):
    """Audit rows of slices meet the manifest by a key made of patient and slice; none may be without a partner."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("patient"), "o_orderpriority")
    key = audit.slice_key(F.col("l_orderkey").cast("string"), F.col("l_linenumber"))
    audit_rows = lines.groupBy(key.alias("key")).agg(F.max("l_quantity").alias("l_quantity"))
    listed = lines.select(F.col("l_orderkey").cast("string").alias("patient"), "l_linenumber").distinct().join(orders, "patient").select(audit.slice_key(F.col("patient"), F.col("l_linenumber")).alias("key"), "o_orderpriority")
    return audit.matched(listed, audit_rows, "key")


@query("""WITH c AS (SELECT event_type AS code, avg(value) AS score FROM events WHERE user_id % 2 = 0 GROUP BY 1), o AS (SELECT event_type AS code, avg(value) AS score FROM events WHERE event_type <> 'view' GROUP BY 1)
  SELECT c.code, round(c.score, 6) AS score, round(o.score, 6) AS old_score, round(c.score - o.score, 6) AS score_change FROM c LEFT JOIN o ON o.code = c.code""")
def cohort_comparison(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumnRenamed("event_type", "code")
    score = lambda rows: rows.groupBy("code").agg(F.avg("value").alias("score"))
    return rounded(audit.with_cohort(score(events.where("user_id % 2 = 0")), score(events.where("code <> 'view'")), "code", "score"))


@query("""SELECT 'a' || c_custkey AS candidate_id, CASE c_nationkey % 3 WHEN 0 THEN 'glioma' WHEN 1 THEN 'meningioma' ELSE 'pituitary' END AS tumor_type, 'customers' AS source FROM customer
  UNION ALL SELECT 'b' || s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'glioma' WHEN 1 THEN 'meningioma' ELSE 'pituitary' END, 'suppliers' FROM supplier""")
def unified_candidates(spark, sf_dir):
    code = lambda c: F.element_at(F.array(F.lit("gl"), F.lit("me"), F.lit("pi")), (F.col(c) % 3 + 1).cast("int"))
    first, second = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    return audit.unified(
        [
            (first, {"candidate_id": F.concat(F.lit("a"), F.col("c_custkey").cast("string")), "tumor_type": code("c_nationkey"), "source": F.lit("customers")}),
            (second, {"candidate_id": F.concat(F.lit("b"), F.col("s_suppkey").cast("string")), "tumor_type": code("s_nationkey"), "source": F.lit("suppliers")}),
        ],
        {"gl": "glioma", "me": "meningioma", "pi": "pituitary"}, "tumor_type",
    )


@query("WITH n AS (SELECT doc_id, source, CASE WHEN doc_id % 50 = 0 THEN 'x' || doc_id ELSE CAST(doc_id * 7 AS VARCHAR) END AS name FROM documents) SELECT doc_id, name, CAST(row_number() OVER (PARTITION BY source ORDER BY TRY_CAST(name AS BIGINT) NULLS LAST, name) AS INTEGER) AS position FROM n")
def numeric_text_order(spark, sf_dir):
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise((F.col("doc_id") * 7).cast("string"))
    return audit.numeric_order(read(spark, sf_dir, "documents").select("doc_id", "source", name.alias("name")), "source", "name").select("doc_id", "name", "position")


@query("WITH s AS (SELECT user_id % 7 AS seed, min(event_id) AS first FROM events GROUP BY 1) SELECT seed, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS position FROM s")
def seeds_in_order(spark, sf_dir):
    return experiments.seeds_in_order(read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("seed"), "event_id"), "seed", "event_id")


@query("SELECT event_type AS code, user_id % 3 AS seed, round(avg(value) FILTER (event_id % 2 = 0), 6) AS train, round(avg(value) FILTER (event_id % 2 = 1), 6) AS val, round(avg(value) FILTER (event_id % 2 = 0) - avg(value) FILTER (event_id % 2 = 1), 6) AS gap FROM events GROUP BY 1, 2")
def fit_gap(spark, sf_dir):
    half = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    runs = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code"), (F.col("user_id") % 3).alias("seed")).agg(half(0).alias("train"), half(1).alias("val"))
    return rounded(experiments.fit_gap(runs, "train", "val"))


@query("""SELECT event_type AS code, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS started, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS elapsed, printf('%.4f', round(avg(value), 7)) AS mean, printf('%+.4f', round(avg(value), 7) - 50) AS delta, printf('%.2f%%', 100 * round(avg(value) / 200, 7)) AS share FROM events GROUP BY 1""")
def formatted_values(spark, sf_dir):
    runs = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.round(F.avg("value"), 7).alias("m"), F.round(F.avg("value") / 200, 7).alias("s"))
    return runs.select(
        "code", columns.utc_stamp(F.col("a")).alias("started"), F.round(columns.elapsed_seconds(F.col("a"), F.col("b")), 3).alias("elapsed"), columns.fixed_digits(F.col("m")).alias("mean"),
        columns.fixed_digits(F.col("m") - 50, signed=True).alias("delta"), columns.percent(F.col("s")).alias("share"),
    )


@query("""WITH s AS (SELECT event_type AS code, count(*) AS n, CASE WHEN event_type <> 'view' THEN round(avg(value), 7) END AS m, row_number() OVER (ORDER BY event_type) AS p FROM events GROUP BY 1)
  SELECT CAST(p + 4 AS INTEGER) AS place, '| ' || code || ' | ' || n || ' | ' || CASE WHEN m IS NULL THEN '-' ELSE printf('%.4f', m) END || ' |' AS line FROM s
  UNION ALL SELECT * FROM (VALUES (1, '# Runs'), (2, ''), (3, '| Model | Samples | Score |'), (4, '| --- | --- | ---: |')) v(place, line)""")
def report_table(spark, sf_dir):
    summary = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 7).alias("m")).withColumn("m", F.when(F.col("code") != "view", F.col("m")))
    return experiments.report_lines(summary, "Runs", {"code": "Model", "n": "Samples", "m": "Score"}, ("m",), "code")


# ---- runs -----------------------------------------------------------------------------------------------------------------

_RUNS = """r AS (SELECT event_type AS code, CAST(user_id % 4 AS INTEGER) AS seed, count(*) AS n, CAST(max(event_id) % 30 AS INTEGER) AS best FROM events GROUP BY 1, 2)"""


def _audited(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code"), (F.col("user_id") % 4).cast("int").alias("seed")).agg(F.count("*").alias("n"), (F.max("event_id") % 30).cast("int").alias("best_epoch"))
    return rows.select(
        "code", "seed", F.when(F.col("seed") == 1, F.array(F.lit("config.json"))).otherwise(F.array(F.lit("config.json"), F.lit("summary.json"))).alias("files"), F.when((F.col("code") == "click") & (F.col("seed") == 0), "b").otherwise("a").alias("config"),
        F.when(F.col("n") % 2 == 0, 0.5).otherwise(0.4).alias("threshold"), "best_epoch", F.when(F.col("n") % 3 == 0, F.col("best_epoch")).otherwise(F.col("best_epoch") + 1).alias("checkpoint_epoch"), F.when(F.col("n") % 5 == 0, 525).otherwise(500).alias("train_samples"),
        F.when(F.col("n") % 7 == 0, "rgb").otherwise("gray").alias("channels"),
    )


@query(f"""WITH {_RUNS}, x AS (SELECT code, seed FROM (SELECT DISTINCT event_type AS code FROM events) a, (VALUES (1), (2), (3), (4)) s(seed)),
  i AS (SELECT code, seed, 'missing_file:summary.json' AS issue FROM r WHERE seed = 1 UNION ALL SELECT code, seed, 'threshold_unexpected' FROM r WHERE n % 2 <> 0 UNION ALL SELECT code, seed, 'checkpoint_not_best' FROM r WHERE n % 3 <> 0
    UNION ALL SELECT code, seed, 'train_samples_unexpected' FROM r WHERE n % 5 <> 0 UNION ALL SELECT code, seed, 'config_differs' FROM r WHERE code = 'click' UNION ALL SELECT r.code, r.seed, 'matrix_differs:channels' FROM r JOIN x ON x.code = r.code AND x.seed = r.seed WHERE n % 7 <> 0
    UNION ALL SELECT code, 4, 'missing_run' FROM (SELECT DISTINCT code FROM r) UNION ALL SELECT code, 0, 'unexpected_run' FROM r WHERE seed = 0) SELECT * FROM i""")
def run_audit(spark, sf_dir):
    """Seeds 0 to 3 were run, 1 to 4 expected, all with three channels."""
    runs = _audited(spark, sf_dir)
    expected = runs.select("code").distinct().select("code", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])).alias("seed")).withColumn("channels", F.lit("rgb"))
    return experiments.run_issues(runs, expected, "channels", counts={"train_samples": 525}, files=("config.json", "summary.json"))


@query("""WITH r AS (SELECT p_partkey AS run, CASE WHEN p_size % 5 > 0 THEN p_size END AS history, CASE WHEN p_size % 7 > 0 THEN p_size - p_partkey % 3 + 1 END AS checkpoint, CASE WHEN p_size % 3 > 0 THEN p_size END AS metrics FROM part)
  SELECT run, CASE WHEN history IS NULL AND checkpoint IS NULL AND metrics IS NULL THEN 'missing' WHEN history IS NULL OR checkpoint IS NULL OR checkpoint > history THEN 'inconsistent' WHEN metrics > 0 AND (metrics = history OR history >= 40) THEN 'complete' ELSE 'resume' END AS state FROM r""")
def run_states(spark, sf_dir):
    size = F.col("p_size")
    runs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), F.when(size % 5 > 0, size).alias("history"), F.when(size % 7 > 0, size - F.col("p_partkey") % 3 + 1).alias("checkpoint"), F.when(size % 3 > 0, size).alias("metrics"))
    return experiments.run_states(runs, 40).select("run", "state")


@query("""WITH r AS (SELECT p_partkey AS run, p_size % 2 = 1 AS prepare, p_size % 3 = 1 AS smoke_test, p_size % 4 = 1 AS train, p_size % 5 = 1 AS test, p_size % 6 = 1 AS report FROM part),
  f AS (SELECT run, list_position([prepare, smoke_test, train, test, report], FALSE) AS first, list_max(list_transform(range(1, 6), lambda i: CASE WHEN [prepare, smoke_test, train, test, report][i] THEN i ELSE 0 END)) AS ahead FROM r)
  SELECT run, CASE WHEN first IS NULL OR first = 0 THEN NULL WHEN ahead > first THEN 'out_of_order' ELSE ['prepare', 'smoke_test', 'train', 'test', 'report'][first] END AS next_stage FROM f""")
def baseline_stages(spark, sf_dir):
    names = ("prepare", "smoke_test", "train", "test", "report")
    runs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), *[(F.col("p_size") % (k + 2) == 1).alias(n) for k, n in enumerate(names)])
    return experiments.baseline_plan(runs, names).select("run", "next_stage")


_STATS = f"""{_EMB}, s AS (SELECT k, CASE WHEN k % 10 = 0 THEN 256 ELSE 512 END AS w, CASE WHEN k % 15 = 0 THEN 24 ELSE 8 END AS bpp, len(list_distinct(c)) AS dv, sqrt(greatest(list_dot_product(c, c) / 64 - (list_sum(c) / 64) * (list_sum(c) / 64), 0)) * 40 AS sd, len(list_filter(c, lambda v: v > 0.2)) AS fg FROM emb)"""


@query(f"""WITH {_STATS} SELECT * FROM (SELECT 'critical' AS severity, 'content_hash_mismatch' AS code, count(*) FILTER (k % 9 = 0) AS count, 'File bytes differ from the manifest.' AS detail FROM s UNION ALL SELECT 'high', 'bad_dimensions', count(*) FILTER (w <> 512), 'Image or mask is not 512x512.' FROM s
  UNION ALL SELECT 'medium', 'unexpected_bit_depth', count(*) FILTER (bpp <> 8), 'Image or mask is not decoded as 8-bit.' FROM s UNION ALL SELECT 'high', 'invalid_masks', count(*) FILTER (k % 8 = 0 OR fg = 0 OR fg = 262144), 'Mask is non-binary, empty or full.' FROM s
  UNION ALL SELECT 'medium', 'low_information_images', count(*) FILTER (dv < 16 OR sd < 5), 'Image has under 16 values or a standard deviation below 5.' FROM s) WHERE count > 0""")
def segmentation_issues(spark, sf_dir):
    stats = rasters.statistics(embeddings(spark, sf_dir).drop("label"), "c", 8, 0.2)
    size = F.when(F.col("k") % 10 == 0, 256).otherwise(512)
    rows = stats.select(
        "k", *[size.alias(c) for c in ("image_width", "image_height", "mask_width", "mask_height")], *[F.when(F.col("k") % 15 == 0, 24).otherwise(8).alias(c) for c in ("image_bpp", "mask_bpp")], (F.col("k") % 8 != 0).alias("mask_binary"),
        F.col("foreground").alias("foreground_pixels"), F.col("distinct_values").alias("image_distinct_values"), (F.col("sd") * 40).alias("image_stddev"), F.when(F.col("k") % 9 == 0, "x").otherwise("y").alias("actual_image_sha256"), F.lit("y").alias("image_sha256"),
        F.lit("m").alias("actual_mask_sha256"), F.lit("m").alias("mask_sha256"),
    )
    return audit.rule_issues(rows, audit.SEGMENTATION_RULES)


@query(f"""WITH {_STATS} SELECT * FROM (SELECT 'high' AS severity, 'bad_dimensions' AS code, count(*) FILTER (w = 256) AS count, 'Image or mask is not 256x256.' AS detail FROM s UNION ALL SELECT 'high', 'invalid_masks', count(*) FILTER (k % 8 = 0), 'Mask is non-binary.' FROM s
  UNION ALL SELECT 'info', 'empty_masks', count(*) FILTER (fg = 0), 'Mask is empty.' FROM s UNION ALL SELECT 'medium', 'full_masks', count(*) FILTER (fg * 1024 = 65536), 'Mask is full.' FROM s UNION ALL SELECT 'medium', 'low_information_images', count(*) FILTER (k % 6 < 2), 'All channels have a standard deviation below 3.' FROM s) WHERE count > 0""")
def slice_issues(spark, sf_dir):
    stats = rasters.statistics(embeddings(spark, sf_dir).drop("label"), "c", 8, 0.2)
    size = F.when(F.col("k") % 10 == 0, 512).otherwise(256)
    rows = stats.select(
        "k", *[size.alias(c) for c in ("image_width", "image_height", "mask_width", "mask_height")], (F.col("k") % 8 != 0).alias("mask_binary"), (F.col("foreground") * 1024).alias("foreground_pixels"),
        *[F.when(F.col("k") % 6 < 2, 2.5).otherwise(8.0).alias(f"{c}_sd") for c in ("red", "green", "blue")],
    )
    return audit.rule_issues(rows, audit.SLICE_RULES)


@query("""WITH w AS (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS w, sum(CAST(p_size AS BIGINT)) OVER (ORDER BY p_partkey) AS e FROM part), t AS (SELECT max(e) AS t FROM w),
  d AS (SELECT CAST('0x' || substr(sha256('42|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * t AS x FROM (SELECT unnest(range(0, 3000)) AS i), t)
  SELECT k AS p_partkey, count(x) AS draws FROM w LEFT JOIN d ON x >= e - w AND x < e GROUP BY k""")
def draw_with_replacement(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("w"))
    return confusion.draw_with_replacement(parts, "w", 3000, "42", "p_partkey").select("p_partkey", "draws")
