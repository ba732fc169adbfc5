"""Files written from the tables and read again: manifests, logs, runs, images and exports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quern.operators import audit, confusion
from quern.operators.kernels import kernel
from quern.plans.metrics import SR_SQL, rounded, samples
from quern.plans.registry import query, read
from quern.sources import charts, config, files, tables
from quern.sources.png import with_png
from quern.sources.rowfiles import write_files
from quern.storage import new_path

_MANIFEST = """m AS (SELECT 'd' || doc_id AS sample_id, CAST(doc_id AS INTEGER) AS source_id, source AS tumor_type, substr(sha256(text), 1, 12) AS group_id,
  CASE WHEN substr(sha256(text), 1, 1) <= '9' THEN 'train' WHEN substr(sha256(text), 1, 1) <= 'c' THEN 'val' ELSE 'test' END AS split, 'i/' || doc_id || '.png' AS image_path, 'm/' || doc_id || '.png' AS mask_path,
  sha256(text) AS image_sha256, sha256('mask' || doc_id) AS mask_sha256 FROM documents)"""


def manifest(spark, sf_dir):
    """A sample for each document; documents of equal text are a group, and a group's digest chooses its split."""
    h, doc = F.sha2("text", 256), F.col("doc_id").cast("string")
    split = F.when(F.substring("h", 1, 1) <= "9", "train").when(F.substring("h", 1, 1) <= "c", "val").otherwise("test")
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", h.alias("h"))
    return rows.select(
        F.concat(F.lit("d"), doc).alias("sample_id"), F.col("doc_id").cast("int").alias("source_id"), F.col("source").alias("tumor_type"), F.substring("h", 1, 12).alias("group_id"), split.alias("split"),
        F.concat(F.lit("i/"), doc, F.lit(".png")).alias("image_path"), F.concat(F.lit("m/"), doc, F.lit(".png")).alias("mask_path"), F.col("h").alias("image_sha256"), F.sha2(F.concat(F.lit("mask"), doc), 256).alias("mask_sha256"),
    )


@query(f"WITH {_MANIFEST} SELECT * FROM m")
def manifest_round_trip(spark, sf_dir):
    path = new_path(spark, "manifest")
    tables.write_manifest(manifest(spark, sf_dir), path)
    return tables.read_manifest(spark, path)


_LINE = "sample_id || ',' || source_id || ',' || tumor_type || ',' || group_id || ',' || split || ',' || image_path || ',' || mask_path || ',' || image_sha256 || ',' || mask_sha256"


@query(f"""WITH {_MANIFEST}, l AS (SELECT {_LINE} AS line, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, tumor_type, source_id, sample_id) AS n FROM m)
  SELECT sha256('sample_id,source_id,tumor_type,group_id,split,image_path,mask_path,image_sha256,mask_sha256' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10)) AS file_sha256 FROM l""")
def manifest_file_digest(spark, sf_dir):
    """The digest depends on every row and on their order in the file."""
    return spark.createDataFrame([(tables.write_manifest(manifest(spark, sf_dir), new_path(spark, "manifest")),)], "file_sha256 string")


@query(f"WITH {_MANIFEST} SELECT sample_id, tumor_type, 'g' || (source_id % 17) AS group_id FROM m")
def group_map_round_trip(spark, sf_dir):
    """Ids in the file have blanks around them and a further column beside them."""
    rows, path = manifest(spark, sf_dir), new_path(spark, "groups")
    mapped = rows.select(F.concat(F.lit(" "), "sample_id", F.lit("  ")).alias("sample_id"), F.concat(F.lit("g"), (F.col("source_id") % 17).cast("string"), F.lit(" ")).alias("group_id"), F.lit("x").alias("note"))
    mapped.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.apply_group_map(rows.select("sample_id", "tumor_type", "group_id"), tables.read_group_map(spark, path)).select("sample_id", "tumor_type", "group_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_strings(spark, sf_dir):
    path = new_path(spark, "csv")
    tables.write_rows(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return tables.read_csv(spark, path)


@query("""SELECT '"' || c_custkey || '","' || c_mktsegment || '"' AS line FROM customer UNION ALL SELECT '"c_custkey","c_mktsegment"'""")
def quoted_csv(spark, sf_dir):
    """The lines of the one file."""
    path = new_path(spark, "quoted")
    tables.write_quoted(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").coalesce(1), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT 'no_metadata' AS kind, c_name AS patient FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 = 0 UNION ALL SELECT 'no_folder', c_name FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 13 <> 0""")
def metadata_differences(spark, sf_dir):
    """Folders, named with a date, against the patients of a metadata file."""
    customers, path = read(spark, sf_dir, "customer"), new_path(spark, "metadata")
    tables.write_rows(customers.where("c_custkey % 13 <> 0").select(F.col("c_name").alias("Patient")), path)
    metadata = tables.read_csv(spark, path).select(F.col("Patient").alias("patient"))
    folders = customers.where("c_custkey % 11 <> 0").select(audit.without_date(F.concat("c_name", F.lit("_19930404"))).alias("patient"))
    return audit.missing_in(folders, metadata, ["patient"]).select(F.lit("no_metadata").alias("kind"), "patient").unionByName(audit.missing_in(metadata, folders, ["patient"]).select(F.lit("no_folder").alias("kind"), "patient"))


@query("SELECT page_id, upper(url) AS path FROM pages WHERE page_id % 3 = 0 AND lower(url) NOT IN (SELECT lower(url) FROM pages WHERE page_id % 3 <> 0)")
def unreferenced_files(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    found = pages.where("page_id % 3 = 0").select("page_id", F.upper("url").alias("path"))
    return audit.unreferenced(found, pages.where("page_id % 3 <> 0").select(F.col("url").alias("path")), "path")


_EPOCHS = """e AS (SELECT CAST(event_id % 50 AS INTEGER) AS epoch, value, event_id FROM events), h AS (SELECT epoch, arg_max(value, event_id) AS v, max(event_id) AS last FROM e GROUP BY epoch)"""


def _history(spark, sf_dir):
    """Lines of epoch records in the order of event_id, with blank lines between, in files one after the other; epochs repeat, as in resumed runs."""
    path = new_path(spark, "history")
    line = F.to_json(F.struct((F.col("event_id") % 50).cast("int").alias("epoch"), F.struct(F.col("value").alias("loss"), (F.col("value") / 2).alias("macro_iou")).alias("train"), F.struct((F.col("value") * 2).alias("loss")).alias("val"), (F.col("value") / 4).alias("best_val_metric")))
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, F.concat(line, F.lit("\n"))).otherwise(line).alias("value"))
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return path


@query(f"WITH {_EPOCHS} SELECT epoch, round(v, 6) AS train_loss, round(v / 2, 6) AS train_macro_iou, round(v * 2, 6) AS val_loss, round(v / 4, 6) AS best_val_metric FROM h")
def history_last_wins(spark, sf_dir):
    flat = tables.flatten_epochs(tables.read_history(spark, _history(spark, sf_dir), parts=True))
    return rounded(flat.select("epoch", "train_loss", "train_macro_iou", "val_loss", "best_val_metric"))


@query(f"""WITH {_EPOCHS} SELECT 'loss' AS curve, 'train_loss' AS series, epoch, round(v, 6) AS value FROM h UNION ALL SELECT 'loss', 'val_loss', epoch, round(v * 2, 6) FROM h
  UNION ALL SELECT 'iou', 'train_macro_iou', epoch, round(v / 2, 6) FROM h UNION ALL SELECT 'model_selection', 'best_val_metric', epoch, round(v / 4, 6) FROM h""")
def curve_series(spark, sf_dir):
    return rounded(tables.curve_series(tables.flatten_epochs(tables.read_history(spark, _history(spark, sf_dir), parts=True))))


_X, _Y = "20 + CAST(floor(CASE WHEN x1 > x0 THEN (x - x0) / (x1 - x0) ELSE 0.5 END * 599 + 0.5::DOUBLE) AS INTEGER)", "20 + CAST(floor(CASE WHEN y1 > y0 THEN (y1 - y) / (y1 - y0) ELSE 0.5 END * 359 + 0.5::DOUBLE) AS INTEGER)"


@query(f"""WITH {_EPOCHS}, p AS (SELECT 'loss' AS chart, 'train_loss' AS series, CAST(epoch AS DOUBLE) AS x, v AS y FROM h UNION ALL SELECT 'loss', 'val_loss', epoch, v * 2 FROM h UNION ALL SELECT 'iou', 'train_macro_iou', epoch, v / 2 FROM h UNION ALL SELECT 'model_selection', 'best_val_metric', epoch, v / 4 FROM h),
  r AS (SELECT chart, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY chart) SELECT chart, series, {_X} AS px, {_Y} AS py, true AS drawn FROM p JOIN r USING (chart)""")
def curve_charts(spark, sf_dir):
    """The curves of a history as files, decoded again: whether there is colour where each point lies."""
    series = tables.curve_series(tables.flatten_epochs(tables.read_history(spark, _history(spark, sf_dir), parts=True)))
    points = series.select(F.col("curve").alias("chart"), "series", F.col("epoch").alias("x"), F.col("value").alias("y"))
    root = new_path(spark, "charts")
    write_files(charts.line_charts(points), root)
    drawn = files.with_cells(files.read_images(spark, root)).select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("chart"), "width", "cells")
    at = lambda k: F.get("cells", (F.col("py") * F.col("width") + F.col("px")) * 3 + k)
    colour = F.greatest(at(0), at(1), at(2)) != F.least(at(0), at(1), at(2))
    return charts.pixel_points(points).join(drawn, "chart").select("chart", "series", "px", "py", colour.alias("drawn"))


_RATIOS = ("iou", "dice", "precision", "recall")


@query(f"""WITH {SR_SQL}, v AS (SELECT unnest([{', '.join(f"'{r}'" for r in _RATIOS)}]) AS chart, unnest([{', '.join(_RATIOS)}]) AS v FROM sr), b AS (SELECT chart, CAST(least(floor(v * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY chart) AS most FROM b)
  SELECT chart, CAST(sum(((2 * n * 359 + most) // (2 * most)) * ((bin + 1) * 600 // 20 - bin * 600 // 20 - 1)) AS BIGINT) AS coloured FROM m GROUP BY chart""")
def histogram_charts(spark, sf_dir):
    """Four histograms as files, decoded again: the pixels that their bars fill."""
    ratios = confusion.sample_ratios(samples(spark, sf_dir))
    values = ratios.select(F.inline(F.array(*[F.struct(F.lit(r).alias("chart"), F.col(r).alias("v")) for r in _RATIOS])))
    bars = values.where(F.col("v").between(0, 1)).groupBy("chart", F.least(F.floor(F.col("v") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    root = new_path(spark, "charts")
    write_files(charts.bar_charts(bars, 20), root)
    drawn = files.with_cells(files.read_images(spark, root))
    coloured = kernel(lambda m: (m.reshape(len(m), -1, 3).max(2) != m.reshape(len(m), -1, 3).min(2)).sum(1), "bigint", None, "cells")
    return drawn.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("chart"), coloured.alias("coloured"))


@query("SELECT event_id, event_type, round(value, 6) AS value FROM events")
def jsonl_append(spark, sf_dir):
    """Two halves appended to one log."""
    events, path = read(spark, sf_dir, "events").select("event_id", "event_type", "value"), new_path(spark, "log")
    tables.append_jsonl(events.where("event_id % 2 = 0"), path)
    tables.append_jsonl(events.where("event_id % 2 = 1"), path)
    return rounded(tables.read_jsonl(spark, path, "event_id long, event_type string, value double"))


@query("SELECT 'train' AS split, count(*) FILTER (doc_id % 3 = 0) AS n FROM documents UNION ALL SELECT 'val', count(*) FILTER (doc_id % 3 = 1) FROM documents UNION ALL SELECT 'test', count(*) FILTER (doc_id % 3 = 2) FROM documents")
def json_document(spark, sf_dir):
    """Counts by split, written as one document with sorted keys and read again; a second write is refused."""
    counts = {r["s"]: r["n"] for r in read(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 3).alias("s")).agg(F.count("*").alias("n")).collect()}
    path = f"{new_path(spark, 'meta')}/meta.json"
    tables.write_json(spark, {"counts": {name: counts.get(k, 0) for k, name in enumerate(("train", "val", "test"))}, "seed": 42}, path)
    try:
        tables.write_json(spark, {}, path)
        raise AssertionError("an existing file was overwritten")
    except Exception as error:  # noqa: BLE001 - the file system's own error
        if isinstance(error, AssertionError):
            raise
    read_back = tables.read_json(spark, path, "counts struct<train: long, val: long, test: long>, seed long")
    return read_back.select(F.inline(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"counts.{s}").alias("n")) for s in ("train", "val", "test")])))


@query("""WITH r AS (SELECT event_type AS code, user_id % 3 AS seed, count(*) AS n, round(avg(value), 6) AS score FROM events GROUP BY 1, 2), x AS (SELECT code, seed FROM (SELECT DISTINCT event_type AS code FROM events) a, (VALUES (0), (1), (2), (3)) s(seed))
  SELECT x.code, CAST(x.seed AS INTEGER) AS seed, n, score FROM x LEFT JOIN r ON r.code = x.code AND r.seed = x.seed""")
def runs_scan(spark, sf_dir):
    """One document for each run, by experiment and seed; a seed that was never run is a row of nulls."""
    events, root = read(spark, sf_dir, "events"), new_path(spark, "runs")
    runs = events.groupBy(F.col("event_type").alias("code"), (F.col("user_id") % 3).alias("seed")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("score"))
    runs.coalesce(1).write.partitionBy("code", "seed").json(root)
    expected = events.select(F.col("event_type").alias("code")).distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3))))
    found = tables.scalars(tables.read_runs(spark, root, "*.json", "code string, seed int, n long, score double"))
    return tables.with_expected(found, expected, ["code", "seed"]).select("code", "seed", "n", "score")


# ---- images: the suppliers are samples, their regions classes -------------------------------------------------------------

_IMAGES = """n AS (SELECT s_suppkey AS k, r_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  px AS (SELECT k, c, list_transform(range(12), lambda i: (k * 7 + i * 11) % 256) AS red, list_transform(range(12), lambda i: (k * 5 + i * 3) % 256) AS green, list_transform(range(12), lambda i: (k + i) % 256) AS blue,
    list_transform(range(12), lambda i: CASE WHEN (i + k) % 3 = 0 THEN 255 WHEN k % 4 = 0 THEN 3 WHEN k % 10 = 1 THEN 9 ELSE 0 END) AS mask FROM n)"""


BROKEN = 999_999


def _folder(spark, sf_dir):
    """A folder of 4 x 3 images and masks for the suppliers; two masks are missing and a file has no image in it."""
    root = new_path(spark, "images")
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = read(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), F.concat("r_name", F.lit("/enh_"), "s_suppkey").alias("stem"))
    k, cells = F.col("k"), F.sequence(F.lit(0), F.lit(11))
    colours = F.flatten(F.transform(cells, lambda i: F.array((k * 7 + i * 11) % 256, (k * 5 + i * 3) % 256, (k + i) % 256))).cast("array<int>")
    mask = F.transform(cells, lambda i: F.when((i + k) % 3 == 0, 255).when(k % 4 == 0, 3).when(k % 10 == 1, 9).otherwise(0)).cast("array<int>")
    images = with_png(rows.select(F.concat("stem", F.lit(".png")).alias("path"), colours.alias("cells")), "cells", 4, 3, 3, "content")
    masks = with_png(rows.where(~k.isin(3, 8)).select(F.concat("stem", F.lit("_mask.png")).alias("path"), mask.alias("cells")), "cells", 4, 3, name="content")
    broken = spark.createDataFrame([(f"EUROPE/enh_{BROKEN}.png", b"no image")], "path string, content binary")
    write_files(images.unionByName(masks).drop("cells").unionByName(broken), root)
    return root


@query(f"WITH {_IMAGES} SELECT c AS tumor_type, CAST(k AS INTEGER) AS source_id, CASE WHEN k IN (3, 8) THEN 'missing_mask' ELSE 'paired' END AS status FROM n UNION ALL SELECT 'EUROPE', 999999, 'missing_mask'")
def class_file_pairs(spark, sf_dir):
    found = files.parse_class_files(files.inventory(spark, _folder(spark, sf_dir), "*.png", content=False)).select("tumor_type", "source_id", "is_mask")
    return audit.pair_up(found.where("not is_mask").drop("is_mask"), found.where("is_mask").drop("is_mask"), ["tumor_type", "source_id"])


_TOTAL = ", ".join(f"CAST(list_sum({c}) AS BIGINT) AS {c}" for c in ("red", "green", "blue"))


@query(f"WITH {_IMAGES} SELECT CAST(k AS INTEGER) AS source_id, 4 AS width, 3 AS height, {_TOTAL}, CAST(list_sum(list_transform(range(1, 13), lambda i: (299 * red[i] + 587 * green[i] + 114 * blue[i] + 500) // 1000)) AS BIGINT) AS luma, list_sum(green) / 12 AS green_mean FROM px UNION ALL SELECT 999999, -1, -1, 0, 0, 0, 0, NULL")
def decoded_images(spark, sf_dir):
    """Sums of the channels and of the luma of decoded colour images; a file that can't be decoded has width -1."""
    from quern.operators import images, rasters

    rows = files.read_pngs(spark, _folder(spark, sf_dir)).where(~F.col("path").endswith("_mask.png"))
    cells = files.with_cells(rows)
    split = images.split_channels(F.col("cells"))
    rgb = cells.select(F.regexp_extract("path", r"enh_(\d+)", 1).cast("int").alias("source_id"), "width", "height", *[v.alias(n) for n, v in split.items()])
    luma = F.transform(F.arrays_zip("red", "green", "blue"), lambda p: rasters.luma(p["red"], p["green"], p["blue"]))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    mean = F.when(F.size("green") > 0, total("green") / F.size("green"))
    return rgb.select("source_id", "width", "height", total("red").alias("red"), total("green").alias("green"), total("blue").alias("blue"), total(luma).alias("luma"), mean.alias("green_mean"))


@query(f"""WITH {_IMAGES}, m AS (SELECT * FROM px WHERE k NOT IN (3, 8)) SELECT CAST(k AS INTEGER) AS source_id, CAST(len(list_filter(mask, lambda v: v >= 128)) AS INTEGER) AS target, CAST(len(list_filter(mask, lambda v: v > 0)) AS INTEGER) AS predicted,
  CASE WHEN len(list_filter(mask, lambda v: v NOT IN (0, 3, 255))) > 0 THEN 'unexpected_values' ELSE '' END AS problems FROM m""")
def decoded_masks(spark, sf_dir):
    """Foreground of targets (from 128) and of predictions (over 0), and the rules that a mask breaks."""
    rows = files.with_cells(files.read_pngs(spark, _folder(spark, sf_dir)).where(F.col("path").endswith("_mask.png")))
    count = lambda cells: F.aggregate(cells, F.lit(0), lambda s, v: s + v)
    return rows.select(
        F.regexp_extract("path", r"enh_(\d+)", 1).cast("int").alias("source_id"), count(files.foreground(F.col("cells"))).alias("target"), count(files.foreground(F.col("cells"), 1)).alias("predicted"),
        F.array_join(files.mask_problems(F.col("cells")), ",").alias("problems"),
    )


@query("SELECT CAST(s_suppkey AS INTEGER) AS source_id, CASE WHEN s_suppkey % 7 = 0 THEN 'missing_file' ELSE 'digest_differs' END AS problem FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 = 0")
def verified_files(spark, sf_dir):
    """A manifest whose rows name a file that isn't there (every seventh) or another digest (every fifth)."""
    found = files.parse_class_files(files.inventory(spark, _folder(spark, sf_dir), "*.png")).where(~F.col("is_mask") & (F.col("source_id") < BROKEN))
    named = found.select("source_id", F.when(F.col("source_id") % 7 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"), F.when(F.col("source_id") % 5 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return audit.verify_files(named, found).select("source_id", "problem")


@query("SELECT 'P' || (s_nationkey % 5) AS patient, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE CAST(s_suppkey AS INTEGER) END AS slice, s_suppkey % 2 = 1 AS is_mask FROM supplier")
def slice_files(spark, sf_dir):
    """Slice numbers from file names; 0 where the name has none."""
    root, k = new_path(spark, "slices"), F.col("s_suppkey")
    number = F.when(k % 6 == 0, "x").otherwise(k.cast("string"))
    name = F.concat(F.lit("P"), F.col("s_nationkey") % 5, F.lit("/s"), k, F.lit("_"), number, F.when(k % 2 == 1, "_mask").otherwise(""), F.lit(".tif"))
    write_files(read(spark, sf_dir, "supplier").select(name.alias("path"), F.lit(b"-").alias("content")), root)
    return files.parse_slice_files(files.inventory(spark, root, "*.tif", content=False)).select("patient", "slice", "is_mask")


@query(f"""WITH {_MANIFEST}, c AS (SELECT 'k3m_' || sample_id AS case_id, split FROM m WHERE split <> 'test'), f AS (SELECT split, list_sort(list(case_id)) AS cases FROM c GROUP BY split)
  SELECT 'fold_' || split AS part, sha256(array_to_string(cases, ',')) AS content FROM f UNION ALL SELECT 'numTraining', CAST(count(*) AS VARCHAR) FROM c UNION ALL SELECT 'channel_names', '{{"0": "pre", "1": "flair", "2": "post"}}'""")
def export_description(spark, sf_dir):
    rows = manifest(spark, sf_dir)
    folds = tables.folds(tables.case_map(rows)).select(F.concat(F.lit("fold_"), "split").alias("part"), F.sha2(F.array_join("cases", ","), 256).alias("content"))
    said = tables.dataset_description(rows, ["pre", "flair", "post"])
    return folds.unionByName(spark.createDataFrame([("numTraining", str(said["numTraining"])), ("channel_names", json.dumps(said["channel_names"]))], "part string, content string"))


_SUPPLIERS = """px AS (SELECT s_suppkey AS k, list_transform(range(16), lambda i: CASE WHEN i < 12 THEN (s_suppkey * 7 + i * 11) % 256 ELSE 0 END) AS red, list_transform(range(16), lambda i: CASE WHEN i < 12 THEN (s_suppkey * 5 + i * 3) % 256 ELSE 0 END) AS green,
  list_transform(range(16), lambda i: CASE WHEN i < 12 THEN (s_suppkey + i) % 256 ELSE 0 END) AS blue, list_transform(range(16), lambda i: CASE WHEN i < 12 AND (i + s_suppkey) % 3 = 0 THEN 255 ELSE 0 END) AS mask FROM supplier)"""


@query(f"""WITH {_SUPPLIERS}, s AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'Ts' ELSE 'Tr' END AS t FROM px) SELECT 'images' || t || '/k3m_n' || k || '_0000.png' AS path, CAST(list_sum(red) AS BIGINT) AS total FROM s
  UNION ALL SELECT 'images' || t || '/k3m_n' || k || '_0001.png', CAST(list_sum(green) AS BIGINT) FROM s UNION ALL SELECT 'images' || t || '/k3m_n' || k || '_0002.png', CAST(list_sum(blue) AS BIGINT) FROM s
  UNION ALL SELECT 'labels' || t || '/k3m_n' || k || '.png', CAST(len(list_filter(mask, lambda v: v >= 128)) AS BIGINT) FROM s""")
def exported_files(spark, sf_dir):
    """Channel and label files of a sample for each supplier, written by the tasks, decoded and summed again."""
    # A file of suppliers is small and one task reads it, but each makes four files: all tasks share them.
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k")).repartition(4 * spark.sparkContext.defaultParallelism, "k")
    of = lambda f: F.transform(F.sequence(F.lit(0), F.lit(15)), f)
    pad = lambda f: of(lambda i: F.when(i < 12, f(i)).otherwise(0).cast("int"))
    samples = suppliers.select(
        F.concat(F.lit("n"), "k").alias("sample_id"), F.when(F.col("k") % 5 == 0, "test").otherwise("train").alias("split"), pad(lambda i: (F.col("k") * 7 + i * 11) % 256).alias("red"),
        pad(lambda i: (F.col("k") * 5 + i * 3) % 256).alias("green"), pad(lambda i: (F.col("k") + i) % 256).alias("blue"), pad(lambda i: F.when((i + F.col("k")) % 3 == 0, 255).otherwise(0)).alias("mask"),
    )
    root = new_path(spark, "export")
    write_files(tables.exported_files(samples, 4).withColumnRenamed("png", "content"), root)
    rows = files.with_cells(files.read_pngs(spark, root))
    return rows.select(F.regexp_extract("path", r"((?:images|labels)T[rs]/[^/]+)$", 1).alias("path"), F.aggregate("cells", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS c FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100), p AS (SELECT k, substr(c, 1, 1) AS c, i, (k * 7 + i * 13) % 101 / 100.0 AS p FROM (SELECT *, unnest(range(16)) AS i FROM o))
  SELECT c || '/o_' || k || '_pred.png' AS path, 8 AS width, 4 AS height, CAST(2 * 255 * count(*) FILTER (p >= 0.5) AS BIGINT) AS total FROM p GROUP BY c, k""")
def prediction_files(spark, sf_dir):
    """Masks of the first 100 orders by date, at twice their width, written by the tasks and decoded again."""
    k = F.col("o_orderkey")
    cell = lambda i: ((k * 7 + i * 13) % 101) / 100
    samples = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("o/"), k).alias("sample_id"), F.substring("o_orderpriority", 1, 1).alias("tumor_type"), F.transform(F.sequence(F.lit(0), F.lit(15)), cell).alias("probability"), "o_orderdate", "o_orderkey"
    )
    root = new_path(spark, "predictions")
    write_files(tables.prediction_files(samples, (4, 4), (8, 4), "o_orderdate", "o_orderkey", most=100), root)
    rows = files.with_cells(files.read_images(spark, root, recursive=True))
    return rows.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "width", "height", F.aggregate("cells", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


_RAGGED = """r AS (SELECT event_id AS e, 0 AS place, 'event_id' AS key, CAST(event_id AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 1, 'a' || ((13 * event_id + 4) % 9), event_type FROM events UNION ALL SELECT event_id, 2, 'b' || (7 * event_id % 5), CAST(user_id AS VARCHAR) FROM events),
  h AS (SELECT key, row_number() OVER (ORDER BY min(e * 4 + place)) AS n FROM r GROUP BY key)"""


@query(f"""WITH {_RAGGED}, x AS (SELECT string_agg(key, ',' ORDER BY n) AS header FROM h) SELECT e AS event_id, header, string_agg(coalesce(r.value, ''), ',' ORDER BY n) AS line FROM (SELECT event_id AS e FROM events) CROSS JOIN h CROSS JOIN x LEFT JOIN r USING (e, key) GROUP BY e, header""")
def ragged_csv(spark, sf_dir):
    """Records with different keys; the header has all of them in the order of their first appearance."""
    e = F.col("event_id")
    fields = F.create_map(F.lit("event_id"), e.cast("string"), F.concat(F.lit("a"), (13 * e + 4) % 9), "event_type", F.concat(F.lit("b"), 7 * e % 5), F.col("user_id").cast("string"))
    path = new_path(spark, "ragged")
    header = tables.write_ragged(read(spark, sf_dir, "events").select("event_id", fields.alias("fields")), "fields", path, "event_id")
    rows = tables.read_csv(spark, path)
    return rows.select(F.col("event_id").cast("long").alias("event_id"), F.lit(",".join(header)).alias("header"), F.concat_ws(",", *[F.coalesce(F.col(h), F.lit("")) for h in rows.columns]).alias("line"))


# ---- configurations -------------------------------------------------------------------------------------------------------

_CHECKED = """c AS (SELECT p_partkey AS k, p_size * 8 AS width, p_size / 50.0 AS threshold, ['grayscale', 'flair_green', 'rgb_multimodal', 'green'][p_partkey % 4 + 1] AS mode, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 1 END AS channels, p_partkey % 7 = 0 AS short FROM part)"""


def _config_texts(spark, sf_dir):
    """A configuration for each part, as text: sizes, modes, channels and thresholds by its columns; every seventh lacks a section."""
    k, size = F.col("p_partkey"), F.col("p_size")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("grayscale", "flair_green", "rgb_multimodal", "green")]), (k % 4 + 1).cast("int"))
    parts = (
        '{"_path": "', k, '", "project": {"seed": ', k, ', "output_dir": "runs/', k, '"}, "data": {"split_ratios": {"train": 0.7, "val": 0.15, "test": 0.15}, "image_size": [', size * 8, ', 256], "channel_mode": "', mode,
        '"}, "model": {"in_channels": ', F.when(k % 5 == 0, 3).otherwise(1), ', "out_channels": 1}, ', F.when(k % 7 == 0, "").otherwise('"loss": {}, '), '"optimizer": {}, "scheduler": {}, "training": {}, "metrics": {"threshold": ', size / 50, '}, "evaluation": {}}',
    )
    # A file of parts is small and one task reads it, but parsing a text takes a fifth of a millisecond: all tasks share them.
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return rows.select(k.alias("k"), size.alias("size"), F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]).alias("value"))


@query(f"""WITH {_CHECKED}, p AS (SELECT k, unnest([CASE WHEN width % 16 <> 0 THEN 'data.image_size must be divisible by 16' END, CASE WHEN mode = 'green' THEN 'data.channel_mode must be one of grayscale, flair_green, rgb_multimodal' END,
    CASE WHEN mode = 'rgb_multimodal' AND channels <> 3 THEN 'model.in_channels must be 3' WHEN mode IN ('grayscale', 'flair_green') AND channels <> 1 THEN 'model.in_channels must be 1' END,
    CASE WHEN threshold >= 1 THEN 'metrics.threshold must lie between 0 and 1' END, CASE WHEN short THEN 'section loss is missing' END]) AS problem FROM c) SELECT k, problem FROM p WHERE problem IS NOT NULL""")
def config_problems(spark, sf_dir):
    """The rules that each of many configurations breaks, read from their texts."""
    return config.text_problems(_config_texts(spark, sf_dir), "k")


@query(f"WITH {_CHECKED} SELECT width, mode, channels, short, count(*) AS runs FROM c GROUP BY ALL")
def config_comparison(spark, sf_dir):
    """Runs with comparable configurations, which differ in seed, folder and internal keys only."""
    k = F.col("k")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("grayscale", "flair_green", "rgb_multimodal", "green")]), (k % 4 + 1).cast("int"))
    told = config.text_digests(_config_texts(spark, sf_dir), "k", "size")
    first = lambda c: F.min(c)
    rows = told.select("digest", (F.col("size") * 8).alias("width"), mode.alias("mode"), F.when(k % 5 == 0, 3).otherwise(1).alias("channels"), (k % 7 == 0).alias("short"))
    return rows.groupBy("digest").agg(*[first(c).alias(c) for c in ("width", "mode", "channels", "short")], F.count("*").alias("runs")).drop("digest")


@query("SELECT p_partkey AS k, 'project:' || chr(10) || '  name: p' || p_partkey || chr(10) || '  seed: ' || p_size || chr(10) || 'model:' || chr(10) || '  width: 7' AS value FROM part")
def seed_configs(spark, sf_dir):
    """Each part's configuration with its size for a seed."""
    text = F.concat(F.lit("project:\n  name: p"), "p_partkey", F.lit("\n  seed: 42\nmodel:\n  width: 7"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size", text.alias("value"))
    return config.seed_texts(rows, F.col("p_size")).select("k", "value")


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN substr(sha256(text), 1, 1) <= '9' THEN 'train' WHEN substr(sha256(text), 1, 1) <= 'c' THEN 'val' ELSE 'test' END AS split FROM documents) WHERE split IN ('train', 'val') GROUP BY split")
def development_samples(spark, sf_dir):
    rows = manifest(spark, sf_dir)
    return audit.transition_counts(rows.where(F.col("split").isin("train", "val")), "split").withColumnRenamed("count", "n")

