"""Files written by tasks, logs and epochs over streams, ragged records, kernels and augmentation against loops."""

import json
import math
import random
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.operators import images, kernels, rasters, selection
from quern.sources import files, png, rowfiles, tables
from quern.streaming import logs, stopping


def test_rows_become_files(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.range(300).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/f"), "id").alias("path"), F.encode(F.repeat(F.col("id").cast("string"), 3), "UTF-8").alias("content"))
    rowfiles.write_files(rows.repartition(5), root)
    found = {str(p.relative_to(root)): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found.pop("_SUCCESS") == b"" and found == {r.path: bytes(r.content) for r in rows.collect()}
    with pytest.raises(Exception, match="exists already"):
        rowfiles.write_files(rows.where("id = 3"), root)
    rowfiles.write_files(rows.where("id = 3").withColumn("content", F.lit(None).cast("binary")), root, overwrite=True)
    assert (tmp_path / "out/d3/f3").read_bytes() == b"" and not (tmp_path / "out/_temporary").exists()


@pytest.mark.parametrize("bad", ["../x", "/x", "_x", "a//b", "a/../../b", None])
def test_bad_names_and_failed_tasks_leave_nothing(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"ok{k}", b"1") for k in range(20)] + [(bad, b"2")], "path string, content binary").repartition(4)
    with pytest.raises(Exception, match="not a path|PythonException|failed"):
        rowfiles.write_files(rows, str(tmp_path / "out"))
    time.sleep(0.5)  # tasks that were running see that the job has ended
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_a_repeated_attempt_counts_once(tmp_path):
    writer = rowfiles.FileWriter(f"file://{tmp_path}/out", False)
    batch = pa.RecordBatch.from_pydict({"path": ["a", "b"], "content": [b"1", b"2"]})

    def dies():
        yield batch
        raise RuntimeError("the executor is lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    slow, fast = writer.write(iter([batch])), writer.write(iter([batch]))
    assert slow.attempt != fast.attempt
    writer.commit([fast, None])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["_SUCCESS", "a", "b"]
    other = rowfiles.FileWriter(str(tmp_path / "two"), False)
    with pytest.raises(FileExistsError):
        other.commit([other.write(iter([batch])), other.write(iter([batch]))])
    assert not (tmp_path / "two/_temporary").exists() and not (tmp_path / "two/_SUCCESS").exists()


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    out, name = str(tmp_path / "log"), "q"
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id int, loss double")
    write = logs.log_writer(out, name)
    write(rows, 0)
    write(rows.where("id = 2").withColumn("id", F.lit(3)), 1)
    write(rows.where("id = 2").withColumn("id", F.lit(3)), 1)
    logs.log_writer(out, "other")(rows, 0)
    (tmp_path / "log/query=q/batch=2").mkdir()
    (tmp_path / "log/query=q/batch=2/part-0.json").write_text('{"id": 9, "loss": 1.0}\n')
    assert sorted((r.query, r.batch, r.id) for r in logs.read_log(spark, out, "id int, loss double").collect()) == [("other", 0, 1), ("other", 0, 2), ("q", 0, 1), ("q", 0, 2), ("q", 1, 3)]
    assert logs.read_log(spark, str(tmp_path / "none"), "id int").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_epochs_in_any_batches_give_the_rows_of_the_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(run, e, rng.choice([None, float("nan"), 0.5, rng.random(), rng.random()]), rng.choice([None, 0.3, 0.4])) for run in range(6) for e in range(1, rng.randint(2, 14))]
    schema = "run long, epoch int, metric double, threshold double"
    frame = spark.createDataFrame(rows, schema)
    rng.shuffle(rows)
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with stopping.typed_state(spark):
            logs.stream_log(stopping.follow_runs(stream, "metric", "run", threshold="threshold", patience=3), f"{tmp_path}/out", "q", f"{tmp_path}/check").awaitTermination()
    plain = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x
    names = ["run", "epoch", "metric", "improved", "best", "best_epoch", "bad_epochs", "best_threshold"]
    want = selection.early_stop(frame, "metric", 3, "run")
    want = {tuple(map(plain, r)) for r in want.select(*names[:-1]).collect()}
    found = logs.read_log(spark, f"{tmp_path}/out", "run long, epoch int, metric double, improved boolean, best double, best_epoch int, bad_epochs int, best_threshold double, stopped boolean").collect()
    assert {tuple(plain(r[n]) for n in names[:-1]) for r in found} == want and len(found) == len(want)
    thresholds = {(r.run, r.epoch): r.best_threshold for r in selection.running_best(frame, "metric", "run", extra="threshold").collect()}
    assert all(r.best_threshold == thresholds[r.run, r.epoch] for r in found)


def test_ragged_records(spark, tmp_path):
    records = [(0, {"b": "1", "a": "x,y"}), (1, {"c": 'say "hi"', "b": None}), (2, {}), (3, {"a": "", "d": "4"})]
    # Python's dicts lose their order on the way to Spark, which keeps that of its own maps.
    frame = spark.createDataFrame([(n, list(d), list(d.values())) for n, d in records], "n int, k array<string>, v array<string>").select("n", F.map_from_arrays("k", "v").alias("fields")).repartition(3)
    path = str(tmp_path / "t")
    assert tables.write_ragged(frame, "fields", path, "n") == ["b", "a", "c", "d"]
    rows = [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(path).collect()]
    assert sorted(rows, key=repr) == sorted([("1", "x,y", None, None), (None, None, 'say "hi"', None), (None,) * 4, (None, None, None, "4")], key=repr)
    with pytest.raises(FileExistsError):
        tables.write_ragged(frame, "fields", path, "n")
    assert tables.write_ragged(frame, "fields", path, "n", header=["d", "z"], overwrite=True) == ["d", "z"] and spark.read.option("header", True).csv(path).columns == ["d", "z"]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ValueError, match="different keys"):
        tables.ragged_header(frame, "fields", "n", most=3)


def test_prediction_files(spark):
    samples = spark.createDataFrame([("a/b\\c", "x", [0.2, 0.5, 0.9, 0.49]), ("d", "y", [1.0, 0.0, 0.0, 0.0])], "sample_id string, tumor_type string, probability array<double>")
    files = {r.path: bytes(r.content) for r in tables.prediction_files(samples, (2, 2), (2, 2), "sample_id", probabilities=True).collect()}
    assert sorted(files) == ["x/a_b_c_pred.png", "x/a_b_c_prob.png", "y/d_pred.png", "y/d_prob.png"] and all(f.startswith(b"\x89PNG") for f in files.values())
    assert tables.prediction_files(samples, (2, 2), (4, 4), "sample_id", most=1).count() == 1


def test_kernels_hold_nulls_sizes_and_types(spark):
    rows = [(0, [1, 2, 3, 4]), (1, None), (2, [5, 6]), (3, []), (4, [9, 9, 9, 9]), (5, [7, None, 1, 2])]
    frame = spark.createDataFrame(rows, "k int, c array<int>")
    fixed = {r.k: r.v for r in frame.where("k < 5").select("k", kernels.kernel(lambda m: m[:, ::-1], "array<int>", 4, "c").alias("v")).collect()}
    assert fixed == {0: [4, 3, 2, 1], 1: None, 2: None, 3: None, 4: [9, 9, 9, 9]}
    anysize = {r.k: r.v for r in frame.where("k < 5").coalesce(1).select("k", kernels.kernel(lambda m: m * 2, "array<bigint>", None, "c").alias("v")).collect()}
    assert anysize == {0: [2, 4, 6, 8], 1: None, 2: [10, 12], 3: [], 4: [18] * 4}
    sums = {r.k: r.v for r in frame.where("k < 5").select("k", kernels.kernel(lambda m: m.sum(1), "double", None, F.col("c")).alias("v")).collect()}
    assert sums == {0: 10.0, 1: None, 2: 11.0, 3: 0.0, 4: 36.0}
    as_bytes = frame.where("k in (0, 1)").select(F.when(F.col("k") == 0, F.encode(F.lit("abcd"), "UTF-8")).alias("c"))
    assert {tuple(r.v) if r.v else None for r in as_bytes.select(kernels.kernel(lambda m: m[:, :2], "array<int>", 4, "c").alias("v")).collect()} == {(97, 98), None}
    pair = frame.where("k = 0").select(kernels.kernel(lambda a, b, n: (a == b).sum(1) + n, "bigint", 4, "c", F.array(*[F.lit(2)] * 4), "k", rasters=2).alias("v"))
    assert pair.first().v == 1
    assert frame.where("k > 9").select(kernels.kernel(lambda m: m, "array<int>", 4, "c").alias("v")).count() == 0


def test_large_rasters(spark):
    """A raster of 512 x 512 as bytes; turning it back gives the same hash, and its own statistics are exact."""
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 256, (2, 512 * 512)).astype(np.uint8)
    frame = spark.createDataFrame([(k, bytes(c)) for k, c in enumerate(cells)], "k int, c binary")
    back = rasters.turned(rasters.turned(F.col("c"), "rotate_90", 512), "rotate_270", 512)
    found = frame.select("k", images.sampled_hash(F.col("c"), 512).alias("h"), images.sampled_hash(back, 512).alias("b")).collect()
    assert all(r.h == r.b for r in found) and found[0].h != found[1].h
    wide = rasters.statistics(frame.select("k", rasters.turned(F.col("c"), "identity", 512).alias("c")), "c", 512, 127).collect()
    assert {(r.k, r.foreground, round(r["mean"], 9)) for r in wide} == {(k, int((c > 127).sum()), round(float(c.mean()), 9)) for k, c in enumerate(cells)}


def test_enlarged_rasters_are_never_columns(spark, monkeypatch):
    """Hash and statistics of rasters at eight times their size, a few at a time in a task, as of the enlarged column."""
    from quern.operators import kernels
    from quern.plans.rasters import rasters_512

    rng = np.random.default_rng(9)
    frame = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(rng.integers(0, 256, (3, 64 * 64)))] + [(3, None), (4, [1])], "k int, c array<int>")
    wide = frame.select("k", images.resized_nearest(F.col("c"), (64, 64), (512, 512)).alias("c"))
    a = rasters.statistics(frame, "c", 512, 127, source=(64, 64)).select("k", images.sampled_hash(F.col("c"), 512, source=(64, 64)).alias("h"), "min", "max", "mean", "sd", "distinct_values", "foreground", "min_x", "max_y")
    b = rasters.statistics(wide, "c", 512, 127).select("k", images.sampled_hash(F.col("c"), 512).alias("h"), "min", "max", "mean", "sd", "distinct_values", "foreground", "min_x", "max_y")
    of = lambda rows: {r["k"]: tuple(r) for r in rows.collect() if r["k"] < 3}
    assert of(a) == of(b) and a.where("k > 2 and (h is not null or mean is not null)").count() == 0
    made = []
    monkeypatch.setattr(images, "resized_nearest", lambda *a: made.append(a))
    assert rasters_512(spark, "/root/testdata/sf0.001").count() and not made
    seen = []
    monkeypatch.setattr(kernels.F, "arrow_udf", lambda f, kind: lambda *c: f)
    grown = kernels.kernel(lambda m: (seen.append(len(m)), m[:, 0])[1], "int", 4, "c", wide=kernels.CHUNK // 2)
    assert len(grown(kernels.pa.array([[1, 2, 3, 4]] * 9))) == 9 and max(seen) == 2


def test_augmentation_moves_masks_alike_and_noise_leaves_them(spark):
    size = (9, 6)
    rng = random.Random(4)
    rows = [(k, [rng.randrange(256) for _ in range(54)]) for k in range(40)]
    frame = spark.createDataFrame([(k, c, [255 if v >= 128 else 3 for v in c]) for k, c in rows], "k int, c array<int>, m array<int>")
    of = lambda **how: {r.k: (r.c, r.m) for r in images.augmented_pairs(frame, "c", "m", size, "k", 3, images.Augmentation(**how)).collect()}
    same, flipped, noisy = of(), of(flip=1.0), of(noise=1.0, noise_sd=0.1)
    for k, c in rows:
        mask = [255 if v >= 128 else 3 for v in c]
        assert same[k] == ([v / 255 for v in c], mask)
        mirror = lambda x: [x[y * 9 + 8 - i] for y in range(6) for i in range(9)]
        assert flipped[k] == ([v / 255 for v in mirror(c)], mirror(mask))
        assert noisy[k][1] == mask and all(0 <= v <= 1 for v in noisy[k][0]) and noisy[k][0] != same[k][0]
    spread = np.concatenate([np.array(noisy[k][0]) - np.array(c) / 255 for k, c in rows])
    inside = np.concatenate([[0.3 < v / 255 < 0.7 for v in c] for _, c in rows])
    assert abs(spread[inside].mean()) < 0.02 and abs(spread[inside].std() - 0.1) < 0.01
    parts = images.augmented_pairs(frame.repartition(7), "c", "m", size, "k", 3, images.Augmentation(0.5, 20, 0.2, 0.2, 0.2, 0.5, 0.75, 0.5)).collect()
    whole = of(flip=0.5, rotation=20, brightness=0.2, contrast=0.2, gamma=0.2, blur=0.5, noise=0.5)
    assert {r.k: (r.c, r.m) for r in parts} == whole and any(3 in m[:9] and m != same[k][1] for k, (_, m) in whole.items())


def test_rotation_by_right_angles_is_exact():
    cells = np.arange(25).reshape(1, 25)
    for degrees, name in ((0, "identity"), (90, "rotate_270"), (180, "rotate_180"), (270, "rotate_90")):
        turned = cells[:, kernels.turns(name, 5)]
        assert (np.round(kernels.rotated(cells + 0.4, (5, 5), np.array([degrees]), -1, False) - 0.0) == turned).all() or degrees
        assert (kernels.rotated(cells, (5, 5), np.array([float(degrees)]), -1, True) == turned).all()
    flat = kernels.blurred(np.full((1, 30), 77), (6, 5), 0.75)
    assert (flat == 77).all()


def test_json_lines_and_documents_must_be_objects(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('﻿{"a": 1}\n\n  {"a": 2}\n')
    assert sorted(r.a for r in tables.read_jsonl(spark, str(good), "a long").collect()) == [1, 2]
    for k, line in enumerate(('[{"a": 2}, {"a": 3}]', "3", '"x"', "null", '{"a": 1', "x")):
        path = tmp_path / f"bad{k}.jsonl"
        path.write_text('{"a": 1}\n' + line + "\n")
        with pytest.raises(Exception):
            tables.read_jsonl(spark, str(path), "a long").collect()
        document = tmp_path / f"bad{k}.json"
        document.write_text(line)
        with pytest.raises(Exception):
            tables.read_json(spark, str(document), "a long").collect()
    document = tmp_path / "good.json"
    document.write_text("﻿" + json.dumps({"a": 7, "b": {"c": [1]}}, indent=2))
    assert tables.read_json(spark, str(document), "a long, b struct<c: array<int>>").first().b.c == [1] and tables.read_json(spark, str(document)).first().a == 7


class _Kept:
    """Stands for a value and a map of the state; counts the calls, each of which is a round trip to the store."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "containsKey": self.map.__contains__, "getValue": self.map.get,
            "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "clear": self.map.clear,
        }[name]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_waiting_epochs_are_kept_in_blocks(seed):
    """2,000 epochs of one run in five batches, dealt at random: one call for each block and batch at most, not one for each epoch."""
    rng = random.Random(seed)
    epochs = [Row(epoch=e, metric=None if e % 97 == 0 else float(e % 50 + e // 300), threshold=None if e % 13 == 0 else e / 10) for e in range(1, 2001)]
    follow = stopping.BestSoFar(None, 1)
    follow._keys, follow.run, follow.waiting = ("run",), _Kept(), _Kept()
    dealt = [rng.randrange(5) for _ in epochs]
    got, plain = [], stopping.BestSoFar(None, 1)
    for turn in range(5):
        batch = [e for e, d in zip(epochs, dealt) if d == turn]
        again = [Row(epoch=e.epoch, metric=-1.0, threshold=None) for e, d in zip(epochs, dealt) if d < turn and e.epoch % 7 == 0]  # come too late
        got += follow.handleInputRows((1,), iter(batch + again), None)
    plain._keys, plain.run, plain.waiting = ("run",), _Kept(), _Kept()
    want = list(plain.handleInputRows((1,), iter(epochs), None))
    assert [r.epoch for r in got] == list(range(1, 2001)) and got == want
    assert not follow.waiting.map and follow.waiting.calls <= 5 * 4 * (2000 // 256 + 2)


def test_the_driver_holds_few_names_while_it_moves_many_files(tmp_path, monkeypatch):
    """Names are read and moved some at a time, whatever their number; a name that a task or two tasks repeat is still an error."""
    monkeypatch.setattr(rowfiles, "HELD", 64, raising=False)
    most, given = [], rowfiles.ThreadPoolExecutor.map
    monkeypatch.setattr(rowfiles.ThreadPoolExecutor, "map", lambda self, f, some: (most.append(sum(len([x] if isinstance(x, str) else x) for x in some)), given(self, f, some))[1])
    writer = rowfiles.FileWriter(str(tmp_path / "out"), False)
    batch = lambda names: pa.RecordBatch.from_pydict({"path": names, "content": [n.encode() for n in names]})
    names = [f"d{k % 3}/ü\r{k}" for k in range(1000)]
    writer.commit([writer.write(iter([batch(names[:700])])), writer.write(iter([batch(names[700:])])), writer.write(iter([]))])
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "out").rglob("ü*")} == set(names) and max(most) <= 64
    assert all((tmp_path / "out" / n).read_text(newline="") == n for n in names) and not (tmp_path / "out/_temporary").exists()
    writer = rowfiles.FileWriter(str(tmp_path / "two"), True)
    for bad, message in ((["a", "b", "a"], "the same file"), (["a\nb"], "not a path")):
        with pytest.raises(ValueError, match=message):
            writer.write(iter([batch(bad)]))
    assert not [p for p in (tmp_path / "two").rglob("*") if p.is_file()]


def test_tasks_list_and_decode_files(spark, tmp_path):
    """Names of many folders and what they hold as Spark's own readers give them; the driver lists nothing."""
    rng = random.Random(5)
    for k in range(150):
        channels, folder = rng.choice([1, 3]), tmp_path / rng.choice(["a", "a/b c", "k=1/_x=2", "_hidden", ".too", "a/_no"])
        folder.mkdir(parents=True, exist_ok=True)
        (folder / rng.choice([f"{k}.png", f"_{k}.png", f"ü{k}%20.png"])).write_bytes(png.encode(rng.randbytes(6 * channels), 3, 2, channels) if k % 10 else b"no image")
    (tmp_path / "empty").mkdir()
    of = lambda rows: sorted((r.path, r.width, r.height, r.channels, bytes(r.bytes)) for r in rows.collect())
    want = of(files.read_images(spark, str(tmp_path)))
    assert len(want) > 30 and {w for _, w, *_ in want} == {-1, 3} and {c for *_, c, _ in want} == {-1, 1, 3}
    assert of(files.read_pngs(spark, str(tmp_path))) == of(files.read_pngs(spark, f"file://{tmp_path}/")) == want
    found, many = files.listed(spark, str(tmp_path))
    assert many == len(want) == found.count() and files.listed(spark, str(tmp_path / "empty"))[1] == 0
    assert not files.read_pngs(spark, str(tmp_path / "empty")).collect()
    with pytest.raises(Exception, match="No such file"):
        files.read_pngs(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_filters_are_undone(channels):
    """Rows filtered in all five ways, as other programs write them."""
    rng = random.Random(channels)
    width, height, colour = 5, 10, {1: 0, 3: 2, 4: 6}[channels]
    rows = [[rng.randrange(256) for _ in range(width * channels)] for _ in range(height)]
    raw = bytearray()
    for y, row in enumerate(rows):
        raw.append(y % 5)
        for x, v in enumerate(row):
            a, b, c = x >= channels and row[x - channels], y and rows[y - 1][x], y and x >= channels and rows[y - 1][x - channels]
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append((v - (0, a, b, (a + b) // 2, paeth)[y % 5]) % 256)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    file = lambda depth=8, kind=colour, data=bytes(raw): b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(data)[:9]) + part(b"IDAT", zlib.compress(data)[9:]) + part(b"IEND", b"")
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    assert png.decode(file()) == (width, height, channels, bytes(row[x * channels + o] for row in rows for x in range(width) for o in order))
    assert png.decode(b"GIF89a") is None and png.decode(b"") is None
    for bad in (file()[:-5], file()[:40], file(depth=16), file(kind=3), file(data=bytes(raw[:-1])), file()[:50] + b"\0" + file()[51:]):
        with pytest.raises(Exception):
            png.decode(bad)


def test_exported_files_are_shared_by_tasks_and_never_listed_by_the_driver(spark, monkeypatch):
    from quern.plans import sources

    written = []
    monkeypatch.setattr(sources, "write_files", lambda rows, root: (written.append(rows.rdd.getNumPartitions()), rowfiles.write_files(rows, root))[1])
    rows = sources.exported_files(spark, "/root/testdata/sf0.001")
    assert written[0] >= spark.sparkContext.defaultParallelism and rows.count() == 4 * spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    assert "Format: image" not in rows._jdf.queryExecution().toString()
