"""Readers, writers, configuration, rasters and the stream."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import rasters
from quern.schemas import EPOCH_RECORD, MANIFEST
from quern.sources import config, files, tables
from quern.streaming import history


def manifest(spark, n=6):
    rows = [(f"c{k % 2}__enh_{k}", k, f"c{k % 2}", f"g{k}", ("train", "val", "test")[k % 3], f"i/{k}.png", f"m/{k}.png", "a" * 64, "b" * 64) for k in range(n)]
    return spark.createDataFrame(rows, MANIFEST)


def test_manifest_round_trip_and_guards(spark, tmp_path):
    path = f"{tmp_path}/m"
    tables.write_manifest(manifest(spark), path)
    back = tables.read_manifest(spark, path)
    assert sorted(back.collect()) == sorted(manifest(spark).collect())
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_manifest(manifest(spark), path)
    manifest(spark).drop("split").write.option("header", True).csv(f"{tmp_path}/short")
    with pytest.raises(ValueError, match="columns"):
        tables.read_manifest(spark, f"{tmp_path}/short")
    manifest(spark).withColumn("sample_id", F.lit("same")).write.option("header", True).csv(f"{tmp_path}/same")
    with pytest.raises(ValueError, match="repeated"):
        tables.read_manifest(spark, f"{tmp_path}/same")


def test_group_map(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        return tables.read_group_map(spark, str(path))

    groups = read("sample_id,group_id,more\n" + "\n".join(f" c{k % 2}__enh_{k} , p{k // 2},x" for k in range(6)))
    assert {r.group_id for r in tables.apply_group_map(manifest(spark), groups).collect()} == {"p0", "p1", "p2"}
    with pytest.raises(ValueError, match="unmapped"):
        tables.apply_group_map(manifest(spark, 7), groups)
    for text, what in (("sample_id\na\n", "needs"), ("sample_id,group_id\na,\n", "blank"), ("sample_id,group_id\na,b\na,c\n", "repeats")):
        with pytest.raises(ValueError, match=what):
            read(text)


def record(epoch, loss, **more):
    return json.dumps({"epoch": epoch, "learning_rate": 0.1, "train": {"loss": loss, "macro_iou": 0.6, "macro_dice": 0.7}, "val": {"loss": 0.7, "macro_iou": 0.65, "macro_dice": 0.75}, **more})


def test_history_last_line_wins_and_flattens(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text("\n".join([record(1, 0.9), "", record(2, 0.5), record(1, 0.8)]) + "\n")
    rows = {r.epoch: r for r in tables.flatten_epochs(tables.read_history(spark, f"{tmp_path}/h.jsonl")).collect()}
    assert len(rows) == 2 and rows[1].train_loss == 0.8 and rows[1].val_macro_iou == 0.65 and rows[1].val_macro_dice == 0.75
    assert tables.read_jsonl(spark, f"{tmp_path}/h.jsonl", EPOCH_RECORD).count() == 3


def test_stream_rebuilds_the_history(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text(record(1, 0.9, elapsed_seconds=1.0) + "\n")
    history.rebuild_history(spark, str(log), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    # A resumed run starts its clock anew: its line is the later one all the same, and of its own two the last.
    time.sleep(0.05)
    (log / "b.jsonl").write_text(record(1, 0.8, elapsed_seconds=0.5) + "\n\n" + record(2, 0.5) + "\n" + record(1, 0.7, elapsed_seconds=0.2) + "\n")
    history.rebuild_history(spark, str(log), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r.epoch: r.train_loss for r in history.current_history(spark, f"{tmp_path}/out").collect()} == {1: 0.7, 2: 0.5}
    time.sleep(0.05)
    (log / "c.jsonl").write_text(record(3, 0.4) + "\n")
    history.rebuild_history(spark, str(log), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r.epoch: r.train_loss for r in history.current_history(spark, f"{tmp_path}/out").collect()} == {1: 0.7, 2: 0.5, 3: 0.4}


def test_file_names_and_masks(spark, tmp_path):
    folder = tmp_path / "glioma"
    folder.mkdir()
    for name in ("enh_1.png", "enh_1_mask.png", "enh_12.png"):
        (folder / name).write_bytes(b"x" + name.encode())
    rows = files.parse_class_files(files.inventory(spark, str(tmp_path), "*.png")).collect()
    assert {(r.tumor_type, r.source_id, r.is_mask) for r in rows} == {("glioma", 1, False), ("glioma", 1, True), ("glioma", 12, False)}
    with pytest.raises(ValueError):
        files.inventory(spark, str(tmp_path), "*.tif")
    masks = spark.createDataFrame([([0, 3, 255],), ([0, 7, 255],), ([3, 3, 3],), ([255],)], "m array<int>")
    assert [r[0] for r in masks.select(files.mask_problems(F.col("m"))).collect()] == [[], ["unexpected_values"], ["no_foreground"], ["no_background"]]
    cells = [3] * 64
    for y in range(2, 5):
        for x in range(3, 7):
            cells[8 * y + x] = 255
    assert sum(spark.createDataFrame([(cells,)], "m array<int>").select(files.foreground(F.col("m"))).first()[0]) == 12
    pixel = spark.createDataFrame([([240, 128, 10],)], "c array<int>")
    assert pixel.select(files.channel(F.col("c"), 3, 1), files.channel(F.col("c"), 3, 2)).first() == ([128], [10])
    raw = spark.createDataFrame([(1, bytearray([0, 127, 128, 255])), (2, None)], "k int, b binary")
    assert {r.k: r.cells for r in files.with_cells(raw, "b").collect()} == {1: [0, 127, 128, 255], 2: []}


def test_case_map_and_folds(spark):
    cases = tables.case_map(manifest(spark))
    assert {r.case_id for r in cases.collect()} == {f"k3m_c{k % 2}__enh_{k}" for k in range(6)}
    assert {r.split: len(r.cases) for r in tables.folds(cases).collect()} == {"train": 2, "val": 2}
    clash = manifest(spark).withColumn("sample_id", F.concat(F.lit("a"), F.when(F.col("source_id") == 0, "-").otherwise("."), (F.col("source_id") % 2).cast("string")))
    with pytest.raises(Exception, match="clash"):
        tables.case_map(clash).collect()


def good_config():
    return {
        "project": {"name": "run", "seed": 42, "output_dir": "runs/run_seed42"},
        "data": {
            "root": "DATASET", "manifest": "splits/m.csv", "split_ratios": {"train": 0.70, "val": 0.15, "test": 0.15}, "image_size": [256, 256], "channel_mode": "flair_green",
            "positive_sampling_fraction": 0.40, "augmentation": {"horizontal_flip_probability": 0.5, "rotation_degrees": 5.0},
        },
        "model": {"name": "unet", "encoder": "double_conv", "in_channels": 1, "out_channels": 1},
        "loss": {"name": "bce_positive_dice"}, "optimizer": {"name": "adamw"}, "scheduler": {"name": "reduce_on_plateau"}, "training": {"epochs": 150},
        "metrics": {"threshold": 0.5, "primary": "positive_macro_iou", "threshold_search": [0.3, 0.5]},
        "evaluation": {"split": "val", "save_predictions": True, "max_saved_predictions": None},
    }


CONFIG_FAULTS = [
    ("data", "split_ratios", {"train": 0.8, "val": 0.2}, "train, val and test"),
    ("data", "split_ratios", {"train": 1.15, "val": -0.3, "test": 0.15}, "positive"),
    ("data", "split_ratios", {"train": 0.9, "val": 0.2, "test": 0.1}, "sum to 1"),
    ("data", "image_size", [256], "two positive integers"),
    ("data", "image_size", [250, 256], "divisible by 16"),
    ("data", "channel_mode", "green_flair", "channel_mode"),
    ("data", "positive_sampling_fraction", 1.0, "positive_sampling_fraction"),
    ("data", "augmentation", {"gaussian_blur_probability": 1.5}, "gaussian_blur_probability"),
    ("model", "in_channels", 3, "in_channels must be 1"),
    ("model", "out_channels", 2, "out_channels"),
    ("metrics", "threshold", 0.0, "metrics.threshold must"),
    ("metrics", "threshold_search", [0.5, 1.0], "threshold_search"),
    ("evaluation", "max_saved_predictions", 0, "max_saved_predictions"),
    ("evaluation", "save_predictions", "yes", "save_predictions"),
]


def test_a_history_in_parts_is_one_log(spark, tmp_path):
    line = lambda epoch, v: json.dumps({"epoch": epoch, "train": {"loss": v, "macro_iou": v}, "val": {"loss": v}, "best_val_metric": v})
    (tmp_path / "part-00000").write_text(line(1, 9.0) + "\n" + line(2, 8.0) + "\n" * 9 + line(1, 7.0) + "\n" + line(3, 5.0) + "\n")
    (tmp_path / "part-00001").write_text("\n" + line(2, 1.0) + "\n")
    found = tables.flatten_epochs(tables.read_history(spark, str(tmp_path), parts=True)).collect()
    assert sorted((r["epoch"], r["train_loss"]) for r in found) == [(1, 7.0), (2, 1.0), (3, 5.0)]
    assert tables.read_history(spark, str(tmp_path)).count() == 4  # of two files, each has its own last epoch 2


def test_a_history_is_written_by_several_tasks(spark):
    from quern.plans import sources

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        epochs = spark.read.text(sources._history(spark, "/root/testdata/sf0.01")).select(F.col("_metadata.file_path").alias("file"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert epochs.distinct().count() > 1


def test_each_config_rule_fails_alone():
    assert config.problems(good_config()) == []
    for section, key, value, message in CONFIG_FAULTS:
        broken = good_config()
        broken[section][key] = value
        found = config.problems(broken)
        assert len(found) == 1 and message in found[0], (section, key, found)
    for section in config.SECTIONS:
        broken = good_config()
        del broken[section]
        assert f"section {section} is missing" in config.problems(broken)
    resnet = good_config()
    resnet["data"]["image_size"], resnet["model"]["encoder"] = [48, 48], "resnet34"
    assert config.problems(resnet) == ["data.image_size must be divisible by 32"]
    resnet["model"] |= {"encoder": "double_conv", "name": "resnet34_unet"}
    assert config.problems(resnet) == []  # the encoder's name alone asks for 32
    with pytest.raises(ValueError):
        config.validate({})


def test_many_small_images_are_read_by_few_tasks(spark, tmp_path, monkeypatch):
    from quern.sources.png import encode

    for k in range(260):
        (tmp_path / f"{k}.png").write_bytes(encode(bytes([k % 256]), 1, 1))
    monkeypatch.setattr(files, "READERS", 1)
    rows = files.read_images(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and rows.where("width = 1").count() == 260


def test_many_configs_are_shared_by_tasks_and_read_by_the_c_parser(spark, monkeypatch):
    yaml = pytest.importorskip("yaml")
    from quern.plans import sources

    texts = sources._config_texts(spark, "/root/testdata/sf0.001")  # one small file
    sizes = texts.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < texts.count() / 2
    assert "Join" not in sources.config_comparison(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    text = json.dumps(good_config())
    plain, calls = yaml.safe_load, []
    monkeypatch.setattr(yaml, "safe_load", lambda t: calls.append(t) or plain(t))
    assert config.load_config_text(text) == good_config() and (not calls or not yaml.__with_libyaml__)
    with pytest.raises(yaml.YAMLError):
        config.load_config_text("a: [1")
    assert calls == ["a: [1"] or not yaml.__with_libyaml__


def test_config_comparison_and_stages():
    assert config.comparable_digest({"seed": 1, "a": {"output_dir": "x", "b": 2}}) == config.comparable_digest({"seed": 2, "a": {"b": 2}, "_path": "y"})
    assert config.without_internal({"_project_root": "x", "a": 1}) == {"a": 1}
    assert config.seed_config("a: 1\nseed: 42\n", 7) == "a: 1\nseed: 7\n"
    with pytest.raises(ValueError):
        config.seed_config("a: 1\n", 7)
    assert config.next_stage({"a": True}, ("a", "b")) == "b" and config.next_stage({"a": True, "b": True}, ("a", "b")) is None
    done = {"prepare"}
    stages = {name: (lambda name=name: done.add(name)) for name in ("prepare", "train", "report")}
    assert config.run_stages(stages, done.__contains__) == ["train", "report"] and config.run_stages(stages, done.__contains__) == []
    with pytest.raises(RuntimeError):
        config.run_stages({"idle": lambda: None}, lambda _: False)
    with pytest.raises(ValueError):
        config.plan_stages({"b": True}, ("a", "b"))
    assert config.run_all([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: done.add("c"))]) == {"b": "division by zero"} and "c" in done
    assert [config.run_state(x, 150) for x in ({}, {"history": 30, "checkpoint": 12}, {"history": 150, "checkpoint": 90, "metrics": 352})] == ["missing", "resume", "complete"]
    with pytest.raises(ValueError):
        config.run_state({"history": 3, "checkpoint": 9}, 150)


def test_orientations_invert_and_near_pairs_match_nested_loops(spark):
    import random

    from quern.operators import images, near

    cells = list(range(16))
    turn = lambda c, name, size: [c[k] for k in rasters.permutation(name, size)]
    for name in rasters.ORIENTATIONS:
        assert turn(turn(cells, name, 4), rasters.INVERSE[name], 4) == cells
    rng = random.Random(1)
    base = {k: [rng.randrange(256) for _ in range(64 * 64)] for k in range(10)}
    for k, name in enumerate(rasters.ORIENTATIONS):
        base[100 + k] = [min(255, v + 1) for v in turn(base[k], name, 64)]
    base |= {200 + k: [7] * 4096 for k in range(5)}  # blank images are near nothing

    def hash_of(c, name):
        s = [c[k] for k in images.sample_places(64, name)]
        return sum((s[y * 17 + x] > s[y * 17 + x + 1]) << (16 * y + x) for y in range(16) for x in range(16))

    frame = spark.createDataFrame(list(base.items()), "k long, c array<int>")
    words = {r.k: r.h for r in frame.select("k", images.sampled_hash(F.col("c"), 64, "rotate_90").alias("h")).collect()}
    assert all(sum((w & (2**64 - 1)) << (64 * k) for k, w in enumerate(words[k])) == hash_of(c, "rotate_90") for k, c in base.items() for k in [k])
    got = {(r.a, r.b): (r.transform, r.distance) for r in near.near_pairs(frame, "k", "c", 64, 12, 0.95).collect()}
    want = {}
    for k, name in enumerate(rasters.ORIENTATIONS):
        forward = (hash_of(base[k], name) ^ hash_of(base[100 + k], "identity")).bit_count()
        want[k, 100 + k] = (name, min(forward, (hash_of(base[100 + k], rasters.INVERSE[name]) ^ hash_of(base[k], "identity")).bit_count()))
    assert got == want
    across = near.near_across(frame.where("k < 100"), frame.where("k >= 100"), "k", "c", 64, 12, 0.95).collect()
    assert [(r.a, r.b) for r in across] == [(0, 100)]
