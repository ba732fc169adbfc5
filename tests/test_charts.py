"""Charts, comparisons, tagged duplicates, configurations in tables and draws against loops."""

import io
import json
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import audit, confusion
from quern.sources import charts, config


def pixels(png):
    """A PNG of 8-bit colours as an array, by the format's own rules (no filters are used here)."""
    file, body, size = io.BytesIO(png[8:]), b"", None
    while part := file.read(8):
        n, kind = struct.unpack(">I4s", part)
        data = file.read(n)
        assert struct.unpack(">I", file.read(4))[0] == zlib.crc32(kind + data)
        size = struct.unpack(">II", data[:8]) if kind == b"IHDR" else size
        body += data if kind == b"IDAT" else b""
    w, h = size
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 3 * w)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(h, w, 3)


def test_lines_pass_through_their_points(spark):
    rng = random.Random(1)
    points = [(f"c{k % 2}", s, x, rng.random() * (1 + k)) for k in range(2) for s in ("a", "b") for x in range(12)] + [("c0", "a", 3, None), ("c0", "a", None, 1.0), ("c0", "a", 5, float("nan")), ("flat", "s", 1, 0.5), ("none", "s", 1, None)]
    frame = spark.createDataFrame(points, "chart string, series string, x int, y double").repartition(3)
    drawn = {r.path: pixels(bytes(r.content)) for r in charts.line_charts(frame, 200, 120).collect()}
    assert sorted(drawn) == ["c0.png", "c1.png", "flat.png"] and all(p.shape == (120, 200, 3) for p in drawn.values())
    good = frame.where("x is not null and y is not null and not isnan(y)")
    for r in charts.pixel_points(good, 200, 120).collect():
        pixel = tuple(drawn[f"{r.chart}.png"][r.py, r.px].tolist())
        assert pixel in charts.COLOURS[:2] and (r.series == "a" or r.chart == "flat" or pixel == charts.COLOURS[1])
    for chart in ("c0", "c1"):
        colour = drawn[f"{chart}.png"][charts.MARGIN : -charts.MARGIN, charts.MARGIN : -charts.MARGIN] == charts.COLOURS[1]
        assert colour.all(2).any(0).all()  # the curve has no gap between its first and last column


def test_many_points_give_the_same_picture_as_their_columns(spark):
    """A pixel column needs its first, last, lowest and highest point only."""
    rng = random.Random(2)
    y = [rng.random() for _ in range(5000)]
    frame = spark.createDataFrame([("c", "s", k, v) for k, v in enumerate(y)], "chart string, series string, x int, y double")
    (page,) = [pixels(bytes(r.content)) for r in charts.line_charts(frame, 140, 90, (0.0, 1.0)).collect()]
    want = charts._canvas(140, 90)
    spots = [(r.px, r.py) for r in charts.pixel_points(frame.orderBy("x"), 140, 90, (0.0, 1.0)).collect()]
    spots = [(20 + int(k / 4999 * 99 + 0.5), 20 + int(np.floor((1 - v) * 49 + 0.5))) for k, v in enumerate(y)]
    for (x0, y0), (x1, y1) in zip(spots, spots[1:]):
        charts._line(want, x0, y0, x1, y1, charts.COLOURS[0])
    assert (page == want).all()


def test_bands_lie_under_curves(spark):
    frame = spark.createDataFrame([("c", "s", x, 0.5, 0.4, 0.6) for x in range(5)], "chart string, series string, x int, y double, low double, high double")
    (page,) = [pixels(bytes(r.content)) for r in charts.line_charts(frame, 100, 80, (0.0, 1.0)).collect()]
    light = tuple(int(np.floor(0.75 * 255 + 0.25 * c + 0.5)) for c in charts.COLOURS[0])
    column = [tuple(p) for p in page[:, 50].tolist()]
    assert column.count(charts.COLOURS[0]) == 1 and column.count(light) >= 6


def test_bars(spark):
    frame = spark.createDataFrame([("a", 0, 5), ("a", 3, 10), ("a", 9, 1), ("b", 1, 1)], "chart string, bin int, n long")
    drawn = {r.path: pixels(bytes(r.content)) for r in charts.bar_charts(frame, 4, 120, 80).collect()}
    tall = [int((drawn["a.png"][: 80 - charts.MARGIN, 20 + 20 * k + 3] == charts.COLOURS[0]).all(1).sum()) for k in range(4)]
    assert tall == [20, 0, 0, 39] and sorted(drawn) == ["a.png", "b.png"]


def test_comparisons_match_the_expression(spark):
    from quern.sources.tables import overlay

    rng = random.Random(3)
    gray, mask, p = [rng.randrange(256) for _ in range(30)], [rng.choice([0, 3, 128, 255]) for _ in range(30)], [rng.random() for _ in range(30)]
    frame = spark.createDataFrame([("x.png", gray, mask, p)], "path string, image array<int>, mask array<int>, probability array<double>")
    page = pixels(bytes(charts.comparison_files(frame, (6, 5), (6, 5)).first().content))
    assert page.shape == (5, 24, 3) and (page[:, :6, 0].ravel() == gray).all() and (page[:, 6:12, 1].ravel() == [255 * (m >= 128) for m in mask]).all()
    cells = spark.createDataFrame(list(zip(gray, [m >= 128 for m in mask], [v >= 0.5 for v in p])), "g int, t boolean, p boolean").coalesce(1)
    want = [tuple(r[0]) for r in cells.select(overlay(F.col("g"), F.col("t"), F.col("p"))).collect()]
    assert [tuple(x) for x in page[:, 18:].reshape(-1, 3).tolist()] == want


def test_duplicates_of_two_kinds(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, "b", "x"), (4, "c", "y"), (5, "a", None), (6, None, "x")]
    found = audit.tagged_members(spark.createDataFrame(rows, "id int, h string, m string"), {"image": "h", "mask": "m"}).collect()
    assert sorted((r.kind, r.hash, r.id, r.group_size) for r in found) == [("image", "a", k, 3) for k in (1, 2, 5)] + [("mask", "x", k, 3) for k in (1, 3, 6)]


def test_configurations_in_a_table(spark):
    good = {s: {} for s in config.SECTIONS} | {"data": {"split_ratios": {"train": 0.7, "val": 0.15, "test": 0.15}, "image_size": [256, 256]}, "model": {"in_channels": 1, "out_channels": 1}}
    texts = {1: json.dumps(good), 2: json.dumps({**good, "metrics": {"threshold": 2}}), 3: "[1]", 4: None, 5: json.dumps({**good, "_path": "x", "project": {"seed": 3}}), 6: "{"}
    frame = spark.createDataFrame(list(texts.items()), "k int, value string").repartition(2)
    found = {(r.k, r.problem.split(":")[0]) for r in config.text_problems(frame, "k").collect()}
    assert found == {(2, "metrics.threshold must lie between 0 and 1"), (3, "unreadable"), (4, "unreadable"), (6, "unreadable")}
    digests = {r.k: r.digest for r in config.text_digests(frame.where("k in (1, 2, 5)"), "k").collect()}
    assert digests[1] == digests[5] != digests[2]


def test_seeds_of_configurations_in_a_table(spark):
    good = "project:\n  seed: 42  \n  seeds: 1\nx:\n  other_seed: 5\n"
    frame = spark.createDataFrame([(7, good)], "s int, value string")
    assert config.seed_texts(frame, F.col("s")).first().value == config.seed_config(good, 7)
    for bad in ("a: 1\n", good + good):
        with pytest.raises(Exception, match="exactly one"):
            config.seed_texts(spark.createDataFrame([(7, bad)], "s int, value string"), F.col("s")).collect()


def test_every_point_is_drawn_once_whatever_the_weights(spark):
    rng = random.Random(7)
    frame = spark.createDataFrame([(k, rng.choice([0.0, 1e-9, rng.random(), 1e3 * rng.random()])) for k in range(3000)], "k int, w double").repartition(5)
    for draws in (1, 997, 100_000):
        got = confusion.systematic_draw(frame, "w", draws, "seed", "k")
        counts = {r.k: (r.draws, r.w) for r in got.collect()}
        total = sum(w for _, w in counts.values())
        assert sum(n for n, _ in counts.values()) == draws and all(abs(n - draws * w / total) < 1 + 1e-6 for n, w in counts.values()) and Counter(got.columns) == Counter(["k", "w", "draws"])


def test_comparisons_are_drawn_a_batch_at_a_time(spark, monkeypatch):
    """Pages of many rows, over the edge of a chunk, are those of each row alone; resizing was called once a row."""
    import pyarrow as pa

    rng, calls, plain = random.Random(4), [], charts.bilinear
    rows = [(f"{k}.png", [rng.randrange(256) for _ in range(30)], [rng.choice([0, 128]) for _ in range(30)], [rng.random() for _ in range(4)]) for k in range(50)]
    monkeypatch.setattr(charts, "CHUNK", 4 * 30 * 20)
    monkeypatch.setattr(charts, "bilinear", lambda m, *more: calls.append(len(m)) or plain(m, *more))

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    run = charts.comparison_files(Rows(), (6, 5), (2, 2))
    batch = pa.table([pa.array(c) for c in zip(*rows)], ["path", "image", "mask", "probability"]).to_batches()[0]
    together = pa.Table.from_batches(run(iter([batch]))).to_pylist()
    assert calls == [20, 20, 10]
    assert together == [r for k in range(50) for r in pa.Table.from_batches(run(iter([batch.slice(k, 1)]))).to_pylist()]
    with pytest.raises(ValueError):
        list(run(iter([pa.table([["a"], [[1] * 29], [[1] * 30], [[0.5] * 4]], ["path", "image", "mask", "probability"]).to_batches()[0]])))
