"""Charts as PNG files: curves with bands, bars, and comparisons of masks, a chart a group or a row.

Points become pixels first, as an aggregation: of a series' points in one column of pixels the first, the last, the lowest
and the highest are enough to draw the same lines, so that a chart takes no more memory than its columns however many points
there are.  Charts have axes and colours but no text; titles and labels belong to whoever shows them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.kernels import CHUNK, _lengths, bilinear, matrix
from quern.sources.png import encode
from quern.storage import checkpoint

#: Colours of series in the order of their names, of axes, and how much of a band's colour shows.
COLOURS = ((31, 119, 180), (255, 127, 14), (44, 160, 44), (214, 39, 40), (148, 103, 189), (140, 86, 75), (227, 119, 194), (127, 127, 127))
AXIS, BAND_SHARE = (96, 96, 96), 0.25
WIDTH, HEIGHT, MARGIN = 640, 400, 20


def _pixels(points: DataFrame, width: int, height: int, y_range: tuple[float, float] | None) -> DataFrame:
    """The points with px (from the left) and pixel rows (from the top) of y, low and high inside the margins."""
    bounds = [F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min(F.least("y", "low", "high")).alias("_y0"), F.max(F.greatest("y", "low", "high")).alias("_y1")]
    ranges = checkpoint(points.groupBy("chart").agg(*bounds).withColumnRenamed("chart", "_chart"))
    if y_range:
        ranges = ranges.withColumns({"_y0": F.lit(float(y_range[0])), "_y1": F.lit(float(y_range[1]))})
    inner_w, inner_h = width - 2 * MARGIN - 1, height - 2 * MARGIN - 1
    across = F.when(F.col("_x1") > F.col("_x0"), (F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))).otherwise(0.5)
    down = lambda c: F.when(F.col("_y1") > F.col("_y0"), (F.col("_y1") - F.col(c)) / (F.col("_y1") - F.col("_y0"))).otherwise(0.5)
    place = lambda share, room: (MARGIN + F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * room + 0.5)).cast("int")
    rows = points.join(ranges, F.col("chart") == F.col("_chart"))
    return rows.select("chart", "series", "x", place(across, inner_w).alias("px"), *[place(down(c), inner_h).alias(f"p{c}") for c in ("y", "low", "high")])


def _canvas(width: int, height: int) -> np.ndarray:
    page = np.full((height, width, 3), 255, np.uint8)
    page[MARGIN : height - MARGIN, MARGIN - 1] = AXIS
    page[height - MARGIN, MARGIN - 1 : width - MARGIN] = AXIS
    return page


def _line(page: np.ndarray, x0: int, y0: int, x1: int, y1: int, colour: tuple[int, int, int]) -> None:
    n = max(abs(x1 - x0), abs(y1 - y0))
    at = np.arange(n + 1) / max(n, 1)
    page[np.floor(y0 + (y1 - y0) * at + 0.5).astype(int), np.floor(x0 + (x1 - x0) * at + 0.5).astype(int)] = colour


def pixel_points(points: DataFrame, width: int = WIDTH, height: int = HEIGHT, y_range: tuple[float, float] | None = None) -> DataFrame:
    """chart, series, px and py: where each point (chart, series, x, y) lies in its chart."""
    rows = points.select("chart", "series", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns({"low": F.col("y"), "high": F.col("y")})
    return _pixels(rows, width, height, y_range).select("chart", "series", "px", "py")


def line_charts(points: DataFrame, width: int = WIDTH, height: int = HEIGHT, y_range: tuple[float, float] | None = None) -> DataFrame:
    """path and content: ``<chart>.png`` with a curve for each series of the points (chart, series, x, y; band: low, high).

    Series are drawn in the order of their names, bands below all curves.  Points without x or y are left out; axes span
    the points of a chart, or ``y_range``.  A chart without points isn't drawn.
    """
    band = {"low", "high"} <= set(points.columns)
    rows = points.select("chart", "series", *[F.col(c).cast("double").alias(c) for c in ("x", "y")], *[(F.col(c).cast("double") if band else F.lit(None).cast("double")).alias(c) for c in ("low", "high")])
    # Without a band the curve itself is one of no height, which isn't drawn.
    rows = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)").withColumns({"low": F.coalesce("low", "y"), "high": F.coalesce("high", "y")})
    placed = _pixels(rows, width, height, y_range)
    columns = placed.groupBy("chart", "series", "px").agg(
        F.min_by("py", "x").alias("first"), F.max_by("py", "x").alias("last"), F.min("py").alias("top"), F.max("py").alias("bottom"), F.min("phigh").alias("high"), F.max("plow").alias("low")
    )

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        page = _canvas(width, height)
        table = table.sort_by([("series", "ascending"), ("px", "ascending")])
        names = table["series"].to_pylist()
        values = {c: table[c].to_numpy() for c in ("px", "first", "last", "top", "bottom", "high", "low")}
        order = list(dict.fromkeys(names))
        groups = [(COLOURS[k % len(COLOURS)], np.array([i for i, n in enumerate(names) if n == s])) for k, s in enumerate(order)]
        for colour, rows in groups:
            px, high, low = (values[c][rows] for c in ("px", "high", "low"))
            if (high < low).any():
                for x in range(px[0], px[-1] + 1):
                    y0, y1 = int(np.floor(np.interp(x, px, high) + 0.5)), int(np.floor(np.interp(x, px, low) + 0.5))
                    part = page[y0 : y1 + 1, x].astype(float)
                    page[y0 : y1 + 1, x] = np.floor((1 - BAND_SHARE) * part + BAND_SHARE * np.array(colour) + 0.5)
        for colour, rows in groups:
            px, first, last, top, bottom = (values[c][rows] for c in ("px", "first", "last", "top", "bottom"))
            for k in range(len(px)):
                page[top[k] : bottom[k] + 1, px[k]] = colour
                if k:
                    _line(page, px[k - 1], last[k - 1], px[k], first[k], colour)
        return pa.table({"path": [f"{key[0].as_py()}.png"], "content": pa.array([encode(page.tobytes(), width, height, 3)], pa.binary())})

    return columns.groupBy("chart").applyInArrow(draw, "path string, content binary")


def bar_charts(bars: DataFrame, bins: int, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """path and content: ``<chart>.png`` with a bar for each of ``bins`` places from the bars (chart, bin, n); the highest fills the chart.

    A missing bar has no height; a bar's height is its share of the highest, rounded to whole pixels.
    """
    inner_w, inner_h = width - 2 * MARGIN, height - 2 * MARGIN - 1

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        page = _canvas(width, height)
        n = np.zeros(bins, np.int64)
        n[table["bin"].to_numpy()] = table["n"].to_numpy()
        tall = bar_heights(n, inner_h)
        for k in range(bins):
            left, right = MARGIN + k * inner_w // bins, MARGIN + (k + 1) * inner_w // bins - 1
            page[height - MARGIN - tall[k] : height - MARGIN, left:right] = COLOURS[0]
        return pa.table({"path": [f"{key[0].as_py()}.png"], "content": pa.array([encode(page.tobytes(), width, height, 3)], pa.binary())})

    return bars.select("chart", F.col("bin").cast("int").alias("bin"), F.col("n").cast("long").alias("n")).where(F.col("bin").between(0, bins - 1)).groupBy("chart").applyInArrow(draw, "path string, content binary")


def bar_heights(n: np.ndarray, room: int) -> np.ndarray:
    return (2 * n * room + n.max()) // (2 * max(1, n.max()))


def _cells(rasters: pa.Array, n: int) -> np.ndarray:
    if rasters.flatten().null_count or (_lengths(rasters)[1] != n).any():
        raise ValueError(f"a raster hasn't {n} cells")
    return matrix(rasters, np.arange(len(rasters)), n)


def comparison_files(samples: DataFrame, size: tuple[int, int], probability_size: tuple[int, int], threshold: float = 0.5) -> DataFrame:
    """path and content: image, truth, prediction and overlay side by side, for each sample.

    ``samples`` has path, image and mask (arrays of ``size`` cells) and probability (``probability_size`` cells), which is
    resized bilinearly and compared with ``threshold``; a mask's foreground starts at 128.
    """
    (w, h), schema = size, "path string, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CHUNK // (4 * w * h))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                gray, truth = (_cells(batch.column(k), w * h).astype(np.int64).reshape(-1, h, w) for k in (1, 2))
                on = bilinear(_cells(batch.column(3), probability_size[0] * probability_size[1]), probability_size, size).reshape(-1, h, w) >= threshold
                truth = truth >= 128
                plain = lambda x: np.repeat(x[..., None], 3, -1)
                pages = np.concatenate([plain(gray), plain(truth * 255), plain(on * 255), overlaid(gray, truth, on)], 2).astype(np.uint8)
                out = [encode(page.tobytes(), 4 * w, h, 3) for page in pages]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return samples.select("path", "image", "mask", "probability").mapInArrow(run, schema)


#: Colours of hits, false alarms and misses, and the image's share under them.
HIT, ALARM, MISS, IMAGE_SHARE = (0, 255, 0), (255, 0, 0), (255, 215, 0), 0.45


def overlaid(gray: np.ndarray, truth: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Red, green and blue of a gray image with the hits, false alarms and misses of a prediction over it."""
    out = np.repeat(gray[..., None], 3, -1).astype(np.float64)
    for where, colour in ((truth & on, HIT), (~truth & on, ALARM), (truth & ~on, MISS)):
        out[where] = np.floor(IMAGE_SHARE * out[where] + (1 - IMAGE_SHARE) * np.array(colour))
    return out
