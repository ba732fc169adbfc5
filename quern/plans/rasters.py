"""Rasters: an embedding of 64 numbers is a small raster, and the seed of one of 64 x 64 byte values.

The table holds no similar pairs, so turned copies of some rows are planted: every seventh row flipped and every eleventh
rotated, the latter slightly brighter.  They must be found again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from quern.operators import audit, components, images, near, rasters, resolve
from quern.operators.kernels import kernel
from quern.plans.metrics import rounded
from quern.plans.registry import query, read
from quern.sources import charts, files
from quern.sources.rowfiles import write_files
from quern.storage import new_path, table

SIZE, SMALL, DISTANCE, CORRELATION = 64, 8, 12, 0.95
FLIP, TURN = 1_000_000, 2_000_000
WHOLE = 1_000_000


# ---- the tables and their SQL -------------------------------------------------------------------------------------------

_EMB = "emb AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS c FROM embeddings)"
_WHOLE = f"list_transform(c, lambda v: CAST(floor(abs(v) * {WHOLE}) AS BIGINT))"
_BASE = f"""{_EMB}, whole AS (SELECT k, {_WHOLE} AS a FROM emb),
  base AS (SELECT k, list_transform(range(4096), lambda i: CAST((a[(i // 512) * 8 + (i % 64) // 8 + 1] * (17 + (i % 8) * 31 + ((i // 64) % 8) * 57) // 1000) % 256 AS INTEGER)) AS c FROM whole)"""
#: Place of the source cell of cell i by orientation, for a raster of 64 x 64.
_SOURCES = {
    "identity": "i", "flip_h": "(i // 64) * 64 + 63 - i % 64", "flip_v": "(63 - i // 64) * 64 + i % 64", "rotate_180": "4095 - i", "rotate_90": "(63 - i % 64) * 64 + i // 64",
    "rotate_270": "(i % 64) * 64 + 63 - i // 64", "transpose": "(i % 64) * 64 + i // 64", "anti_transpose": "(63 - i % 64) * 64 + 63 - i // 64",
}
_ORIENT = "orient AS (" + " UNION ALL ".join(f"SELECT {k} AS o, '{n}' AS name, list_transform(range(4096), lambda i: {_SOURCES[n]}) AS p" for k, n in enumerate(rasters.ORIENTATIONS)) + ")"
_PLACES = "s AS (SELECT o, list_transform(range(272), lambda j: p[least(63, (j // 17) * 64 // 16 + 2) * 64 + least(63, (j % 17) * 64 // 17 + 1) + 1]) AS q FROM orient)"
_TURNED = "list_transform({p}, lambda j: {c}[j + 1])"
_BRIGHTER = "list_transform({c}, lambda v: least(v + 2, 255))"
_PLANTED = f"""{_BASE}, {_ORIENT}, {_PLACES}, pl AS (SELECT k, c FROM base UNION ALL SELECT k + {FLIP}, {_TURNED.format(p="(SELECT p FROM orient WHERE name = 'flip_h')", c='c')} FROM base WHERE k % 7 = 0
  UNION ALL SELECT k + {TURN}, {_BRIGHTER.format(c=_TURNED.format(p="(SELECT p FROM orient WHERE name = 'rotate_90')", c='c'))} FROM base WHERE k % 11 = 0)"""
_BITS = "list_aggregate(list_transform(range(256), lambda b: CASE WHEN {c}[{q}[(b // 16) * 17 + b % 16 + 1] + 1] > {c}[{q}[(b // 16) * 17 + b % 16 + 2] + 1] THEN '1' ELSE '0' END), 'string_agg', '')"
_APART = "bit_count(xor({a}::BIT, {b}::BIT))"


def _corr(a: str, b: str) -> str:
    dot = lambda x, y: f"list_dot_product(CAST({x} AS DOUBLE[]), CAST({y} AS DOUBLE[]))"
    var = lambda x: f"(4096 * {dot(x, x)} - list_sum({x}) * list_sum({x}))"
    return f"CASE WHEN {var(a)} <= 0 OR {var(b)} <= 0 THEN 0.0 ELSE (4096 * {dot(a, b)} - list_sum({a}) * list_sum({b})) / sqrt({var(a)} * {var(b)}) END"


def _iou(a: str, b: str) -> str:
    count = lambda how: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CASE WHEN {a}[i] >= 128 {how} {b}[i] >= 128 THEN 1 ELSE 0 END))"
    return f"CASE WHEN {count('OR')} = 0 THEN 1.0 ELSE CAST({count('AND')} AS DOUBLE) / {count('OR')} END"


_INVERSE = "[" + ", ".join(str(rasters.ORIENTATIONS.index(rasters.INVERSE[n])) for n in rasters.ORIENTATIONS) + "]"
_NEAR = f"""{_PLANTED}, hs AS (SELECT k, o, {_BITS.format(c='c', q='q')} AS h FROM pl, s),
  nd AS (SELECT a.k AS a, b.k AS b, a.o AS o, {_APART.format(a='a.h', b='b.h')} AS d FROM hs a JOIN hs b ON a.k < b.k AND b.o = 0 WHERE {_APART.format(a='a.h', b='b.h')} <= {DISTANCE}
    UNION ALL SELECT a.k, b.k, {_INVERSE}[b.o + 1], {_APART.format(a='a.h', b='b.h')} FROM hs a JOIN hs b ON a.k < b.k AND a.o = 0 WHERE {_APART.format(a='a.h', b='b.h')} <= {DISTANCE}),
  nm AS (SELECT a, b, o, min(d) AS d FROM nd GROUP BY 1, 2, 3),
  sc AS (SELECT a, b, n.o, d, {_TURNED.format(p='t.p', c='x.c')} AS m, y.c AS c FROM nm n JOIN orient t ON t.o = n.o JOIN pl x ON x.k = n.a JOIN pl y ON y.k = n.b),
  cr AS (SELECT a, b, o, d, {_corr('m', 'c')} AS r, {_iou('m', 'c')} AS iou FROM sc),
  near AS (SELECT a, b, o, d, r, iou FROM cr WHERE round(r, 9) >= {CORRELATION} QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY round(r, 9) DESC, d, o) = 1)"""
_FOUND = "SELECT a, b, {transform} AS transform, CAST(d AS INTEGER) AS distance, round(r, 6) AS correlation, round(iou, 6) AS mask_iou FROM {rows}"


def embeddings(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("c"), "label")


def _wholes(cells):
    return F.transform(cells, lambda v: F.floor(F.abs(v) * WHOLE))


def base(spark, sf_dir):
    """k and c, 64 x 64 byte values that look random but depend on the embedding only."""
    i = np.arange(SIZE * SIZE)
    source, factor = (i // 512) * 8 + (i % 64) // 8, 17 + (i % 8) * 31 + ((i // 64) % 8) * 57

    def grown(m: np.ndarray) -> np.ndarray:
        return (np.take(np.floor(np.abs(m) * WHOLE).astype(np.int64), source, 1) * factor // 1000 % 256).astype(np.int32)

    return embeddings(spark, sf_dir).select("k", kernel(grown, "array<int>", SMALL * SMALL, "c", wide=SIZE * SIZE).alias("c"))


def brighter(cells):
    return kernel(lambda m: np.minimum(m + 2, 255), "array<int>", None, cells)


def planted(spark, sf_dir):
    rows = table(base(spark, sf_dir), "base")
    flipped = rows.where("k % 7 = 0").select((F.col("k") + FLIP).alias("k"), rasters.turned(F.col("c"), "flip_h", SIZE).alias("c"))
    rotated = rows.where("k % 11 = 0").select((F.col("k") + TURN).alias("k"), brighter(rasters.turned(F.col("c"), "rotate_90", SIZE)).alias("c"))
    return rows.unionByName(flipped).unionByName(rotated)


# ---- one raster at a time -----------------------------------------------------------------------------------------------

_AT = "list_filter(range(64), lambda i: c[i + 1] > 0)"


@query(f"""WITH {_EMB}, a AS (SELECT k, c, {_AT} AS f FROM emb) SELECT k, round(list_min(c), 6) AS min, round(list_max(c), 6) AS max, round(list_sum(c) / 64, 6) AS mean, round(sqrt(greatest(list_dot_product(c, c) / 64 - (list_sum(c) / 64) * (list_sum(c) / 64), 0)), 6) AS sd,
  CAST(len(list_distinct(c)) AS INTEGER) AS distinct_values, CAST(len(f) AS INTEGER) AS foreground, CAST(coalesce(list_min(list_transform(f, lambda i: i % 8)), -1) AS INTEGER) AS min_x, CAST(coalesce(list_max(list_transform(f, lambda i: i % 8)), -1) AS INTEGER) AS max_x,
  CAST(coalesce(list_min(list_transform(f, lambda i: i // 8)), -1) AS INTEGER) AS min_y, CAST(coalesce(list_max(list_transform(f, lambda i: i // 8)), -1) AS INTEGER) AS max_y FROM a""")
def pixel_stats(spark, sf_dir):
    return rounded(rasters.statistics(embeddings(spark, sf_dir).drop("label"), "c", SMALL).drop("c"))


@query(f"WITH {_BASE}, {_ORIENT}, {_PLACES} SELECT k, o AS orientation, {_BITS.format(c='c', q='q')} AS bits FROM base, s WHERE o IN (0, 4)")
def dhash(spark, sf_dir):
    """The sampled hash, as the raster lies and rotated."""
    turned = F.array(*[F.struct(F.lit(rasters.ORIENTATIONS.index(n)).alias("orientation"), images.sampled_hash(F.col("c"), SIZE, n).alias("h")) for n in ("identity", "rotate_90")])
    return base(spark, sf_dir).select("k", F.inline(turned)).select("k", "orientation", images.hash_bits(F.col("h")).alias("bits"))


def _bilinear_sql(cells: str, size: tuple[int, int], target: tuple[int, int]) -> str:
    """Values between cell centres: target place t lies at (t + 0.5) * n / target - 0.5 of the source, held inside."""
    (w, h), (tw, th) = size, target
    pos = lambda t, n, to: f"least(greatest(({t} + 0.5::DOUBLE) * {n} / {to} - 0.5::DOUBLE, 0.0::DOUBLE), {n} - 1.0::DOUBLE)"
    x, y = pos(f"(j % {tw})", w, tw), pos(f"(j // {tw})", h, th)
    x0, y0 = f"CAST(floor({x}) AS INTEGER)", f"CAST(floor({y}) AS INTEGER)"
    x1, y1 = f"least({x0} + 1, {w - 1})", f"least({y0} + 1, {h - 1})"
    cell = lambda yy, xx: f"CAST({cells}[{yy} * {w} + {xx} + 1] AS DOUBLE)"
    row = lambda yy: f"({cell(yy, x0)} + ({cell(yy, x1)} - {cell(yy, x0)}) * ({x} - {x0}))"
    return f"list_transform(range({tw * th}), lambda j: {row(y0)} + ({row(y1)} - {row(y0)}) * ({y} - {y0}))"


_BYTES = f"{_EMB}, px AS (SELECT k, list_transform({_WHOLE}, lambda v: CAST(v % 256 AS INTEGER)) AS c FROM emb)"


def _bytes(spark, sf_dir):
    """k and c, 8 x 8 byte values."""
    return embeddings(spark, sf_dir).select("k", F.transform(_wholes(F.col("c")), lambda v: (v % 256).cast("int")).alias("c"))


@query(f"""WITH {_BYTES}, g AS (SELECT k, list_transform({_bilinear_sql('c', (8, 8), (17, 16))}, lambda v: floor(v + 0.5::DOUBLE)) AS g FROM px)
  SELECT k, list_aggregate(list_transform(range(256), lambda b: CASE WHEN g[(b // 16) * 17 + b % 16 + 1] > g[(b // 16) * 17 + b % 16 + 2] THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM g""")
def dhash_resampled(spark, sf_dir):
    return _bytes(spark, sf_dir).select("k", images.hash_bits(images.resampled_hash(F.col("c"), (SMALL, SMALL))).alias("bits"))


_RGB = f"""{_BYTES}, rgb AS (SELECT k, c AS blue, CASE WHEN k % 5 = 0 THEN c ELSE list_transform(c, lambda v: v * 3 % 256) END AS green, CASE WHEN k % 5 <= 1 THEN c ELSE list_transform(c, lambda v: v // 2) END AS red FROM px)"""


def _interleaved(spark, sf_dir):
    """k and cells as a decoder gives them: blue, green, red of each pixel in turn; every fifth image is gray."""
    green = lambda v, k: F.when(F.col("k") % 5 == 0, v).otherwise(v * 3 % 256)
    red = lambda v, k: F.when(F.col("k") % 5 <= 1, v).otherwise((v / 2).cast("int"))
    return _bytes(spark, sf_dir).select("k", F.flatten(F.transform("c", lambda v: F.array(v, green(v, 0), red(v, 0)))).alias("cells"))


def _sd(c: str) -> str:
    return f"round(sqrt(greatest(list_dot_product(CAST({c} AS DOUBLE[]), CAST({c} AS DOUBLE[])) / 64 - (list_sum({c}) / 64.0::DOUBLE) * (list_sum({c}) / 64.0::DOUBLE), 0)), 6)"


@query(f"WITH {_RGB} SELECT k, " + ", ".join(f"list_min({c}) AS {c}_min, list_max({c}) AS {c}_max, {_sd(c)} AS {c}_sd" for c in images.CHANNELS)
       + ", red = green AS red_green_equal, red = blue AS red_blue_equal, green = blue AS green_blue_equal, red = green AND red = blue AND green = blue AS gray FROM rgb")
def channel_statistics(spark, sf_dir):
    rgb = _interleaved(spark, sf_dir).select("k", *[v.alias(n) for n, v in images.split_channels(F.col("cells")).items()])
    return rounded(images.channel_statistics(rgb).withColumn("gray", images.gray_equivalent()).drop(*images.CHANNELS))


@query(f"WITH {_RGB} SELECT k, list_aggregate(list_transform(range(1, 65), lambda i: CAST((299 * red[i] + 587 * green[i] + 114 * blue[i] + 500) // 1000 AS VARCHAR)), 'string_agg', ',') AS luma FROM rgb")
def integer_luma(spark, sf_dir):
    rgb = _interleaved(spark, sf_dir).select("k", *[v.alias(n) for n, v in images.split_channels(F.col("cells")).items()])
    cells = F.transform(F.arrays_zip(*images.CHANNELS), lambda p: rasters.luma(p["red"], p["green"], p["blue"]))
    return rgb.select("k", F.array_join(cells, ",").alias("luma"))


_W, _H, _LEFT, _TOP = images.letterbox_geometry((8, 5), 12)
_INSIDE = f"j % 12 >= {_LEFT} AND j % 12 < {_LEFT + _W} AND j // 12 >= {_TOP} AND j // 12 < {_TOP + _H}"
_INNER = f"(j // 12 - {_TOP}) * {_W} + j % 12 - {_LEFT} + 1"


@query(f"""WITH {_BYTES}, g AS (SELECT k, {_bilinear_sql('c', (8, 5), (_W, _H))} AS g, list_transform(range({_W * _H}), lambda j: CASE WHEN c[((2 * (j // {_W}) + 1) * 5 // {2 * _H}) * 8 + (2 * (j % {_W}) + 1) * 8 // {2 * _W} + 1] >= 128 THEN 255 ELSE 0 END) AS m FROM px)
  SELECT k, list_aggregate(list_transform(range(144), lambda j: CASE WHEN {_INSIDE} THEN CAST(CAST(floor(g[{_INNER}] + 0.5::DOUBLE) AS INTEGER) AS VARCHAR) ELSE '0' END), 'string_agg', ',') AS image,
  list_aggregate(list_transform(range(144), lambda j: CASE WHEN {_INSIDE} THEN CAST(m[{_INNER}] AS VARCHAR) ELSE '0' END), 'string_agg', ',') AS mask FROM g""")
def letterbox_pixels(spark, sf_dir):
    """Rasters of 8 x 5, brought into a square of 12."""
    cells = F.slice("c", 1, 40)
    return _bytes(spark, sf_dir).select("k", F.array_join(images.letterboxed(cells, (8, 5), 12), ",").alias("image"), F.array_join(images.letterboxed(cells, (8, 5), 12, mask=True), ",").alias("mask"))


@query(f"""WITH {_BYTES}, m AS (SELECT k, list_transform(c, lambda v: CASE WHEN k % 7 = 0 THEN v WHEN v >= 32 * (k % 9) THEN 255 ELSE 0 END) AS m, CASE WHEN k % 13 = 0 THEN 9 ELSE 8 END AS w, CASE WHEN k % 17 = 0 THEN 24 ELSE 8 END AS bits FROM px),
  p AS (SELECT k, unnest([CASE WHEN w <> 8 THEN 'unexpected_size' END, CASE WHEN bits <> 8 THEN 'unexpected_bit_depth' END, CASE WHEN len(list_filter(m, lambda v: v NOT IN (0, 255))) > 0 THEN 'mask_not_binary' END,
    CASE WHEN len(list_filter(m, lambda v: v >= 128)) = 0 THEN 'no_foreground' END, CASE WHEN len(list_filter(m, lambda v: v >= 128)) = 64 THEN 'no_background' END]) AS problem FROM m)
  SELECT k, problem FROM p WHERE problem IS NOT NULL""")
def conversion_check(spark, sf_dir):
    mask = F.transform("c", lambda v: F.when(F.col("k") % 7 == 0, v).when(v >= 32 * (F.col("k") % 9), 255).otherwise(0).cast("int"))
    width, bits = F.when(F.col("k") % 13 == 0, 9).otherwise(8), F.when(F.col("k") % 17 == 0, 24).otherwise(8)
    pairs = _bytes(spark, sf_dir).withColumn("m", mask)
    return pairs.select("k", F.explode(images.conversion_problems(F.col("c"), F.col("m"), width, F.lit(8), bits, SMALL)).alias("problem"))


@query(f"WITH {_BYTES}, g AS (SELECT k, list_transform({_bilinear_sql('c', (8, 8), (6, 4))}, lambda v: (v / 255.0::DOUBLE - 0.5::DOUBLE) / 0.25::DOUBLE) AS g FROM px) SELECT k, unnest(range(24)) AS place, round(unnest(g), 6) AS value FROM g")
def resize_normalise(spark, sf_dir):
    cells = images.normalised(images.resized_bilinear(F.col("c"), (SMALL, SMALL), (6, 4)), 0.5, 0.25)
    return rounded(_bytes(spark, sf_dir).select("k", F.posexplode(cells).alias("place", "value"))).withColumn("place", F.col("place").cast("long"))


_SHARE = "CAST('0x' || substr(sha256('42|' || k), {at}, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"""WITH {_BYTES}, s AS (SELECT k, c, {_SHARE.format(at=1)} AS flip, 0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * ({_SHARE.format(at=9)}) AS e FROM px),
  t AS (SELECT k, e, CASE WHEN flip < 0.5 THEN list_transform(range(64), lambda j: c[(j // 8) * 8 + 7 - j % 8 + 1]) ELSE c END AS c FROM s)
  SELECT k, list_aggregate(list_transform(c, lambda v: CAST(CAST(round_even(255.0::DOUBLE * pow(v / 255.0::DOUBLE, e), 0) AS INTEGER) AS VARCHAR)), 'string_agg', ',') AS cells FROM t""")
def augmented_cells(spark, sf_dir):
    return images.augmented(_bytes(spark, sf_dir), "c", SMALL, "k", 42, flip=0.5, gamma=0.2).select("k", F.array_join("c", ",").alias("cells"))


def _mix(x: str) -> str:
    """The finaliser in SQL, step by step through nested lists, so that no step is written twice."""
    step = lambda inner, shift, factor: f"list_transform({inner}, lambda a: xor(a, a >> {shift}) * {factor}::UBIGINT % 4294967296::UBIGINT)"
    return f"list_transform({step(step(f'[CAST({x} AS UBIGINT)]', 16, 2246822507), 13, 3266489909)}, lambda a: xor(a, a >> 16))[1]"


def _uniform(stream: int) -> str:
    return f"(({_mix(f'({_mix(f'xor(seed, {stream})')} + 2654435769::UBIGINT * (j + 1)) % 4294967296::UBIGINT')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


_DRAW = "CAST('0x' || substr(sha256('7|' || k), {at}, 8) AS BIGINT)"
_DRAWS = ", ".join(f"{_DRAW.format(at=8 * k + 1)} AS {n}" for k, n in enumerate(("flip", "bend", "angle", "light", "spread", "blur", "noise", "seed")))
_HOW = images.Augmentation(flip=0.5, rotation=15.0, brightness=0.2, contrast=0.3, gamma=0.2, blur=0.4, blur_radius=0.75, noise=0.6, noise_sd=0.02)
_SOURCE_X, _SOURCE_Y = "cos(turn) * ((j % 8) + 0.5::DOUBLE - 4) - sin(turn) * ((j // 8) + 0.5::DOUBLE - 4) + 4", "sin(turn) * ((j % 8) + 0.5::DOUBLE - 4) + cos(turn) * ((j // 8) + 0.5::DOUBLE - 4) + 4"
_WEIGHTS = [math.exp(-((k / 0.75) ** 2) / 2) for k in range(-3, 4)]
_BLUR = lambda c, place: f"list_sum(list_transform(range(7), lambda t: [{', '.join(repr(w / sum(_WEIGHTS)) for w in _WEIGHTS)}][t + 1]::DOUBLE * {c}[{place} + 1]))"
_PAIR = f"""{_BYTES}, a AS (SELECT k, c, list_transform(c, lambda v: CASE WHEN v >= 100 THEN 255 ELSE 3 END) AS m, {_DRAWS} FROM px),
  b AS (SELECT *, radians((2 * (angle / 4294967296.0::DOUBLE) - 1) * 15) AS turn, CASE WHEN flip / 4294967296.0::DOUBLE < 0.5 THEN list_transform(range(64), lambda j: c[(j // 8) * 8 + 8 - j % 8]) ELSE c END AS fc,
    CASE WHEN flip / 4294967296.0::DOUBLE < 0.5 THEN list_transform(range(64), lambda j: m[(j // 8) * 8 + 8 - j % 8]) ELSE m END AS fm FROM a),
  q AS (SELECT *, list_transform(range(64), lambda j: {_SOURCE_X}) AS sx, list_transform(range(64), lambda j: {_SOURCE_Y}) AS sy FROM b),
  i AS (SELECT *, list_transform(range(1, 65), lambda j: sx[j] >= 0 AND sx[j] < 8 AND sy[j] >= 0 AND sy[j] < 8) AS inside, list_transform(sx, lambda v: least(greatest(v - 0.5::DOUBLE, 0), 7)) AS px, list_transform(sy, lambda v: least(greatest(v - 0.5::DOUBLE, 0), 7)) AS py FROM q),
  f AS (SELECT *, list_transform(px, lambda v: CAST(floor(v) AS INTEGER)) AS x0, list_transform(py, lambda v: CAST(floor(v) AS INTEGER)) AS y0 FROM i),
  g AS (SELECT *, list_transform(range(1, 65), lambda j: [fc[y0[j] * 8 + x0[j] + 1], fc[y0[j] * 8 + least(x0[j] + 1, 7) + 1], fc[least(y0[j] + 1, 7) * 8 + x0[j] + 1], fc[least(y0[j] + 1, 7) * 8 + least(x0[j] + 1, 7) + 1]]::DOUBLE[]) AS four FROM f),
  h AS (SELECT *, list_transform(range(1, 65), lambda j: [four[j][1] + (four[j][2] - four[j][1]) * (px[j] - x0[j]), four[j][3] + (four[j][4] - four[j][3]) * (px[j] - x0[j])]) AS two FROM g),
  r AS (SELECT *, list_transform(range(1, 65), lambda j: CASE WHEN inside[j] THEN floor(two[j][1] + (two[j][2] - two[j][1]) * (py[j] - y0[j])) ELSE 0 END) AS rc,
    list_transform(range(1, 65), lambda j: CASE WHEN inside[j] THEN fm[CAST(least(floor(sy[j]), 7) AS INTEGER) * 8 + CAST(least(floor(sx[j]), 7) AS INTEGER) + 1] ELSE 3 END) AS rm FROM h),
  l AS (SELECT *, list_transform(rc, lambda v: floor(least(v * (1.0::DOUBLE - 0.2::DOUBLE + 2 * 0.2::DOUBLE * (light / 4294967296.0::DOUBLE)), 255))) AS lc FROM r),
  s AS (SELECT *, floor(list_sum(lc) / 64 + 0.5::DOUBLE) AS middle FROM l),
  t AS (SELECT *, list_transform(lc, lambda v: floor(least(greatest(middle + (v - middle) * (1.0::DOUBLE - 0.3::DOUBLE + 2 * 0.3::DOUBLE * (spread / 4294967296.0::DOUBLE)), 0), 255))) AS tc FROM s),
  u AS (SELECT *, list_transform(tc, lambda v: round_even(255.0::DOUBLE * pow(v / 255.0::DOUBLE, 0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * (bend / 4294967296.0::DOUBLE)), 0)) AS uc FROM t),
  v AS (SELECT *, list_transform(range(64), lambda j: {_BLUR('uc', '(j // 8) * 8 + least(greatest(j % 8 + t - 3, 0), 7)')}) AS vc FROM u),
  w AS (SELECT *, CASE WHEN blur / 4294967296.0::DOUBLE < 0.4 THEN list_transform(range(64), lambda j: floor({_BLUR('vc', 'least(greatest(j // 8 + t - 3, 0), 7) * 8 + j % 8')} + 0.5::DOUBLE)) ELSE uc END AS wc FROM v),
  z AS (SELECT *, list_transform(range(64), lambda j: least(greatest(wc[j + 1] / 255.0::DOUBLE + CASE WHEN noise / 4294967296.0::DOUBLE < 0.6 THEN 0.02::DOUBLE * (sqrt(-2 * ln({_uniform(0)})) * cos(2 * pi() * {_uniform(1)})) ELSE 0.0 END, 0), 1)) AS zc FROM w)"""


@query(f"WITH {_PAIR} SELECT k, unnest(range(64)) AS place, round(unnest(zc), 6) AS value, CAST(unnest(rm) AS INTEGER) AS mask FROM z")
def augmented_pairs(spark, sf_dir):
    """Images and masks through every step of the augmentation."""
    mask = F.transform("c", lambda v: F.when(v >= 100, 255).otherwise(3).cast("int"))
    pairs = images.augmented_pairs(_bytes(spark, sf_dir).withColumn("m", mask), "c", "m", (SMALL, SMALL), "k", 7, _HOW)
    cells = pairs.select("k", F.posexplode(F.arrays_zip(F.col("c").alias("value"), F.col("m").alias("mask"))).alias("place", "x"))
    return cells.select("k", F.col("place").cast("long").alias("place"), F.round("x.value", 6).alias("value"), "x.mask")


_AT512 = "c[(least(511, (j // 17) * 512 // 16 + 16) // 8) * 64 + least(511, (j % 17) * 512 // 17 + 15) // 8 + 1]"


@query(f"""WITH {_BASE}, s AS (SELECT k, c, list_transform(range(272), lambda j: {_AT512}) AS s FROM base)
  SELECT k, list_aggregate(list_transform(range(256), lambda b: CASE WHEN s[(b // 16) * 17 + b % 16 + 1] > s[(b // 16) * 17 + b % 16 + 2] THEN '1' ELSE '0' END), 'string_agg', '') AS bits,
    list_min(c) AS min, list_max(c) AS max, round(list_sum(c) / 4096, 6) AS mean, CAST(64 * len(list_filter(c, lambda v: v >= 128)) AS INTEGER) AS foreground FROM s""")
def rasters_512(spark, sf_dir):
    """Hashes and statistics of rasters of 512 x 512 cells, each row's raster at eight times its size."""
    rows = base(spark, sf_dir).withColumn("bits", images.hash_bits(images.sampled_hash(F.col("c"), 512, source=(SIZE, SIZE))))
    found = rasters.statistics(rows, "c", 512, foreground=127, source=(SIZE, SIZE))
    return found.select("k", "bits", F.col("min").cast("int").alias("min"), F.col("max").cast("int").alias("max"), F.round("mean", 6).alias("mean"), "foreground")


@query(f"""WITH {_EMB}, p AS (SELECT k, list_transform(c, lambda v: CAST(round_even(abs(v) / (1 + abs(v)) * 255, 0) AS INTEGER)) AS c FROM emb), g AS (SELECT k, {_bilinear_sql('c', (8, 8), (10, 6))} AS g FROM p)
  SELECT k, list_aggregate(list_transform(g, lambda v: CASE WHEN floor(v + 0.5::DOUBLE) >= 26 THEN '255' ELSE '0' END), 'string_agg', ',') AS mask FROM g""")
def predicted_masks(spark, sf_dir):
    p = F.transform("c", lambda v: F.abs(v) / (1 + F.abs(v)))
    return embeddings(spark, sf_dir).select("k", F.array_join(images.predicted_mask(p, (SMALL, SMALL), (10, 6), 0.1), ",").alias("mask"))


_SEEN = f"""{_BYTES}, g AS (SELECT k, c, list_transform({_bilinear_sql('q', (4, 4), (8, 8))}, lambda v: v >= 0.5::DOUBLE) AS p FROM (SELECT *, list_transform(c[1:16], lambda v: v / 255.0::DOUBLE) AS q FROM px)),
  x AS (SELECT k, unnest(c) AS v, unnest(list_transform(c, lambda v: v % 3 = 0)) AS t, unnest(p) AS p FROM g)"""
_SHOWN = "CASE WHEN t OR p THEN CAST(floor(0.45::DOUBLE * v + (1 - 0.45::DOUBLE) * CASE WHEN p AND t THEN {hit} WHEN p THEN {alarm} ELSE {miss} END) AS INTEGER) ELSE v END"
_SUMS = ", ".join(f"CAST(sum(v + CASE WHEN t THEN 255 ELSE 0 END + CASE WHEN p THEN 255 ELSE 0 END + {_SHOWN.format(hit=charts.HIT[k], alarm=charts.ALARM[k], miss=charts.MISS[k])}) AS BIGINT) AS {c}" for k, c in enumerate(images.CHANNELS))


@query(f"WITH {_SEEN} SELECT k, {_SUMS} FROM x GROUP BY k")
def comparison_files(spark, sf_dir):
    """Image, truth, prediction and overlay of each row side by side in a file, decoded again: the sums of the channels."""
    mask = kernel(lambda m: np.where(m % 3 == 0, 255, 3), "array<int>", None, "c")
    chance = kernel(lambda m: m[:, :16] / 255.0, "array<double>", SMALL * SMALL, "c")
    samples = _bytes(spark, sf_dir).select(F.concat(F.lit("s"), "k", F.lit(".png")).alias("path"), F.col("c").alias("image"), mask.alias("mask"), chance.alias("probability"))
    root = new_path(spark, "comparisons")
    write_files(charts.comparison_files(samples, (SMALL, SMALL), (4, 4)), root)
    seen = files.with_cells(files.read_pngs(spark, root)).select(F.regexp_extract("path", r"s(\d+)\.png$", 1).cast("long").alias("k"), "cells")
    total = kernel(lambda m: m.reshape(len(m), -1, 3).sum(1), "array<bigint>", None, "cells")  # a decoder gives blue, green, red
    return seen.select("k", total.alias("s")).select("k", F.get("s", 2).alias("red"), F.get("s", 1).alias("green"), F.get("s", 0).alias("blue"))


# ---- pairs --------------------------------------------------------------------------------------------------------------


@query(f"WITH {_PLANTED}, h AS (SELECT k, {_BITS.format(c='c', q='q')} AS h FROM pl, s WHERE o = 0) SELECT a.k AS a, b.k AS b, CAST({_APART.format(a='a.h', b='b.h')} AS INTEGER) AS distance FROM h a JOIN h b ON a.k < b.k AND {_APART.format(a='a.h', b='b.h')} <= 100")
def hamming_pairs(spark, sf_dir):
    """All pairs of rows within 100 of 256 bits, which no pair of unlike rows reaches often: no band is selective, so blocks meet."""
    h = planted(spark, sf_dir).select("k", images.sampled_hash(F.col("c"), SIZE).alias("h"))
    return near.hamming_within(h, "k", "h", 100)


@query(f"""WITH {_BASE}, {_ORIENT}, {_PLACES}, ws AS (SELECT k, c FROM base WHERE k % 4 = 0 AND list_min(c) < list_max(c)), w AS (SELECT k, {_BITS.format(c='c', q='q')} AS h, c FROM ws, s WHERE o = 0)
  SELECT k AS a, k + n * 1000000 AS b, 0 AS distance FROM w, (SELECT unnest([1, 2, 3]) AS n)
  UNION ALL SELECT a.k, b.k, CAST({_APART.format(a='a.h', b='b.h')} AS INTEGER) FROM w a JOIN w b ON a.k < b.k AND {_APART.format(a='a.h', b='b.h')} <= {DISTANCE} AND {_corr('a.c', 'b.c')} >= {CORRELATION}""")
def near_links(spark, sf_dir):
    """Every fourth raster four times over: a link for each copy, and the near pairs of what differs."""
    rows = table(base(spark, sf_dir).where("k % 4 = 0"), "base")
    copies = rows.select("k", "c", F.explode(F.array(*[F.lit(n * 1_000_000) for n in range(4)])).alias("n")).select((F.col("k") + F.col("n")).alias("k"), "c")
    return near.near_links(copies, "k", "c", SIZE, DISTANCE, CORRELATION, orientations=("identity",)).select("a", "b", "distance")


@query(f"WITH {_PLANTED}, both_ AS (SELECT k, {_BRIGHTER.format(c='c')} AS c FROM pl UNION ALL SELECT k + 5000000, c FROM pl), h AS (SELECT k, {_BITS.format(c='c', q='q')} AS h FROM both_, s WHERE o = 0) SELECT a.k AS a, b.k AS b, CAST({_APART.format(a='a.h', b='b.h')} AS INTEGER) AS distance FROM h a JOIN h b ON a.k < b.k AND {_APART.format(a='a.h', b='b.h')} <= {DISTANCE}")
def near_hashes(spark, sf_dir):
    """Pairs within the distance of near duplicates, found by bands."""
    rows = planted(spark, sf_dir)
    bright = rows.select("k", brighter("c").alias("c"))
    return near.hash_pairs(bright.unionByName(rows.withColumn("k", F.col("k") + 5_000_000)), "k", "c", SIZE, DISTANCE)


@query(f"WITH {_NEAR} " + _FOUND.format(transform="(SELECT name FROM orient t WHERE t.o = near.o)", rows="near"))
def near_dup_oriented(spark, sf_dir):
    return rounded(near.near_pairs(planted(spark, sf_dir), "k", "c", SIZE, DISTANCE, CORRELATION))


_H0 = _BITS.format(c="c", q="q")


@query(f"""WITH {_PLANTED}, bl AS (SELECT k, c, k % 3 AS g FROM base UNION ALL SELECT k + {FLIP}, {_BRIGHTER.format(c='c')}, k % 3 FROM base WHERE k % 5 = 0), h AS (SELECT bl.*, {_H0} AS h FROM bl, s WHERE o = 0),
  p AS (SELECT a.k AS a, b.k AS b, {_APART.format(a='a.h', b='b.h')} AS d, a.c AS m, b.c AS c FROM h a JOIN h b ON a.g = b.g AND a.k < b.k AND {_APART.format(a='a.h', b='b.h')} <= 8),
  r AS (SELECT a, b, d, {_corr('m', 'c')} AS r, {_iou('m', 'c')} AS iou FROM p) """ + _FOUND.format(transform="'identity'", rows="r WHERE round(r, 9) >= 0.98"))  # fmt: skip
def near_dup_blocked(spark, sf_dir):
    rows = base(spark, sf_dir)
    copies = rows.where("k % 5 = 0").select((F.col("k") + FLIP).alias("k"), brighter("c").alias("c"), (F.col("k") % 3).alias("g"))
    return rounded(near.near_pairs(rows.withColumn("g", F.col("k") % 3).unionByName(copies), "k", "c", SIZE, 8, 0.98, ("g",), ("identity",)))


@query(f"""WITH {_PLANTED}, h AS (SELECT base.*, {_H0} AS h FROM base, s WHERE o = 0), w AS (SELECT k, {_BRIGHTER.format(c='c')} AS c FROM base WHERE k % 3 = 0), i AS (SELECT w.*, {_H0} AS h FROM w, s WHERE o = 0),
  p AS (SELECT a.k AS a, b.k AS b, {_APART.format(a='a.h', b='b.h')} AS d, a.c AS m, b.c AS c FROM h a JOIN i b ON {_APART.format(a='a.h', b='b.h')} <= {DISTANCE}),
  r AS (SELECT a, b, d, {_corr('m', 'c')} AS r, {_iou('m', 'c')} AS iou FROM p) """ + _FOUND.format(transform="'identity'", rows=f"r WHERE round(r, 9) >= {CORRELATION}"))  # fmt: skip
def near_dup_across(spark, sf_dir):
    """Two sets, the second a brighter copy of each third row of the first."""
    rows = base(spark, sf_dir)
    return rounded(near.near_across(rows, rows.where("k % 3 = 0").select("k", brighter("c").alias("c")), "k", "c", SIZE, DISTANCE, CORRELATION))


@query(f"""WITH {_NEAR}, q AS (SELECT *, list_transform(range(1, 4097), lambda i: m[i] - c[i]) AS e FROM (SELECT n.a, n.b, n.o, n.d, s.m, s.c FROM near n JOIN sc s ON s.a = n.a AND s.b = n.b AND s.o = n.o)),
  v AS (SELECT a, b, (SELECT name FROM orient t WHERE t.o = q.o) AS transform, {_corr('m', 'c')} AS r, list_sum(list_transform(e, lambda x: abs(x))) / 4096.0::DOUBLE AS mae, list_sum(list_transform(e, lambda x: x * x)) / 4096.0::DOUBLE AS mse, {_iou('m', 'c')} AS iou,
    CAST(len(list_filter(e, lambda x: x <> 0)) AS BIGINT) AS image_mismatch, CAST(len(list_filter(range(1, 4097), lambda i: (m[i] >= 128) <> (c[i] >= 128))) AS BIGINT) AS mask_mismatch FROM q)
  SELECT a, b, transform, round(r, 6) AS full_correlation, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse, CASE WHEN mse > 0 THEN round(10 * log10(65025.0 / mse), 6) END AS psnr, round(iou, 6) AS full_mask_iou, image_mismatch, mask_mismatch,
  r >= 0.998 AND mae <= 3.0 AS strong, r >= 0.98 AND iou >= 0.90 AS likely FROM v""")
def verify_pairs(spark, sf_dir):
    rows = planted(spark, sf_dir)
    pairs = near.near_pairs(rows, "k", "c", SIZE, DISTANCE, CORRELATION).select("a", "b", "transform")
    verified = rasters.verify_pairs(pairs, rows, "k", "c", SIZE, foreground=128)
    ruled = verified.withColumns({"strong": rasters.strong_duplicate(), "likely": rasters.likely_duplicate()})
    return rounded(ruled.withColumn("psnr", F.when(F.col("psnr") < float("inf"), F.col("psnr"))))


_CC = f"""WITH RECURSIVE {_NEAR}, ed AS (SELECT a, b FROM near UNION SELECT b, a FROM near), rc(id, r) AS (SELECT a, a FROM ed UNION SELECT ed.b, rc.r FROM rc JOIN ed ON ed.a = rc.id), cc AS (SELECT id, min(r) AS component FROM rc GROUP BY id)"""


def _components(spark, sf_dir, rows=None):
    rows = planted(spark, sf_dir) if rows is None else rows
    return components.connected_components(near.near_pairs(rows, "k", "c", SIZE, DISTANCE, CORRELATION), "a", "b")


@query(f"{_CC} SELECT id, component FROM cc", name="components")
def near_components(spark, sf_dir):
    return _components(spark, sf_dir)


@query(f"{_CC} SELECT size, count(*) AS components FROM (SELECT component, count(*) AS size FROM cc GROUP BY 1) GROUP BY 1")
def component_sizes(spark, sf_dir):
    return audit.component_sizes(_components(spark, sf_dir))


@query(f"""{_CC}, mi AS (SELECT a.component, min({_iou('x.c', 'y.c')}) AS min_iou FROM cc a JOIN cc b ON a.component = b.component AND a.id < b.id JOIN pl x ON x.k = a.id JOIN pl y ON y.k = b.id GROUP BY 1)
  SELECT id, cc.component, CASE WHEN min_iou < 0.95 THEN 'mask_conflict' WHEN id <> cc.component THEN 'duplicate_redundant' END AS reason FROM cc JOIN mi USING (component)""")
def resolve_near_duplicates(spark, sf_dir):
    """By the plain mask IoU of all pairs of members, not of matched edges only."""
    rows = table(planted(spark, sf_dir), "planted")
    members = table(_components(spark, sf_dir, rows), "members")
    least = resolve.least_member_iou(members, rows, "k", "c", foreground=127)
    return resolve.resolve(members.withColumn("label", F.lit(1)), "id", "label", [], least).select("id", "component", "reason")


_SECOND = "SELECT p_partkey AS id, p_brand AS label, sha256(p_type || '|' || (p_size % 10)) AS h FROM part"


@query(f"""WITH p AS ({_SECOND}), g AS (SELECT h, min(id) AS component, count(*) AS n, count(DISTINCT label) AS l FROM p GROUP BY h)
  SELECT id, component, CASE WHEN n > 1 AND l > 1 THEN 'post_normalization_label_conflict' WHEN n > 1 AND id <> component THEN 'post_normalization_duplicate_redundant' END AS reason FROM p JOIN g USING (h)""")
def resolve_second_pass(spark, sf_dir):
    """The policy again, over what normalisation made equal."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.sha2(F.concat_ws("|", "p_type", (F.col("p_size") % 10).cast("string")), 256).alias("h"))
    members = rows.join(rows.groupBy("h").agg(F.min("id").alias("component")), "h")
    return resolve.resolve(members, "id", "label", [], prefix="post_normalization_").select("id", "component", "reason")


@query("""WITH p AS (SELECT p_partkey, p_size * 7 + 3 AS w, p_size * 3 + 11 AS h FROM part), s AS (SELECT *, least(256.0 / w, 256.0 / h) AS f FROM p), e AS (SELECT *, w * f AS a, h * f AS b FROM s),
  r AS (SELECT p_partkey, CAST(greatest(round_even(a, 0), 1) AS INTEGER) AS scaled_width, CAST(greatest(round_even(b, 0), 1) AS INTEGER) AS scaled_height FROM e)
  SELECT *, (256 - scaled_width) // 2 AS offset_x, (256 - scaled_height) // 2 AS offset_y FROM r""")
def letterbox(spark, sf_dir):
    box = rasters.letterbox(F.col("p_size") * 7 + 3, F.col("p_size") * 3 + 11, 256)
    return read(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in box.items()])
