"""Rasters in numpy, an Arrow batch at a time: what an expression would do cell by cell.

A kernel is a function from a matrix (a row for each raster, a column for each cell) to a matrix or one value a row; it
becomes a column function.  Spark bounds the bytes of a batch, and the working copies here are bounded as well.  A null or
a raster with another number of cells gives null.  Tables of places are made once a process, from the raster's size.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that a kernel works on at a time.
CHUNK = 500_000

Kernel = Callable[..., np.ndarray | list]
_TYPES = {"array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _lengths(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and lengths of the rows' cells; a null row has length -1."""
    if pa.types.is_binary(cells.type):
        sizes = cells.cast(pa.large_binary())
        offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    else:
        offsets = cells.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    if cells.null_count:
        lengths = np.where(cells.is_valid().to_numpy(zero_copy_only=False), lengths, -1)
    return offsets[:-1], lengths


def _values(cells: pa.Array) -> np.ndarray:
    if pa.types.is_binary(cells.type):
        buffer = cells.buffers()[2]
        return np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return cells.values.to_numpy(zero_copy_only=False)


def matrix(cells: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
    """The cells of these rows, all of length ``n``."""
    values, (starts, _) = _values(cells), _lengths(cells)
    at = starts[rows]
    if len(rows) and (np.diff(at) == n).all():
        return values[at[0] : at[0] + n * len(rows)].reshape(len(rows), n)
    return values[at[:, None] + np.arange(n)]


def _packed(parts: list, good: np.ndarray, order: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The results of the good rows in their places, null elsewhere; the results come in another order of the rows."""
    n = len(good)
    if not parts:
        return pa.nulls(n, kind)
    if not pa.types.is_list(kind):
        whole = np.concatenate(parts)[order]
        out = np.zeros(n, whole.dtype)
        out[good] = whole
        return pa.array(out, kind, mask=~good)
    if len({p.shape[1] for p in parts}) > 1:
        rows = list(itertools.chain.from_iterable(parts))
        whole = np.concatenate([rows[k] for k in order])
        widths = np.array([len(rows[k]) for k in order])
    else:
        whole = np.concatenate(parts)
        whole = (whole if (np.diff(order) == 1).all() else whole[order]).ravel()
        widths = np.full(len(order), parts[0].shape[1])
    sizes = np.zeros(n, np.int64)
    sizes[good] = widths
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(whole, kind.value_type, safe=False), mask=None if good.all() else pa.array(~good))


def kernel(function: Kernel, kind: str, n: int | None, cells: Column | str, *more: Column | str, rasters: int = 1, wide: int = 0) -> Column:
    """``function`` over rasters of ``n`` cells (None: of any size, those of one size together) as a column of type ``kind``.

    The first ``rasters`` columns are rasters (arrays or binary) and reach the function as matrices; the others as arrays
    with a value for each row, without nulls.  A function that works on more cells of a raster than it is given, as one that
    enlarges it, names their number in ``wide``.
    """
    returned = _TYPES[kind]

    def run(*columns: pa.Array) -> pa.Array:
        sizes = _lengths(columns[0])[1]
        good = sizes >= 0 if n is None else sizes == n
        for c in columns[1:rasters]:
            good &= _lengths(c)[1] == sizes
        for c in columns[rasters:]:
            if c.null_count:
                good &= c.is_valid().to_numpy(zero_copy_only=False)
        rows, parts = np.flatnonzero(good), []
        if n is None:
            rows = rows[np.argsort(sizes[rows], kind="stable")]
        edges = [0, *(np.flatnonzero(np.diff(sizes[rows])) + 1).tolist(), len(rows)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            width = int(sizes[rows[i]]) if j > i else 0
            step = max(1, CHUNK // max(1, width, wide))
            for k in range(i, j, step):
                own = rows[k : min(k + step, j)]
                parts.append(np.asarray(function(*[matrix(c, own, width) for c in columns[:rasters]], *[c.take(pa.array(own)).to_numpy(zero_copy_only=False) for c in columns[rasters:]])))
        return _packed(parts, good, np.argsort(rows, kind="stable"), returned)

    # One function for any number of columns: the types tell Spark that it works on Arrow arrays.
    count = 1 + len(more)
    if count == 1:
        def typed(a: pa.Array) -> pa.Array:
            return run(a)
    elif count == 2:
        def typed(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    else:
        def typed(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)
    return F.arrow_udf(typed, kind)(cells, *more)


def has_null(cells: Column | str) -> Column:
    """Whether an array has a null among its cells; null for a null array."""

    def run(a: pa.Array) -> pa.Array:
        starts, lengths = _lengths(a)
        before = np.r_[0, np.cumsum(a.values.is_null().to_numpy(zero_copy_only=False))]
        return pa.array(before[starts + np.maximum(lengths, 0)] > before[starts], mask=lengths < 0)

    return F.arrow_udf(run, "boolean")(cells)


def as_bits(m: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of longs, a bit for each, filled up with zeros."""
    packed = np.packbits(m, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.int64)


# ---- places and shares ------------------------------------------------------------------------------------------------


@lru_cache(64)
def turns(name: str, size: int) -> np.ndarray:
    """Index of the source cell of each cell of a turned square raster."""
    grid = np.arange(size * size).reshape(size, size)
    turned = {
        "identity": grid, "flip_h": grid[:, ::-1], "flip_v": grid[::-1], "rotate_180": grid[::-1, ::-1], "rotate_90": np.rot90(grid, -1), "rotate_270": np.rot90(grid),
        "transpose": grid.T, "anti_transpose": grid[::-1, ::-1].T,
    }[name]
    return np.ascontiguousarray(turned).ravel()


@lru_cache(64)
def nearest_places(size: tuple[int, int], target: tuple[int, int]) -> np.ndarray:
    (w, h), (tw, th) = size, target
    ys = np.minimum(h - 1, (2 * np.arange(th) + 1) * h // (2 * th))
    xs = np.minimum(w - 1, (2 * np.arange(tw) + 1) * w // (2 * tw))
    return (ys[:, None] * w + xs).ravel()


@lru_cache(64)
def _axis(n: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target place the two source places around its centre and the second one's share."""
    at = np.clip((np.arange(target) + 0.5) * n / target - 0.5, 0.0, n - 1.0)
    low = np.minimum(at.astype(np.int64), n - 1)
    return low, np.minimum(low + 1, n - 1), at - low


def bilinear(cells: np.ndarray, size: tuple[int, int], target: tuple[int, int]) -> np.ndarray:
    """Values between cell centres as doubles, rows first mixed along x."""
    (w, h), (tw, th) = size, target
    x0, x1, fx = _axis(w, tw)
    y0, y1, fy = _axis(h, th)
    grid = cells.reshape(-1, h, w).astype(np.float64)
    along = grid[:, :, x0] + (grid[:, :, x1] - grid[:, :, x0]) * fx
    out = along[:, y0] + (along[:, y1] - along[:, y0]) * fy[:, None]
    return out.reshape(len(cells), -1)


def difference_words(samples: np.ndarray) -> np.ndarray:
    """Four longs of 256 comparisons from rows of 16 x 17 samples: a bit is set where a sample exceeds its right neighbour."""
    grid = samples.reshape(-1, 16, 17)
    bits = (grid[:, :, :-1] > grid[:, :, 1:]).reshape(-1, 256)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<i8")


def population_sd(cells: np.ndarray) -> np.ndarray:
    values, n = cells.astype(np.float64), cells.shape[1]
    if not n:
        return np.full(len(cells), np.nan)
    mean = values.sum(1) / n
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", values, values) / n - mean * mean, 0.0))


# ---- measures ---------------------------------------------------------------------------------------------------------


def correlation(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Pearson correlation row by row in moment form; 0 where either has no variance."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    n = a.shape[1]
    cross = n * np.einsum("ij,ij->i", a, b) - a.sum(1) * b.sum(1)
    va, vb = (n * np.einsum("ij,ij->i", x, x) - x.sum(1) ** 2 for x in (a, b))
    flat = (va <= least) | (vb <= least)
    return np.where(flat, 0.0, cross / np.sqrt(np.where(flat, 1.0, va * vb)))


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of two masks row by row; 1 if both are empty."""
    either = (a | b).sum(1)
    return np.where(either == 0, 1.0, (a & b).sum(1) / np.maximum(either, 1))


def overlap_of_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`overlap` of masks packed by :func:`as_bits`."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    either = np.bitwise_count(a | b).sum(1, dtype=np.int64)
    return np.where(either == 0, 1.0, np.bitwise_count(a & b).sum(1, dtype=np.int64) / np.maximum(either, 1))


# ---- augmentation -----------------------------------------------------------------------------------------------------


def rotated(cells: np.ndarray, size: tuple[int, int], degrees: np.ndarray, fill: float, nearest: bool) -> np.ndarray:
    """Rasters turned counter-clockwise about their middle: each target cell looks up its source by the inverse rotation.

    Sources are cell centres, mixed bilinearly or, with ``nearest``, the nearest one; what lies outside is ``fill``.
    """
    w, h = size
    grid = cells.reshape(-1, h, w)
    y, x = np.meshgrid(np.arange(h) + 0.5 - h / 2, np.arange(w) + 0.5 - w / 2, indexing="ij")
    turn = np.deg2rad(degrees)[:, None, None]
    c, s = np.cos(turn), np.sin(turn)
    sx, sy = c * x - s * y + w / 2, s * x + c * y + h / 2
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    row = np.arange(len(grid))[:, None, None]
    if nearest:
        found = grid[row, np.clip(np.floor(sy), 0, h - 1).astype(np.int64), np.clip(np.floor(sx), 0, w - 1).astype(np.int64)]
        return np.where(inside, found, fill).reshape(len(cells), -1)
    px, py = np.clip(sx - 0.5, 0, w - 1), np.clip(sy - 0.5, 0, h - 1)
    x0, y0 = np.minimum(px.astype(np.int64), w - 1), np.minimum(py.astype(np.int64), h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = px - x0, py - y0
    at = lambda yy, xx: grid[row, yy, xx].astype(np.float64)
    top = at(y0, x0) + (at(y0, x1) - at(y0, x0)) * fx
    low = at(y1, x0) + (at(y1, x1) - at(y1, x0)) * fx
    return np.where(inside, np.floor(top + (low - top) * fy), fill).reshape(len(cells), -1)


def blurred(cells: np.ndarray, size: tuple[int, int], radius: float) -> np.ndarray:
    """Gaussian blur by two passes with a kernel cut at three radii; the border's cells continue outwards."""
    w, h = size
    reach = max(1, int(np.ceil(3 * radius)))
    weights = np.exp(-((np.arange(-reach, reach + 1) / radius) ** 2) / 2)
    weights /= weights.sum()
    grid = cells.reshape(-1, h, w).astype(np.float64)
    for axis, n in ((2, w), (1, h)):
        places = np.clip(np.arange(n)[:, None] + np.arange(-reach, reach + 1), 0, n - 1)
        total = 0.0
        for k, share in enumerate(weights):
            total = total + share * np.take(grid, places[:, k], axis)
        grid = total
    return np.floor(grid + 0.5).reshape(len(cells), -1)


#: The multipliers of a well-known 32-bit finaliser, and a step between counters.
_FIRST, _SECOND, _STEP, _LOW = np.uint64(0x85EBCA6B), np.uint64(0xC2B2AE35), np.uint64(0x9E3779B9), np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """32 bits of each of these, whose order has nothing to do with theirs."""
    x = ((x ^ (x >> np.uint64(16))) * _FIRST) & _LOW
    x = ((x ^ (x >> np.uint64(13))) * _SECOND) & _LOW
    return x ^ (x >> np.uint64(16))


def uniform(seeds: np.ndarray, count: int, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on a row's 32-bit seed, the stream and the cell only, so any batch gives the same."""
    start = _mixed(seeds.astype(np.uint64) ^ np.uint64(stream))
    bits = _mixed((start[:, None] + _STEP * np.arange(1, count + 1, dtype=np.uint64)) & _LOW)
    return (bits.astype(np.float64) + 0.5) / 4294967296.0


def normal(seeds: np.ndarray, count: int) -> np.ndarray:
    """Standard normal numbers of two uniform streams."""
    return np.sqrt(-2 * np.log(uniform(seeds, count, 0))) * np.cos(2 * np.pi * uniform(seeds, count, 1))
