"""Images as arrays of byte values, row by row: channels, resampling, sampled hashes, normal forms, augmentation, masks.

Sizes are parameters, so which source cells a target cell needs is worked out once a process; the work is done by kernels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.kernels import bilinear, blurred, difference_words, kernel, nearest_places, normal, population_sd, rotated, turns

CHANNELS = ("red", "green", "blue")
#: Samples of the 256-bit hash: rows, and comparisons in a row.
HASH_ROWS = HASH_COLUMNS = 16


# ---- channels ---------------------------------------------------------------------------------------------------------


def split_channels(cells: Column) -> dict[str, Column]:
    """The channels of interleaved cells as decoded images hold them: blue, green, red."""
    return {name: F.filter(cells, lambda _, k: k % 3 == at) for name, at in zip(CHANNELS, (2, 1, 0), strict=True)}


def channel_statistics(images: DataFrame, channels: tuple[str, str, str] = CHANNELS) -> DataFrame:
    """min, max and population SD of each channel column, and whether channels are equal everywhere."""
    out = {}
    for c in channels:
        out |= {f"{c}_min": F.array_min(c), f"{c}_max": F.array_max(c), f"{c}_sd": kernel(population_sd, "double", None, F.col(c))}
    red, green, blue = channels
    for name, (a, b) in {"red_green_equal": (red, green), "red_blue_equal": (red, blue), "green_blue_equal": (green, blue)}.items():
        out[name] = F.col(a) == F.col(b)
    return images.withColumns(out)


def gray_equivalent() -> Column:
    """True where all three channels of :func:`channel_statistics` are equal."""
    return F.col("red_green_equal") & F.col("red_blue_equal") & F.col("green_blue_equal")


# ---- resampling -------------------------------------------------------------------------------------------------------


def resized_nearest(cells: Column, size: tuple[int, int], target: tuple[int, int]) -> Column:
    """Nearest cells, by cell centres; sizes are (width, height)."""
    return kernel(lambda m: np.take(m, nearest_places(size, target), 1), "array<int>", size[0] * size[1], cells, wide=target[0] * target[1])


def resized_bilinear(cells: Column, size: tuple[int, int], target: tuple[int, int]) -> Column:
    """Bilinear values between cell centres, as doubles; sizes are (width, height)."""
    return kernel(lambda m: bilinear(m, size, target), "array<double>", size[0] * size[1], cells)


def letterbox_geometry(size: tuple[int, int], target: int) -> tuple[int, int, int, int]:
    """Width, height and offsets of a raster scaled into a square and centred; halves round to even."""
    scale = min(target / size[0], target / size[1])
    w, h = (max(1, min(target, round(n * scale))) for n in size)
    return w, h, (target - w) // 2, (target - h) // 2


def letterboxed(cells: Column, size: tuple[int, int], target: int, mask: bool = False) -> Column:
    """Cells of a square with black bars: bilinear values to the nearest byte, of a mask nearest cells as 0 or 255."""
    w, h, left, top = letterbox_geometry(size, target)

    def boxed(m: np.ndarray) -> np.ndarray:
        inner = np.where(m[:, nearest_places(size, (w, h))] >= 128, 255, 0) if mask else np.floor(bilinear(m, size, (w, h)) + 0.5)
        out = np.zeros((len(m), target, target), np.int32)
        out[:, top : top + h, left : left + w] = inner.reshape(-1, h, w)
        return out.reshape(len(m), -1)

    return kernel(boxed, "array<int>", size[0] * size[1], cells)


def conversion_problems(image: Column, mask: Column, width: Column, height: Column, bits: Column, target: int) -> Column:
    """Names of what is wrong with a converted pair; empty if nothing is."""
    foreground = F.size(F.filter(mask, lambda v: v >= 128))
    return F.array_compact(
        F.array(
            F.when((width != target) | (height != target) | (F.size(image) != target * target) | (F.size(mask) != target * target), "unexpected_size"),
            F.when(bits != 8, "unexpected_bit_depth"),
            F.when(F.size(F.array_except(mask, F.array(F.lit(0), F.lit(255)))) > 0, "mask_not_binary"),
            F.when(foreground == 0, "no_foreground"),
            F.when(foreground == F.size(mask), "no_background"),
        )
    )


def normalised(cells: Column, mean: float, sd: float) -> Column:
    """(v / 255 - mean) / sd of every cell."""
    return kernel(lambda m: (m / 255.0 - mean) / sd, "array<double>", None, cells)


def _shares(seed: int, key: str, *places: int) -> list[Column]:
    """Numbers of 32 bits from a digest of seed and key, by their places in it."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * at + 1, 8), 16, 10).cast("long") for at in places]


def augmented(images: DataFrame, cells: str, size: int, key: str, seed: int, flip: float = 0.0, gamma: float = 0.0) -> DataFrame:
    """``images`` flipped left to right with a chance of ``flip`` and brightened by an exponent within ``gamma`` of 1.

    Both are drawn from a digest of seed and key, so runs agree; masks flipped with the same seed and key follow.
    """

    def change(m: np.ndarray, turn: np.ndarray, bend: np.ndarray) -> np.ndarray:
        m = np.where((turn / 2**32 < flip)[:, None], m[:, turns("flip_h", size)], m)
        return bent(m, bend, gamma) if gamma > 0 else m

    return images.withColumn(cells, kernel(change, "array<int>", size * size, F.col(cells), *_shares(seed, key, 0, 1)))


def bent(m: np.ndarray, draw: np.ndarray, gamma: float) -> np.ndarray:
    """Byte values through a table for each row's exponent, drawn within ``gamma`` of 1; halves go to even."""
    low, high = max(1.0 - gamma, 0.1), 1.0 + gamma
    exponents = low + (high - low) * (draw / 2**32)
    return np.round(255.0 * (m / 255.0) ** exponents[:, None])


@dataclass(frozen=True)
class Augmentation:
    """How much training images may change; 0 leaves a step out."""

    flip: float = 0.0
    rotation: float = 0.0
    brightness: float = 0.0
    contrast: float = 0.0
    gamma: float = 0.0
    blur: float = 0.0
    blur_radius: float = 0.75
    noise: float = 0.0
    noise_sd: float = 0.02


def augmented_pairs(pairs: DataFrame, image: str, mask: str, size: tuple[int, int], key: str, seed: int, how: Augmentation) -> DataFrame:
    """``pairs`` with ``image`` as values from 0 to 1 and ``mask`` as byte values, both changed alike where that moves cells.

    In turn: a flip left to right with a chance, a rotation by up to so many degrees either way (bilinear over black; the
    mask by nearest cells over 3, a background value), brightness and contrast by factors about 1 (contrast about the mean
    of the image), an exponent about 1, a blur with a chance, and noise with a chance.  Everything is drawn from a digest of
    seed and key, so a sample changes alike in every run and on every executor; noise is drawn for each cell by a counter.
    """
    w, h = size
    names = ("flip", "bend", "angle", "light", "spread", "blur", "noise", "seed")
    draws = F.array(*_shares(seed, key, *range(len(names))))

    def drawn(numbers: np.ndarray) -> dict[str, np.ndarray]:
        rows = np.stack([np.asarray(x, np.int64) for x in numbers]) if len(numbers) else np.empty((0, len(names)), np.int64)
        return {n: rows[:, k] if n == "seed" else rows[:, k] / 2**32 for k, n in enumerate(names)}

    def moved(m: np.ndarray, d: dict[str, np.ndarray], fill: float, nearest: bool) -> np.ndarray:
        flipped = m.reshape(-1, h, w)[:, :, ::-1].reshape(len(m), -1)
        m = np.where((d["flip"] < how.flip)[:, None], flipped, m)
        return rotated(m, size, (2 * d["angle"] - 1) * how.rotation, fill, nearest) if how.rotation > 0 else m

    def factor(draw: np.ndarray, most: float) -> np.ndarray:
        return (1.0 - most + 2 * most * draw)[:, None]

    def picture(m: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        d = drawn(numbers)
        m = moved(m, d, 0.0, False).astype(np.float64)
        if how.brightness > 0:
            m = np.floor(np.clip(m * factor(d["light"], how.brightness), 0, 255))
        if how.contrast > 0:
            middle = np.floor(m.sum(1) / m.shape[1] + 0.5)[:, None]
            m = np.floor(np.clip(middle + (m - middle) * factor(d["spread"], how.contrast), 0, 255))
        if how.gamma > 0:
            m = bent(m, d["bend"] * 2**32, how.gamma)
        if how.blur > 0:
            m = np.where((d["blur"] < how.blur)[:, None], blurred(m, size, how.blur_radius), m)
        m = m / 255.0
        if how.noise > 0:
            noisy = np.clip(m + how.noise_sd * normal(d["seed"], m.shape[1]), 0.0, 1.0)
            m = np.where((d["noise"] < how.noise)[:, None], noisy, m)
        return m

    return pairs.withColumns(
        {
            image: kernel(picture, "array<double>", w * h, F.col(image), draws),
            mask: kernel(lambda m, numbers: moved(m, drawn(numbers), 3.0, True), "array<int>", w * h, F.col(mask), draws),
        }
    )


def predicted_mask(probability: Column, size: tuple[int, int], original: tuple[int, int], threshold: float = 0.5) -> Column:
    """0 or 255 for each cell at the original size: quantised to bytes, resized, then compared with the quantised threshold.

    This order differs from an evaluation, which compares first.
    """
    least = round(threshold * 255)
    return kernel(lambda m: np.where(np.floor(bilinear(np.round(m * 255), size, original) + 0.5) >= least, 255, 0), "array<int>", size[0] * size[1], probability)


# ---- hashes of 256 bits -----------------------------------------------------------------------------------------------


@lru_cache(64)
def sample_places(size: int, orientation: str = "identity") -> np.ndarray:
    """Where a square raster, turned, is sampled for its hash: 16 rows of 17 places."""
    ys = np.minimum(size - 1, np.arange(HASH_ROWS) * size // 16 + size // 32)
    xs = np.minimum(size - 1, np.arange(HASH_COLUMNS + 1) * size // 17 + size // 34)
    return turns(orientation, size)[(ys[:, None] * size + xs).ravel()]


def sampled_hash(cells: Column, size: int, orientation: str = "identity", source: tuple[int, int] | None = None) -> Column:
    """Difference hash of point samples of a square raster as if it were turned: four longs.

    With ``source``, the cells are a raster of that (width, height), and the hash that of its nearest cells in the square.
    """
    n = source[0] * source[1] if source else size * size
    places = lambda: nearest_places(source, (size, size))[sample_places(size, orientation)] if source else sample_places(size, orientation)
    return kernel(lambda m: difference_words(np.take(m, places(), 1)), "array<bigint>", n, cells)


def resampled_hash(cells: Column, size: tuple[int, int]) -> Column:
    """Difference hash of the raster resized to 17 x 16 bilinearly, in whole gray values."""
    return kernel(lambda m: difference_words(np.floor(bilinear(m, size, (17, 16)) + 0.5)), "array<bigint>", size[0] * size[1], cells)


def hash_bits(words: Column) -> Column:
    """A hash as text, the first comparison first."""
    return F.array_join(F.transform(words, lambda w: F.reverse(F.lpad(F.bin(w), 64, "0"))), "")

