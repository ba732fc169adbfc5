"""PNG files of 8-bit rasters, as bytes: gray or RGB are written; RGBA is read too."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_START = b"\x89PNG\r\n\x1a\n"


def encode(cells: bytes, width: int, height: int, channels: int = 1) -> bytes:
    """A PNG of ``cells``, row by row, red, green and blue in turn where there are three channels."""
    if len(cells) != width * height * channels:
        raise ValueError(f"{len(cells)} values for {width} x {height} x {channels}")
    row = width * channels
    raw = b"".join(b"\0" + cells[k * row : (k + 1) * row] for k in range(height))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return _START + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """The values of rows of which each begins with the number of its filter; ``step`` values are a pixel."""
    if not lines[:, 0].any():
        return lines[:, 1:]
    out = np.zeros((len(lines) + 1, step + lines.shape[1] - 1), np.uint8)  # a row above and a pixel to the left are zero
    for k, line in enumerate(lines):
        kind, above, row = line[0], out[k], out[k + 1]
        if kind > 4:
            raise ValueError(f"filter {kind} in a PNG")
        row[step:] = line[1:] + above[step:] if kind == 2 else line[1:]
        for at in range(step, len(row) if kind in (1, 3, 4) else 0):
            left, up, corner = int(row[at - step]), int(above[at]), int(above[at - step])
            near = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
            row[at] = (int(row[at]) + (left, 0, (left + up) // 2, near)[kind - 1]) % 256
    return out[1:, step:]


def decode(content: bytes) -> tuple[int, int, int, bytes] | None:
    """Width, height, channels and cells in the order of Spark's image source (gray; blue, green, red, alpha); None for what
    isn't a PNG.  A damaged one is an error, and so is a kind that isn't read: other depths, palettes, interlaced rows."""
    if not content.startswith(_START):
        return None
    at, head, data = len(_START), b"", []
    while True:
        if len(content) < at + 12:
            raise ValueError("a PNG that ends too early")
        (size,), kind = struct.unpack_from(">I", content, at), content[at + 4 : at + 8]
        body, check = content[at + 8 : at + 8 + size], content[at + 8 + size : at + 12 + size]
        if check != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a PNG whose check sum differs")
        at += 12 + size
        if kind == b"IEND":
            break
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tRNS":
            raise ValueError("a PNG with a transparent colour isn't read")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError(f"a PNG of depth {depth}, colour type {colour}, interlace {interlaced} isn't read")
    cells = _unfiltered(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels), channels)
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    return width, height, channels, cells.tobytes() if channels == 1 else cells.reshape(height, width, channels)[:, :, order].tobytes()


def with_png(images: DataFrame, cells: str, width: int, height: int, channels: int = 1, name: str = "png") -> DataFrame:
    """``images`` with a column of PNG bytes made of an array column of values from 0 to 255."""
    columns, place = images.columns, images.columns.index(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [None if c is None else encode(bytes(c), width, height, channels) for c in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files, pa.binary())], [*columns, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema] + [f"{name} binary"])
    return images.mapInArrow(run, schema)
