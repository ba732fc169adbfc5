"""Inventories of image and mask files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.png import decode
from quern.sources.rowfiles import place
from quern.storage import BATCH_BYTES, table

#: Names that a task which lists a folder sends on together.
NAMES = 2000


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """Path, length and kind (whether a folder) of what lies in a folder; a local one is read as a stream."""
    store, path = place(folder)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for e in found:
                if not _hidden(e.name):
                    yield f"{folder}/{e.name}", e.stat().st_size, e.is_dir()
    else:
        for e in store.get_file_info(fs.FileSelector(path)):
            if not _hidden(e.base_name):
                yield f"{folder}/{e.base_name}", e.size or 0, e.type == fs.FileType.Directory


def listed(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """path and length of the files below ``root``, which may be where :func:`write_files` writes, and their number.

    Tasks list the folders, level by level, and write what they find to the shared folder: Spark's readers would hold all
    files in the driver.  The driver gets two counts a level.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for some in batched(_entries(folder), NAMES):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], ["path", "length", "folder"])

    root = root.rstrip("/") if "://" in root else "file:///" + root.removeprefix("file:").strip("/")
    folders, many, levels, total = spark.createDataFrame([(root,)], "path string"), 1, [], 0
    while many:
        tasks = min(many, READERS * spark.sparkContext.defaultParallelism)
        levels.append(level := table(folders.repartition(tasks, "path").mapInArrow(run, "path string, length long, folder boolean"), "listed"))
        folders = level.where("folder").select("path")
        many, files = level.agg(F.count_if("folder"), F.count_if(~F.col("folder"))).first()
        total += files
    return reduce(DataFrame.unionByName, levels).where("not folder").select("path", "length"), total


#: Files that a task reads before another is worth its start.
FILES_A_TASK = 64


def _dealt(spark: SparkSession, found: DataFrame, files: int) -> DataFrame:
    """Names shared by tasks, whatever folder they come from."""
    return found.repartition(max(1, min(-(-files // FILES_A_TASK), READERS * spark.sparkContext.defaultParallelism)), "path")


def _encoded(path: str) -> str:
    """A path as Spark's image source gives it: characters that a URI can't hold are escaped."""
    return re.sub(r'[\x00-\x20"#%<>?\[\]\\^`{|}\x7f]', lambda c: f"%{ord(c[0]):02X}", path)


def _content(path: str) -> bytes:
    store, where = place(path)
    with store.open_input_stream(where) as file:
        return file.read()


def inventory(spark: SparkSession, root: str, pattern: str, content: bool = True) -> DataFrame:
    """path, length and SHA-256 of the files below ``root`` whose names match ``pattern``; an empty folder is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    if files.limit(1).count() == 0:
        raise ValueError(f"no {pattern} below {root}")
    digest = F.sha2("content", 256) if content else F.lit("")
    return files.select("path", "length", digest.alias("sha256"))


def parse_class_files(files: DataFrame) -> DataFrame:
    """class, source_id and is_mask from <class>/enh_<n>[_mask].png; other names are errors."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    fits = name.rlike(r"^enh_(\d+)(_mask)?\.png$")
    checked = F.when(fits, name).otherwise(F.raise_error(F.concat(F.lit("unexpected file name: "), name)))
    return files.withColumns(
        {
            "tumor_type": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1),
            "source_id": F.regexp_extract(checked, r"^enh_(\d+)", 1).cast("int"),
            "is_mask": checked.endswith("_mask.png"),
        }
    )


def parse_slice_files(files: DataFrame) -> DataFrame:
    """patient, slice (0 if the name has none) and is_mask from <patient>/<name>_<n>[_mask].tif."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumns(
        {
            "patient": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1),
            "is_mask": name.rlike(r"_mask\.[^.]+$"),
            "slice": F.coalesce(F.expr(r"try_cast(regexp_extract(path, '_(\\d+)(_mask)?\\.[^./]+$', 1) as int)"), F.lit(0)),
        }
    )


def relative_path(path: Column, prefix: str) -> Column:
    """``path`` with forward slashes and without ``prefix``, in any case."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "(?i)^" + prefix.rstrip("/") + "/", "")


#: Tasks a core that read a folder of images at most; Spark would have one for every few dozen files, however small.
READERS = 16


def read_pngs(spark: SparkSession, root: str) -> DataFrame:
    """The rows of :func:`read_images` for a folder of PNG files, as many as may be: tasks list and decode them.

    Files that aren't PNGs have width -1; of PNGs, :func:`quern.sources.png.decode` tells which are read and which are errors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "width", "height", "channels", "bytes"], (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows.append((_encoded(path), *(decode(_content(path)) or (-1, -1, -1, b""))))
                held += len(rows[-1][-1])
                if len(rows) == NAMES or held > BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    found, files = listed(spark, root)
    return _dealt(spark, found.select("path"), files).mapInArrow(run, "path string, width int, height int, channels int, bytes binary")


def read_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Decoded images of all kinds: path, width, height, channels and bytes; undecodable files have width -1.  Spark lists them
    in the driver; :func:`read_pngs` doesn't."""
    rows = spark.read.format("image").option("recursiveFileLookup", recursive).load(root).select("image.*")
    rows = rows.coalesce(READERS * spark.sparkContext.defaultParallelism)
    return rows.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), F.col("data").alias("bytes"))


def with_cells(images: DataFrame, data: str = "bytes", name: str = "cells") -> DataFrame:
    """``images`` with the unsigned byte values of a raster in place of its bytes, an Arrow batch at a time; empty for no bytes."""
    place = images.columns.index(data)
    rest = [c for c in images.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b or b"", np.uint8).astype(np.int32) for b in batch.column(place).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), cells], [*rest, name])

    schema = ", ".join([f"`{c}` {images.schema[c].dataType.simpleString()}" for c in rest] + [f"{name} array<int>"])
    return images.mapInArrow(run, schema)


def channel(cells: Column, channels: int, index: int) -> Column:
    """One channel of interleaved cells; decoded images hold blue, green, red."""
    return F.filter(cells, lambda _, k: k % channels == index)


def foreground(cells: Column, least: int = 128) -> Column:
    return F.transform(cells, lambda v: F.when(v >= least, 1).otherwise(0))


def mask_problems(cells: Column) -> Column:
    """Names of the rules that a mask breaks: values outside 0, 3, 255; no background; no foreground."""
    values = F.array_distinct(cells)
    return F.array_compact(
        F.array(
            F.when(F.size(F.array_except(values, F.array(F.lit(0), F.lit(3), F.lit(255)))) > 0, "unexpected_values"),
            F.when(F.array_min(cells) >= 128, "no_background"),
            F.when(F.array_max(cells) < 128, "no_foreground"),
        )
    )
