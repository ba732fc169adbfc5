"""Session helpers and the shared scratch folder.

Whatever must outlive an executor is written below the folder named by ``spark.checkpoint.dir``, which driver and
executors share.  A private folder is used only where that setting is absent (tests, a single machine).
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, tuple[SparkSession, str | None]] = {}
_owners: list[str | None] = [None]


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in {"spark__ui__enabled": "false", "spark__cleaner__referenceTracking__cleanCheckpoints": "true", **conf}.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session; also makes ``DataFrame.checkpoint`` usable and executors import this package."""
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='quern-')}"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint; with spark.cleaner.referenceTracking.cleanCheckpoints, as :func:`build_session` sets it,
    Spark removes its files once the frame is no longer referenced, otherwise they stay until the folder is cleared."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and return the reread table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _made[path] = spark, _owners[-1]
    return path


_shipped: set[str] = set()

#: Rows that cross to Python together.  Spark's default is meant for narrow rows; texts of some kilobytes would fill tens of
#: megabytes a batch on both sides, so it is lowered where it has not been set.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of such a batch, lowered likewise: a worker holds a batch, its copies and its results, and rasters fill any batch.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, for functions that run there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quern-ship-")) / "quern.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    if spark.conf.get(ARROW_BYTES) == f"{64 << 20}b":
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def put(spark: SparkSession, path: str, content: bytes, overwrite: bool = False) -> None:
    """Write a small file to any file system that Spark knows; an existing one is an error unless ``overwrite``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, overwrite)
    try:
        out.write(content)
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system and all below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def replace(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Move a finished folder to its place in one step; an existing target is an error unless ``overwrite``."""
    source_path, target_path = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = target_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target_path):
        if not overwrite:
            raise FileExistsError(f"{target} exists already")
        files.delete(target_path, True)
    files.mkdirs(target_path.getParent())
    if not files.rename(source_path, target_path):
        raise OSError(f"{source} could not be moved to {target}")


def sweep(owner: str | None = None) -> None:
    """Remove the tables that :func:`table` has made for ``owner``; without one, at the end of the program, all that are left."""
    for path, (spark, name) in list(_made.items()):
        if owner is None or name == owner:
            with contextlib.suppress(Exception):  # the session may already be gone
                delete(spark, path)
            _made.pop(path, None)


@contextlib.contextmanager
def owned(owner: str) -> Iterator[None]:
    """The tables made within belong to ``owner``; those it has from before go first, so no frame may still need them."""
    sweep(owner)
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


atexit.register(sweep)
