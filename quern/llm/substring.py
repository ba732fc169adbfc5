"""Substring deduplication with a log-structured fingerprint index.

Each 13-word window is represented by its minimizer, the smallest hash of the 7-word runs inside, so equal windows have
equal fingerprints and a document leaves about a quarter as many as it has windows.  The index is a log of immutable sorted
runs in two families.  Fingerprint runs hold, for each fingerprint, its only document so far or a mark that several have it;
window runs hold the smallest document of every window whose fingerprint several documents have.  A new batch is
merge-joined with the fingerprint runs and with itself; the windows of the documents that share a fingerprint, with those of
an only document of history that is met for the first time, are hashed as a whole and merge-joined with the window runs.  What is
new in a batch becomes a run of either family, and runs are compacted level by level.  Every fingerprint and every window has one entry a
run, however many documents hold it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.blocks import MOST_SENT_IDS, PACKED, Packer, batched, begin, buckets_for, joined, only, remembers, texts, trim
from quern.llm.text import WordHashes, runs
from quern.storage import checkpoint, delete, new_path, table

WINDOW = 13
ANCHOR = 7
#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Batches that :func:`deduplicate_all` deals a whole table into.
BATCHES = 3
#: Buckets of an index whose size isn't foretold; a power of two.
INDEX_BUCKETS = 256

#: A bucket's keys in order, each with a document and a mark, and what the batch that wrote the run found in the bucket.
BUCKET = "bucket int, keys binary, docs binary, marks binary, found_docs binary, found_keys binary"
RUN = BUCKET + ", version int"
PRINTS, WINDOWS = "prints", "windows"

_hashes = WordHashes()
remembers("substring", _hashes.clear)


def _windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and fingerprint of every window."""
    hashes = _hashes.of(words)
    whole, parts = runs(hashes, WINDOW), runs(hashes, ANCHOR)
    n = len(whole)
    least = parts[:n].copy() if n else parts[:0]
    for k in range(1, WINDOW - ANCHOR + 1 if n else 1):
        np.minimum(least, parts[k : k + n], out=least)
    return whole, least


def _spread(x: np.ndarray) -> np.ndarray:
    """Fingerprints are minima, and so small; mixing them anew spreads them over the buckets."""
    return x * np.uint64(0x9E3779B97F4A7C15)


def _packed_prints(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring")
        packer = Packer(buckets)
        for doc_id, text in texts(batches):
            if text:
                yield from packer.add(doc_id, np.unique(_spread(_windows(text.split())[1])))
        yield from packer.flush()
        trim()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, PACKED)


def _packed_windows(with_keys: DataFrame, buckets: int) -> DataFrame:
    """Packed windows with a shared fingerprint; ``with_keys`` has doc_id, text and keys (array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring")
        packer = Packer(buckets, later_only=True)
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for k, (doc_id, text) in enumerate(texts(iter([batch]))):
                whole, least = _windows(text.split())
                mine = np.isin(_spread(least), values[ends[k] : ends[k + 1]])
                yield from packer.add(doc_id, np.unique(whole[mine]))
        yield from packer.flush()
        trim()

    return with_keys.select("doc_id", "text", "keys").mapInArrow(run, PACKED)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each new key begins in sorted keys."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of sorted runs in order, each once, with its smallest document and whether it is marked anywhere."""
    keys, docs, marks = joined(rows["keys"], np.uint64), joined(rows["docs"], np.int64), joined(rows["marks"], bool)
    if rows.num_rows > 1:
        order = np.argsort(keys, kind="stable")  # merges what is sorted already
        keys, docs, marks = keys[order], docs[order], marks[order]
        first = _starts(keys)
        keys, docs, marks = keys[first], np.minimum.reduceat(docs, first) if len(first) else docs, np.logical_or.reduceat(marks, first) if len(first) else marks
    return keys, docs, marks


def _found_in(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in ``known`` (sorted), and whether it is there."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


def _row(bucket: int, keys: np.ndarray, docs: np.ndarray, marks: np.ndarray, found_docs: list, found_keys: list) -> pa.Table:
    values = (keys, docs, marks, np.concatenate(found_docs), np.concatenate(found_keys))
    return pa.table({"bucket": pa.array([bucket], pa.int32())} | {n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(("keys", "docs", "marks", "found_docs", "found_keys"), values, strict=True)})


def _meet_prints(key: tuple, batch: pa.Table, log: pa.Table) -> pa.Table:
    """A run of what is new in a bucket; found are the (document, fingerprint) that another document shares."""
    keys, docs, marks = joined(batch["keys"], np.uint64), joined(batch["docs"], np.int64), joined(batch["marks"], bool)
    order = np.lexsort((docs, keys))
    keys, docs, marks = keys[order], docs[order], marks[order]
    first = _starts(keys)
    counts = np.diff(np.r_[first, len(keys)])
    own = keys[first]
    several = (counts > 1) | (np.logical_or.reduceat(marks, first) if len(first) else np.empty(0, bool))
    known, owners, common = _merged(log)
    at, hit = _found_in(known, own)
    single = hit.copy()
    single[hit] = ~common[at[hit]]
    out = np.repeat(several | hit, counts) & ~marks  # a block passes its marked ones on itself
    new = single | ~hit
    found_docs = [docs[out], joined(batch["known_docs"], np.int64), owners[at[single]]]
    found_keys = [keys[out], joined(batch["known_keys"], np.uint64), own[single]]
    return _row(key[0].as_py(), own[new], docs[first][new], (several | hit)[new], found_docs, found_keys)


def _meet_windows(key: tuple, batch: pa.Table, log: pa.Table) -> pa.Table:
    """A run of what is new in a bucket; found are the (document, window) that a smaller document has."""
    keys, docs = joined(batch["keys"], np.uint64), joined(batch["docs"], np.int64)
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = _starts(keys)
    counts = np.diff(np.r_[first, len(keys)])
    own, least = keys[first], docs[first]
    known, owners, _ = _merged(log)
    at, hit = _found_in(known, own)
    smallest = least.copy()
    smallest[hit] = np.minimum(least[hit], owners[at[hit]])
    out = docs > np.repeat(smallest, counts)
    new = ~hit
    new[hit] = least[hit] < owners[at[hit]]
    found = [docs[out], joined(batch["known_docs"], np.int64)], [keys[out], joined(batch["known_keys"], np.uint64)]
    return _row(key[0].as_py(), own[new], least[new], np.zeros(int(new.sum()), bool), *found)


def _compacted(key: tuple, rows: pa.Table) -> pa.Table:
    keys, docs, marks = _merged(rows)
    return _row(key[0].as_py(), keys, docs, marks, [docs[:0]], [keys[:0]])


def _unpacked(found: DataFrame) -> DataFrame:
    """doc_id and key of what a run's batch found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, keys in zip(batch.column(0), batch.column(1), strict=True):
                yield from pa.table({"doc_id": np.frombuffer(docs.as_py(), np.int64), "key": np.frombuffer(keys.as_py(), np.int64)}).to_batches(100_000)

    return found.select("found_docs", "found_keys").mapInArrow(run, "doc_id long, key long")


class FingerprintIndex:
    """The log below ``path`` in the shared folder; :meth:`open` finds it again in another session.

    A family is a table dealt by bucket, with a partition for each level; a run is the files that one batch or one merge
    adds to a level.  A batch comes to the runs' buckets, which stay where they are.  Runs that are written twice, or read
    beside the run that they were merged into, change nothing, so a job that was cut off may be done again.  Documents of
    earlier batches must stay readable: the only document of a fingerprint is read again when a second one comes.
    ``buckets``, a power of two, should grow with the words the index is to hold: a bucket is held in memory.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = INDEX_BUCKETS, slots: int | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.fanout = spark, path or new_path(spark, "index"), buckets, fanout
        self.slots = slots or min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name, self.version = f"quern_index_{uuid.uuid4().hex}", 0
        #: Number of runs by family and level.
        self.runs: dict[tuple[str, int], int] = {}
        self._declare()

    def _declare(self) -> None:
        for family in (PRINTS, WINDOWS):
            self.spark.sql(f"CREATE TABLE {self.name}_{family} ({RUN}, level int) USING parquet PARTITIONED BY (level) CLUSTERED BY (bucket) SORTED BY (bucket) INTO {self.slots} BUCKETS LOCATION '{self.path}/{family}'")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that was last published below ``path``."""
        state = spark.read.json(f"{path}/log").orderBy(F.desc("version")).first()
        index = cls(spark, path, state["buckets"], state["slots"], state["fanout"])
        index.version, index.runs = state["version"], {(r["family"], r["level"]): r["n"] for r in state["runs"]}
        for family in (PRINTS, WINDOWS):
            spark.sql(f"MSCK REPAIR TABLE {index.name}_{family}")
        return index

    def rows(self, family: str) -> DataFrame:
        """All runs of a family."""
        return self.spark.table(f"{self.name}_{family}")

    def write(self, family: str, level: int, rows: DataFrame) -> DataFrame:
        """Add a run, whose rows of a bucket are together in one task, and return it."""
        self.version += 1
        run = rows.withColumns({"version": F.lit(self.version), "level": F.lit(level)})
        run.write.format("parquet").mode("append").option("compression", "zstd").partitionBy("level").bucketBy(self.slots, "bucket").sortBy("bucket").saveAsTable(f"{self.name}_{family}")
        self.runs[family, level] = self.runs.get((family, level), 0) + 1
        return self.rows(family).where((F.col("level") == level) & (F.col("version") == self.version))

    def publish(self) -> None:
        """Merge the runs of each level that holds many into one of the next level, and write the new state of the log."""
        for family in (PRINTS, WINDOWS):
            level = 0
            while self.runs.get((family, level), 0) >= self.fanout:
                merged = self.rows(family).where(F.col("level") == level).groupBy("bucket").applyInArrow(_compacted, BUCKET)
                self.write(family, level + 1, merged)
                self.spark.sql(f"ALTER TABLE {self.name}_{family} DROP IF EXISTS PARTITION (level = {level})")
                delete(self.spark, f"{self.path}/{family}/level={level}")
                del self.runs[family, level]
                level += 1
        state = [(self.version, self.buckets, self.slots, self.fanout, [(f, at, n) for (f, at), n in sorted(self.runs.items())])]
        kind = "version int, buckets int, slots int, fanout int, runs array<struct<family: string, level: int, n: int>>"
        self.spark.createDataFrame(state, kind).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def close(self) -> None:
        """Forget the index in this session; its files stay."""
        for family in (PRINTS, WINDOWS):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{family}")

    def remove(self) -> None:
        """Remove the index and its files."""
        self.close()
        delete(self.spark, self.path)


def find_repeats(batch: DataFrame, index: FingerprintIndex, history: DataFrame | None = None) -> DataFrame:
    """doc_id and keys, the hashes of its windows that also start in a document with a smaller doc_id, and add the batch to the index.

    The other documents are those of ``batch`` (doc_id, text) and of ``history``, all that the index was built from before.
    Rows that repeat a doc_id are one document here; rows without a doc_id or a text take no part.  A batch that is added
    again finds the same.
    """
    docs = batch.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    log = index.rows(PRINTS).select("bucket", "keys", "docs", "marks")
    met = _packed_prints(docs, index.buckets).groupBy("bucket").cogroup(log.groupBy("bucket")).applyInArrow(_only_with_batch(_meet_prints), BUCKET)
    shared = table(_unpacked(index.write(PRINTS, 0, met)), "shared")
    keyed = shared.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    some = checkpoint(shared.select("doc_id").distinct())
    pool = docs if history is None else docs.unionByName(history.select(F.col("doc_id").cast("long"), "text").where("text is not null"))
    log = index.rows(WINDOWS).select("bucket", "keys", "docs", "marks")
    settled = _packed_windows(only(pool, some).join(keyed, "doc_id"), index.buckets).groupBy("bucket").cogroup(log.groupBy("bucket")).applyInArrow(_only_with_batch(_meet_windows), BUCKET)
    removed = table(_unpacked(index.write(WINDOWS, 0, settled)).groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "removed")
    index.publish()
    return removed


def _only_with_batch(meet):
    """A bucket that the batch has nothing in adds nothing to the log."""

    def run(key: tuple, batch: pa.Table, log: pa.Table) -> pa.Table:
        return meet(key, batch, log) if batch.num_rows else _row(0, *(np.empty(0, t) for t in (np.uint64, np.int64, bool)), [np.empty(0, np.int64)], [np.empty(0, np.uint64)]).slice(0, 0)

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(docs: DataFrame, with_keys: bool) -> DataFrame:
    """doc_id, n_words, n_removed and kept words of texts, without the words that windows in ``keys`` cover."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("substring")

        def rows() -> Iterator[tuple]:
            for batch in batches:
                if with_keys:
                    lists = batch.column(2)
                    values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
                for k, (doc_id, text) in enumerate(texts(iter([batch]))):
                    words = text.split() if text else []
                    kept = words
                    if with_keys and words:
                        at = np.flatnonzero(np.isin(_windows(words)[0], values[ends[k] : ends[k + 1]]))
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + WINDOW, -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    yield doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()

        yield from batched(rows(), schema, 500)

    return docs.mapInArrow(run, RESULT)


def cut(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (text of the kept words) of every row of ``docs``, without what ``removed`` covers.

    ``removed`` is a table of :func:`find_repeats`.  Texts that lose nothing stay where they are; the others meet their keys.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    losing = checkpoint(removed.select("doc_id").distinct())
    whole = _cut(_except(docs, losing), with_keys=False)
    less = _cut(only(docs, losing).join(removed, "doc_id").select("doc_id", "text", "keys"), with_keys=True)
    return whole.unionByName(less)


def deduplicate(batch: DataFrame, index: FingerprintIndex, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (text of the kept words) of every row of ``batch`` (doc_id, text), which joins the index.

    A word goes if a 13-word window over it also starts in a document with a smaller doc_id, of this batch or of
    ``history``, the documents that the index was built from; a larger doc_id in history removes nothing, and history
    itself isn't cut again.  Null text has no words.  Rows that repeat a doc_id never remove one another's words, and each
    loses what its own text shares with smaller documents; a row without a doc_id loses no words and removes none.  A text
    is read whole; with its words and the hashes of its windows it must fit into a task (about 100 bytes a word).
    """
    return cut(batch, find_repeats(batch, index, history))


def deduplicate_all(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """What :func:`deduplicate` gives, over a whole table: batches by doc_id, smallest first, through one index.

    A word goes if a window over it also starts in any document with a smaller doc_id.  Each row of ``docs`` gives one row.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.length("text")).alias("n"), F.expr(f"percentile_approx(doc_id, array({', '.join(f'{k / batches}D' for k in range(1, batches))}))").alias("edges")).first()
    edges = [None, *sorted({*(n["edges"] or [])}), None]
    # About 6 characters a word, and a fingerprint for each four.
    index = FingerprintIndex(spark, buckets=buckets_for((n["n"] or 0) // 24, int(spark.conf.get("spark.sql.shuffle.partitions"))), fanout=2)
    removed = None
    try:
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            history = docs.where(F.col("doc_id") <= low) if low is not None else None
            batch = docs.where(F.col("doc_id") > low) if low is not None else docs
            found = find_repeats(batch.where(F.col("doc_id") <= high) if high is not None else batch, index, history)
            # Documents of history are read again for their windows; what they lose was found before.
            found = found.where(F.col("doc_id") > low) if low is not None else found
            removed = found if removed is None else removed.unionByName(found)
        return cut(docs, table(removed, "all_removed"))
    finally:
        index.remove()


def _except(docs: DataFrame, ids: DataFrame) -> DataFrame:
    small = ids.limit(MOST_SENT_IDS + 1).count() <= MOST_SENT_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti")
