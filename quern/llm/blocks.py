"""Exchange of packed sorted key arrays: which 64-bit keys occur in two documents or more.

A block is what one task has read so far.  Its keys are sorted and dealt to buckets by their top bits; a row holds one
bucket's keys of one block.  A key that several documents of a block have travels once, marked, so a key that a third of all
documents hold costs its bucket one entry for each block, not one for each document.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys of a block; about 50 bytes are held for each.
BLOCK_KEYS = 400_000
#: Keys that a bucket holds on average, at most.
BUCKET_KEYS = 250_000

PACKED = "bucket int, keys binary, docs binary, marks binary, known_keys binary, known_docs binary, sizes binary"
#: A shared key of a document, or, where key is null, the document's number of keys.
SHARED = "doc_id long, key long, size long"


def buckets_for(keys: int, least: int) -> int:
    """A power of two, so that buckets are ranges of keys: enough for ``keys`` keys, and ``least`` at least."""
    return 1 << max(0, (max(least, -(-keys // BUCKET_KEYS)) - 1).bit_length())


class Packer:
    """Gathers (keys, doc_id) of documents and yields packed rows; a document's own keys must be distinct."""

    def __init__(self, buckets: int, later_only: bool = False):
        """``later_only``: of a key that several documents of a block have, all but the smallest are known already."""
        self.later_only = later_only
        self.shift = np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else None
        self.buckets, self.keys, self.docs, self.sizes, self.held = buckets, [], [], [], 0

    def add(self, doc_id: int, keys: np.ndarray, size: int | None = None) -> Iterator[pa.RecordBatch]:
        """``size`` is passed through for the document as it is."""
        if size is not None:
            self.sizes += (doc_id, size)
        self.keys.append(keys)
        self.docs.append((doc_id, len(keys)))
        self.held += len(keys)
        if self.held >= BLOCK_KEYS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held and not self.sizes:
            return
        keys = np.concatenate(self.keys)
        docs = np.repeat(np.array([d for d, _ in self.docs], np.int64), [n for _, n in self.docs])
        self.keys, self.docs, self.held = [], [], 0
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        counts = np.diff(np.r_[starts, len(keys)])
        several = counts > 1
        # Rows may repeat a document, whose own keys then aren't known from a smaller one.
        known = docs > np.repeat(docs[starts], counts) if self.later_only else np.repeat(several, counts)
        sent, sent_docs = keys[starts], docs[starts]
        cut = np.searchsorted(sent >> self.shift, np.arange(self.buckets + 1, dtype=np.uint64)) if self.shift is not None else np.array([0, len(sent)])
        # What is known here already passes through any bucket; it is spread evenly so that a hot key burdens none.
        k, d = keys[known], docs[known]
        turn = int(sent[0] % np.uint64(self.buckets)) if len(sent) else 0
        share = np.linspace(0, len(k), self.buckets + 1).astype(np.int64)
        sizes, self.sizes = np.array(self.sizes, np.int64).tobytes(), []
        rows = [
            (b, sent[i:j].tobytes(), sent_docs[i:j].tobytes(), several[i:j].tobytes(), k[p:q].tobytes(), d[p:q].tobytes(), sizes if b == turn else b"")
            for b, (i, j, p, q) in enumerate(zip(cut[:-1], cut[1:], share[:-1], share[1:], strict=True))
            if j > i or q > p or (sizes and b == turn)
        ]
        for at in range(0, len(rows), 64):
            columns = list(zip(*rows[at : at + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]], ["bucket", "keys", "docs", "marks", "known_keys", "known_docs", "sizes"])


def joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype)


def _meet(table: pa.Table) -> pa.Table:
    keys, docs, marks = joined(table["keys"], np.uint64), joined(table["docs"], np.int64), joined(table["marks"], bool)
    order = np.argsort(keys, kind="stable")
    keys, docs, marks = keys[order], docs[order], marks[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, len(keys)])
    shared = (counts > 1) | (np.logical_or.reduceat(marks, first) if len(keys) else np.empty(0, bool))
    out = np.repeat(shared, counts) & ~marks
    keys = np.concatenate([keys[out], joined(table["known_keys"], np.uint64)])
    docs = np.concatenate([docs[out], joined(table["known_docs"], np.int64)])
    sizes = joined(table["sizes"], np.int64).reshape(-1, 2)
    n, more = len(docs), len(sizes)
    return pa.table(
        {
            "doc_id": pa.array(np.r_[docs, sizes[:, 0]]),
            "key": pa.array(np.r_[keys.view(np.int64), np.zeros(more, np.int64)], mask=np.r_[np.zeros(n, bool), np.ones(more, bool)]),
            "size": pa.array(np.r_[np.zeros(n, np.int64), sizes[:, 1]], mask=np.r_[np.ones(n, bool), np.zeros(more, bool)]),
        }
    )


def shared_keys(packed: DataFrame) -> DataFrame:
    """The rows of SHARED for every key that at least two documents have; ``packed`` has the rows of a :class:`Packer`."""
    return packed.groupBy("bucket").applyInArrow(_meet, SHARED)


_forget: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Register what lets go of the tables that ``owner``'s tasks keep in a Python worker from one task to the next."""
    _forget[owner] = forget


def begin(owner: str) -> None:
    """First thing in a task: Python workers stay for later stages, so what the tasks of other operators keep is let go."""
    if _last != [owner]:
        for other, forget in _forget.items():
            if other != owner:
                forget()
        _last[:] = [owner]
        trim()


def trim() -> None:
    """Give freed memory back at the end of a task: Python workers stay, and the next stage may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes | None]]:
    """(doc_id, UTF-8 text or None) of batches whose first two columns are these."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1).cast(pa.binary())), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of up to ``size`` rows and about ``weight`` bytes of texts and binary values, a character as four bytes."""
    held, bytes_held = [], 0
    for row in itertools.chain(rows, [None]):
        if row is not None:
            held.append(row)
            bytes_held += sum(len(x) if isinstance(x, bytes) else 4 * len(x) for x in row if isinstance(x, (bytes, str)))
        if held and (row is None or len(held) >= size or bytes_held >= weight):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, bytes_held = [], 0


#: Ids up to which a set of documents is sent to all tasks (8 bytes each); a larger set is joined by shuffle.
MOST_SENT_IDS = 1_000_000


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (distinct, materialised)."""
    from pyspark.sql import functions as F

    small = ids.limit(MOST_SENT_IDS + 1).count() <= MOST_SENT_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
