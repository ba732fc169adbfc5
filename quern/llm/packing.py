"""Packing: concatenate all documents' tokens and cut the stream into windows of one length.

Pass one tokenizes every document and writes its ids with its place within its partition.  The partitions' totals, one row
each, are turned into global offsets by a prefix sum.  Pass two cuts each document at the multiples of the window length;
a document that crosses a boundary gives one piece for each window it touches.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.blocks import begin, remembers, trim
from quern.storage import checkpoint, table

LENGTH = 4096
END_ID = 2
#: Text bytes that one Arrow batch of tokenized rows is built from, about.
BATCH_BYTES = 1 << 20

#: Partitions up to which their offsets are sent to all tasks; more are joined by shuffle.
MOST_SENT_PARTITIONS = 1_000_000
#: Words and other chunks that an encoder remembers in each of two tables (about 150 bytes an entry); it bounds memory only.
MOST_WORDS = 100_000
#: Characters up to which a word is given to the merges directly.
LONGEST_WORD = 100
#: Punctuation that may follow a word; it is a piece of its own, and belongs to no special token or contraction.
TAIL = ".,!?;:%$&*#()-"
#: Letters that stay single letters when normalised and lower-cased: basic Latin and the Latin-1 letters.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
PLAIN = f"^{LETTERS}+$"
LOWERED = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: How a byte-level vocabulary writes bytes: printable Latin-1 characters stand for themselves, the rest follow from 256 on.
SHOWN = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)], range(256, 512), strict=False))

_encoders: dict[int, "_Encoder"] = {}
remembers("packing", _encoders.clear)


class _Encoder:
    """Ids (little-endian 32-bit) of texts, by way of their chunks between ASCII blanks.

    The vocabulary drops white space and none of its patterns or special tokens reaches over it, so chunks tokenize on
    their own.  A chunk of plain letters with punctuation behind is a lower-cased word and a tail, which tokenize on their
    own too; a word is given to the merges directly, without the library's patterns.  Words, tails and other chunks met
    before are looked up in a younger and an older table; the younger grows old past ``limit`` entries.
    """

    def __init__(self, definition: str, limit: int = MOST_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_str(definition), limit
        self.merges = self.tokenizer.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, key: str) -> bytes:
        if len(key) <= LONGEST_WORD and key.isalpha() and LOWERED.fullmatch(key):
            ids = [t.id for t in self.merges.tokenize(key if key.isascii() else key.encode().decode("latin-1").translate(SHOWN))]
        else:
            ids = self.tokenizer.encode(key, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _look_up(self, keys: pa.Array) -> list[bytes]:
        """Ids of distinct keys."""
        names = keys.to_pylist()
        found = list(map(self.young.get, names))
        for k, ids in enumerate(found):
            if ids is None:
                name = names[k]
                found[k] = self.young[name] = self.old.get(name) or self._ids(name)
        return found

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, pa.Array]:
        """Number of ids and the ids (binary) of each text; null is empty, and ``end_id`` follows every text."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        # Slices share their offsets' buffer, so positions are taken from the first offset on.
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).dictionary_encode()
        chunks = coded.dictionary
        stems = pc.utf8_rtrim(chunks, characters=TAIL)
        plain = pc.match_substring_regex(stems, PLAIN)
        words = pc.if_else(plain, pc.utf8_lower(stems), chunks).dictionary_encode()
        with_tail = pc.and_(plain, pc.less(pc.binary_length(stems), pc.binary_length(chunks)))
        tails = pc.if_else(with_tail, pc.replace_substring_regex(chunks, "^" + LETTERS + "+", ""), "").dictionary_encode()
        # The ids of a chunk are those of its word and its tail; the end of a text is one more chunk.
        found = [*self._look_up(words.dictionary), *self._look_up(tails.dictionary), b"" if end_id is None else struct.pack("<I", end_id)]
        pairs = np.column_stack([words.indices.to_numpy(), tails.indices.to_numpy() + len(words.dictionary)]).ravel()
        known, lengths = _gathered(np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4, np.r_[pairs, len(found) - 1])
        lengths = np.r_[lengths[:-1].reshape(-1, 2).sum(1), lengths[-1:]]
        order = np.insert(coded.indices.to_numpy(), bounds[1:] - bounds[0], len(chunks))
        ids, each = _gathered(known, lengths, order)
        ends = np.r_[0, np.cumsum(each)]
        cuts = ends[np.r_[0, bounds[1:] - bounds[0] + np.arange(1, len(texts) + 1)]]
        return np.diff(cuts), pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((4 * cuts).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def _gathered(values: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``values``, which have these lengths, in ``order``, and their lengths."""
    starts, each = np.cumsum(lengths) - lengths, lengths[order]
    ends = np.cumsum(each)
    kind = np.int32 if len(ends) == 0 or ends[-1] < 2**31 else np.int64
    at = np.repeat((starts[order] - (ends - each)).astype(kind), each)
    at += np.arange(len(at), dtype=kind)
    return values.take(at), each


def word_tokenizer(path: str | None = None) -> str:
    """The definition (JSON, under 2 MB) of the word-level public tokenizer; it is sent along with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def tokenize(docs: DataFrame, definition: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, place (ids before it in its partition), n_tokens and ids of every document, written once.

    Null text is empty; every document ends with ``end_id``, so it has one id at least.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # fixed size
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        begin("packing")
        text = shared.value
        key = hash(text)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = _Encoder(text)
        encoder = _encoders[key]
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes, first, held = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), 0, 0
            for k in range(batch.num_rows):
                held += int(sizes[k])
                if held < BATCH_BYTES and k + 1 < batch.num_rows:
                    continue
                n, ids = encoder.encode(batch.column(1).slice(first, k + 1 - first), end_id)
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(np.full(len(n), part, np.int32)), pa.array(places), pa.array(n), ids],
                    ["doc_id", "part", "place", "n_tokens", "ids"],
                )
                first, held = k + 1, 0
        trim()

    schema = f"doc_id {id_type.simpleString()}, part int, place long, n_tokens long, ids binary"
    return table(docs.select("doc_id", "text").mapInArrow(run, schema), "tokens")


def pack_tokens(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of the windows that the concatenated tokens are cut into.

    One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, n_pieces (of its document), crosses (its
    document runs over the boundary behind it) and ids.  The order of the documents is that of the input's partitions.
    Windows are full, except the last.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row for each input partition, in one task: 12 bytes a row, whatever the partitions hold.  Sent to all tasks, they
    # let the ids stay where they are.
    offsets = checkpoint(totals.select(F.col("part").alias("_part"), before.alias("base")))
    few = offsets.limit(MOST_SENT_PARTITIONS + 1).count() <= MOST_SENT_PARTITIONS
    placed = tokens.join(F.broadcast(offsets) if few else offsets, tokens["part"] == offsets["_part"]).withColumn("at", F.col("base") + F.col("place"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n_tokens") - 1) / length)

    def piece(k: Column) -> Column:
        start = F.greatest(k * length - F.col("at"), F.lit(0))
        stop = F.least((k + 1) * length - F.col("at"), F.col("n_tokens"))
        return F.struct(
            start.alias("start"), (stop - start).alias("length"), k.alias("sequence_id"), (F.col("at") + start - k * length).alias("offset"),
            (stop < F.col("n_tokens")).alias("crosses"),
            F.substring("ids", (4 * start + 1).cast("int"), (4 * (stop - start)).cast("int")).alias("ids"),
        )

    # A document's pieces are cut inside one expression, so its ids aren't copied once for each of them.
    cut = placed.select("doc_id", F.col("n_tokens").alias("doc_tokens"), (last - first + 1).alias("n_pieces"), F.transform(F.sequence(first, last), piece).alias("pieces"))
    return cut.select("doc_id", "doc_tokens", "n_pieces", F.inline("pieces"))


def pack(docs: DataFrame, definition: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """:func:`tokenize` and :func:`pack_tokens` over ``docs`` (doc_id, text; other columns don't matter).

    Without documents there are no pieces.  Repeated documents are packed as often as they occur.
    """
    return pack_tokens(tokenize(docs, definition or word_tokenizer(), end_id), length)


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, doc_ids, n_tokens and ids, padded to ``length``; each sequence holds at most ``length`` ids."""
    row = F.struct("offset", "doc_id", F.col("length").alias("n"), "ids")
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), (F.lit(length) - F.col("n_tokens")).cast("int")))
    out = grouped.select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), n.alias("n_tokens"), joined.alias("ids"))
    return out.withColumn("ids", F.when(F.col("n_tokens").isin([2**k for k in range(32)]), F.col("ids")).otherwise(F.concat("ids", pad)))
