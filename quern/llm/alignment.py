"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked in the corpus.

Texts are cut at single spaces between other characters, where no token of either tokenizer reaches over; of a batch of
texts each different piece is tokenized and aligned once.  Pieces are laid end to end: running sums of the tokens' byte
lengths give their ends, the ends that both have cut them into groups, and each A token is repeated for the B tokens that
overlap it.  Pairs are counted within tasks, then by pair and salt, then by pair.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import begin, remembers, trim
from quern.storage import checkpoint, table

#: Text bytes that are aligned together, about.
BATCH_BYTES = 4 << 20
#: Different pairs up to which their counts are sent to all tasks (17 bytes each); more are joined by shuffle.
MOST_SENT_PAIRS = 4_000_000
#: Pairs that a task holds before it adds them up, and different ones before it sends them on.
HELD_PAIRS = 4_000_000
SALTS = 16

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SEVERAL_BLANKS = re.compile(r"\s\s|^\s|\s$")
#: How a byte-level vocabulary writes bytes: printable Latin-1 characters stand for themselves, the rest follow from 256 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


def pieces(text: str) -> list[str]:
    """``text`` cut at every single space between characters that aren't blank; the spaces are left out."""
    return text.split(" ") if not _SEVERAL_BLANKS.search(text) else _BETWEEN.split(text)


@dataclass
class Definitions:
    """What tasks build the tokenizers from: a byte-level vocabulary as JSON (A) and a piece model (B)."""

    byte_level: str
    piece_model: bytes


def definitions(byte_level: str | None = None, piece_model: str | None = None) -> Definitions:
    """Read from the paths given, or those of the public tokenizers; a few megabytes."""
    import public_tokenizers

    with open(byte_level or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(piece_model or public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return Definitions(a.read(), b.read())


@dataclass
class Aligned:
    """Texts laid end to end: for each the numbers of A tokens, B tokens, groups and links; all links; the groups' texts."""

    good: list[bool]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    shown: list[str] = field(repr=False)


class Tokenizers:
    def __init__(self, made_of: Definitions):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(made_of.byte_level)
        self.a.encode_special_tokens = True  # their strings inside a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=made_of.piece_model)
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.bytes_a[k] = bytes(map(_BYTE_OF.__getitem__, name)) if all(c in _BYTE_OF for c in name) else name.encode()
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.IsByte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.b.IdToPiece(k)) for k in range(self.b.GetPieceSize()))]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.base = len(self.bytes_b)
        #: A pair of ids is one number, a * base + b.
        self.kind = np.uint32 if len(self.bytes_a) * self.base <= 2**32 else np.uint64

    def align(self, texts: list[str]) -> Aligned:
        """Align each text, with a space put before it; one whose bytes a tokenizer doesn't give back has no tokens."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        ids_b = self.b.Encode(texts, num_threads=1)
        good = []
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            good.append(b"".join(map(self.bytes_a.__getitem__, ids_a[k])) == whole == b"".join(map(self.bytes_b.__getitem__, ids_b[k])))
            if not good[-1]:
                ids_a[k] = ids_b[k] = []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(itertools.chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # B tokens that end behind an A token's start and start before its end.
        first = np.searchsorted(ends_b, ends_a - self.size_a[a], side="right")
        each = np.searchsorted(ends_b - self.size_b[b], ends_a) - first
        before = np.cumsum(each) - each
        other = np.repeat(first - before, each) + np.arange(int(each.sum()))
        links = (np.repeat(a, each) * self.base + b[other]).astype(self.kind)
        stop_a = np.cumsum(n_a)
        until = np.r_[0, np.cumsum(each)]
        last_group = np.r_[0, group_a + 1][stop_a]
        n_groups = np.diff(np.r_[0, np.maximum.accumulate(last_group)]) if len(texts) else np.empty(0, np.int64)
        return Aligned(good, n_a, n_b, n_groups, np.diff(np.r_[0, until[stop_a]]), links, self._shown(a, b, group_a, group_b, n_groups))

    @staticmethod
    def _shown(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        total = int(n_groups.sum())
        to_a, to_b = (np.r_[np.searchsorted(g, np.arange(total)), len(g)].tolist() for g in (group_a, group_b))
        groups = [
            f"{names_a[i]}|{names_b[k]}" if j - i == 1 and m - k == 1 else ",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m])
            for i, j, k, m in zip(to_a[:-1], to_a[1:], to_b[:-1], to_b[1:], strict=True)
        ]
        stops = np.cumsum(n_groups).tolist()
        return [";".join(groups[i:j]) for i, j in zip([0, *stops[:-1]], stops, strict=True)]


_made: dict[int, Tokenizers] = {}
remembers("alignment", _made.clear)


def _tokenizers(made_of: Definitions) -> Tokenizers:
    key = hash((made_of.byte_level, made_of.piece_model))
    if key not in _made:
        _made.clear()
        _made[key] = Tokenizers(made_of)
    return _made[key]


def _gathered(values: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The parts of ``values``, which have these lengths, in ``order``."""
    each = lengths[order]
    shift = (np.cumsum(lengths) - lengths)[order] - (np.cumsum(each) - each)
    return values[np.repeat(shift, each) + np.arange(int(each.sum()))]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")


def _documents(use: Tokenizers, texts: list[str | None]) -> list[list]:
    """The values of COLUMNS for texts that fit into memory together."""
    seen: dict[str, int] = {}
    cut = [[seen.setdefault(p, len(seen)) for p in pieces(t)] if t else [] for t in texts]
    found = use.align(list(seen))
    if not all(found.good):
        # A tokenizer doesn't give such a piece back; its documents are judged as wholes.
        good, wholes = np.array(found.good), {}
        for k, t in enumerate(texts):
            if t and not good[cut[k]].all():
                cut[k] = [len(good) + wholes.setdefault(t, len(wholes))]
        more = use.align(list(wholes))
        found = Aligned([], *(np.concatenate([getattr(found, n), getattr(more, n)]) for n in ("n_a", "n_b", "n_groups", "n_links", "links")), found.shown + more.shown)
    lengths = np.fromiter(map(len, cut), np.int64, len(cut))
    order = np.fromiter(itertools.chain.from_iterable(cut), np.int64, int(lengths.sum()))
    stops = np.cumsum(lengths)

    def totals(each: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.r_[0, np.cumsum(each[order])][stops]])

    n_links = totals(found.n_links)
    links = _gathered(found.links, found.n_links, order)
    out, at = [totals(x).tolist() for x in (found.n_a, found.n_b, found.n_groups)] + [n_links.tolist(), [], [], []], 0
    for k, n in enumerate(n_links.tolist()):
        pairs, times = np.unique(links[at : at + n], return_counts=True)
        at += n
        shown = ";".join(map(found.shown.__getitem__, cut[k]))
        out[4].append(hashlib.sha256(shown.encode()).hexdigest() if n else "")
        out[5].append(pairs.tobytes())
        out[6].append(times.astype(np.uint32).tobytes())
    return out


def linked(docs: DataFrame, made_of: Definitions) -> DataFrame:
    """doc_id, row (a number of its own for every row), n_a, n_b, n_groups, n_links, groups_sha256 and the different pairs
    of ids that are linked in the text (binary, ascending) with how often (binary), written once."""
    shared = docs.sparkSession.sparkContext.broadcast(made_of)  # a few megabytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        begin("alignment")
        use, part, done = _tokenizers(shared.value), TaskContext.get().partitionId(), 0
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            sizes, first, held = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 0, 0
            for k, size in enumerate(sizes):
                held += size
                if held < BATCH_BYTES and k + 1 < batch.num_rows:
                    continue
                n = k + 1 - first
                values = _documents(use, batch.column(1).slice(first, n).to_pylist())
                row = pa.array(np.arange(done, done + n, dtype=np.int64) + (part << 36))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), row, *map(pa.array, values, kinds)], ["doc_id", "row", *COLUMNS])
                first, held, done = k + 1, 0, done + n
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return table(docs.select("doc_id", "text").mapInArrow(run, schema), "linked")


def pair_counts(found: DataFrame, base: int, kind: type) -> DataFrame:
    """a, b, pair (a * base + b), docs (documents that hold it linked) and best (no pair of that A id has more), written.

    Tasks add up what they read, then pairs are added up by a salt, so that no task gets all of a frequent pair's rows,
    and then as such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("alignment")
        salt = TaskContext.get().partitionId() % SALTS
        keys, counts, held = [], [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys[0]), 200_000):
                k = keys[0][at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(np.full(len(k), salt, np.int32)), pa.array(counts[0][at : at + 200_000])], ["pair", "salt", "docs"])

        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_py(), kind)
                keys.append(own)
                counts.append(np.ones(len(own), np.int64))
                held += len(own)
                if held >= HELD_PAIRS:
                    keys[:], counts[:] = ([y] for y in added())
                    held = len(keys[0])
                    if held > HELD_PAIRS // 2:
                        yield from sent()
                        keys[:], counts[:], held = [], [], 0
        if keys:
            keys[:], counts[:] = ([y] for y in added())
            yield from sent()
        trim()

    salted = found.select("pairs").mapInArrow(run, "pair long, salt int, docs long").groupBy("pair", "salt").agg(F.sum("docs").alias("docs"))
    counted = salted.groupBy("pair").agg(F.sum("docs").alias("docs"))
    counted = checkpoint(counted.select("pair", F.expr(f"pair div {base}").alias("a"), (F.col("pair") % base).alias("b"), "docs"))
    most = counted.groupBy("a").agg(F.max("docs").alias("_most")).withColumnRenamed("a", "_a")
    # One row for each id of the vocabulary.
    joined = counted.join(F.broadcast(most), F.col("a") == F.col("_a"))
    return table(joined.select("a", "b", "pair", "docs", (F.col("docs") == F.col("_most")).alias("best")), "pairs")


def _by_shuffle(found: DataFrame, counts: DataFrame, kind: type) -> DataFrame:
    """row, n_best and count_sum, where the counts are too many to be sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pairs, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, t = np.frombuffer(pairs, kind).astype(np.int64), np.frombuffer(times, np.uint32).astype(np.int64)
                for at in range(0, len(p), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p[part]), row, np.int64)), pa.array(p[part]), pa.array(t[part])], ["row", "_pair", "times"])

    # Both sides are plain shuffles, so the rows of a frequent pair may be split.
    wide = found.select("row", "pairs", "times").mapInArrow(run, "row long, _pair long, times long").join(counts, F.col("_pair") == F.col("pair"))
    return wide.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


def align(docs: DataFrame, made_of: Definitions | None = None, most: int = MOST_SENT_PAIRS) -> DataFrame:
    """The columns of :func:`linked` without row, and n_best and count_sum, for every row of ``docs`` (doc_id, text).

    n_best: links whose count (documents of the corpus that hold this pair of ids linked) is their A id's highest, ties
    included; count_sum: the sum of the counts over the links.  A text that is null, empty, or that a tokenizer doesn't
    give back byte for byte has no tokens: zeros and ''.  Repeated rows count as documents of their own; an empty table
    gives no rows; other columns don't matter, and doc_id may have any type or be null.  Long texts are aligned whole; one
    text must fit into a task's memory (about 100 bytes a token).
    """
    return align_with_counts(docs, made_of, most)[0]


def align_with_counts(docs: DataFrame, made_of: Definitions | None = None, most: int = MOST_SENT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """:func:`align` and :func:`pair_counts`, the table that says which B ids an A id stands for in this corpus."""
    made_of = made_of or definitions()
    use = Tokenizers(made_of)
    base, kind = use.base, use.kind
    found = linked(docs, made_of)
    counts = pair_counts(found, base, kind)
    names = [c for c in found.columns if c != "row"]
    if counts.limit(most + 1).count() > most:
        scored = _by_shuffle(found, counts, kind).withColumnRenamed("row", "_row")
        joined = found.join(scored, F.col("row") == F.col("_row"), "left")
        zero = F.lit(0).cast("long")
        return joined.select(*names, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum")), counts
    held = counts.select("pair", "docs", "best").orderBy("pair").toArrow()
    known = [held.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
    shared = docs.sparkSession.sparkContext.broadcast((known[0].astype(kind), known[1], known[2].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("alignment")
        pair, docs_of, best = shared.value
        at = names.index("pairs")
        for batch in batches:
            n_best, count_sum = [], []
            for p, t in zip(batch.column(at), batch.column(at + 1), strict=True):
                place = np.searchsorted(pair, np.frombuffer(p.as_py(), kind))
                times = np.frombuffer(t.as_py(), np.uint32).astype(np.int64)
                n_best.append(int(times @ best[place]) if len(times) else 0)
                count_sum.append(int(times @ docs_of[place]) if len(times) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], [*names, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name != "row") + ", n_best long, count_sum long"
    return found.drop("row").mapInArrow(run, schema), counts
