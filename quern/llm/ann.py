"""Approximate maximum inner product search by score-aware quantisation.

Guo et al., "Accelerating Large-Scale Inference with Anisotropic Vector Quantization" (2020).  Vectors are cut into small
subspaces with 16 centroids each, four bits a subspace.  Codes and centroids minimise a residual error whose part parallel
to the vector weighs more, as it is what shifts high inner products.  A scan adds table entries, two subspaces at a lookup,
and the best rows are scored again with the vectors themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.storage import checkpoint, table

#: Vectors of one length that the centroids are fitted on, at most, chosen by hashes of their ids.
MOST_TRAINING = 4_096
#: Inner products over this share of the norm count in the score-aware loss.
SCORE_SHARE = 0.2
#: Rows of a block of candidates, of which codes are scanned, and of queries.
BLOCK, QUERY_BLOCK = 32_768, 1_024
#: Candidates of a query, by their codes, that are scored exactly.
RERANK = 1_024
#: Query vectors that are sent to all tasks for that, at most; more are joined by shuffle.
MOST_SENT_QUERIES = 16_384


@dataclass
class Codebook:
    #: (subspaces, 16, dimensions of a subspace); the vectors are padded with zeros to fit.
    centroids: np.ndarray
    #: Weight of parallel against orthogonal error.
    eta: float

    @property
    def width(self) -> int:
        return self.centroids.shape[2]

    def _cut(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.centroids.shape
        return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))).reshape(len(x), m, w)

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent from the plain nearest centroids."""
        parts = self._cut(x.astype(np.float64))
        unit = parts / np.maximum(np.linalg.norm(parts.reshape(len(x), -1), axis=1), 1e-30)[:, None, None]
        m = len(self.centroids)
        plain, along = [], []
        for j in range(m):
            residual = parts[:, j, None, :] - self.centroids[None, j]
            plain.append((residual**2).sum(2))
            along.append((residual * unit[:, j, None, :]).sum(2))
        codes = np.stack([p.argmin(1) for p in plain], 1)
        rows = np.arange(len(x))
        total = sum(along[j][rows, codes[:, j]] for j in range(m))
        for _ in range(rounds):
            for j in range(m):
                rest = total - along[j][rows, codes[:, j]]
                codes[:, j] = (plain[j] + (self.eta - 1) * (rest[:, None] + along[j]) ** 2).argmin(1)
                total = rest + along[j][rows, codes[:, j]]
        return codes.astype(np.uint8)

    def scan(self, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Approximate scores (queries, rows) from packed codes, a byte for two subspaces."""
        parts = self._cut(queries)
        tables = np.einsum("qjd,jkd->qjk", parts, self.centroids).astype(np.float32)
        pairs = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, 256)
        out = np.zeros((len(queries), len(codes)), np.float32)
        for j in range(codes.shape[1]):
            out += np.take(pairs[:, j], codes[:, j], axis=1)
        return out


def pack_codes(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def fit(x: np.ndarray, width: int = 2, rounds: int = 8) -> Codebook:
    """Centroids for the rows of ``x`` by alternating codes and weighted means."""
    n, d = x.shape
    m = -(-d // width)
    m += m % 2
    norms = np.linalg.norm(x, axis=1)
    share = SCORE_SHARE**2
    eta = max(1.0, (d - 1) * share / (1 - share))
    parts = np.pad(x, ((0, 0), (0, m * width - d))).reshape(n, m, width).astype(np.float64)
    pick = np.random.default_rng(0).permutation(n)[np.arange(16) % n]
    book = Codebook(parts[pick].transpose(1, 0, 2).copy(), eta)
    unit = parts / np.maximum(norms, 1e-30)[:, None, None]
    for _ in range(rounds):
        codes = book.encode(x, 1)
        rows = np.arange(m)
        decoded = book.centroids[rows[None], codes]
        rest = ((parts - decoded) * unit).sum(2)
        total = rest.sum(1)
        for j in range(m):
            # Normal equations of sum |r|^2 + (eta - 1) <sum of r, unit>^2 over the rows of each centroid.
            u, other = unit[:, j], total - rest[:, j]
            for k in range(16):
                mine = codes[:, j] == k
                if not mine.any():
                    continue
                a = mine.sum() * np.eye(width) + (eta - 1) * (u[mine].T @ u[mine])
                b = parts[mine, j].sum(0) + (eta - 1) * (u[mine] * (other[mine] + (parts[mine, j] * u[mine]).sum(1))[:, None]).sum(0)
                book.centroids[j, k] = np.linalg.solve(a, b)
            rest[:, j] = ((parts[:, j] - book.centroids[j, codes[:, j]]) * u).sum(1)
            total = other + rest[:, j]
    return book


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part: no null, zero or non-finite vectors."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", v.alias("vector")).where("vec_id is not null and vector is not null").where(finite).where(F.exists("vector", lambda x: x != 0))


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, added in the order of the components."""
    out = np.zeros(np.broadcast_shapes(x.shape, q.shape)[:-1])
    for k in range(x.shape[-1]):
        out += x[..., k] * q[..., k]
    return out


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Columns of each row's ``most`` highest scores; of equal ones the first."""
    n = scores.shape[1]
    if n <= most:
        return np.tile(np.arange(n), (len(scores), 1))
    edge = np.partition(scores, n - most, axis=1)[:, n - most]
    out = np.empty((len(scores), most), np.int64)
    for r, e in enumerate(edge):
        above = np.flatnonzero(scores[r] > e)
        out[r] = np.r_[above, np.flatnonzero(scores[r] == e)[: most - len(above)]]
    return out


def _packed_book(book: Codebook) -> bytes:
    return np.array([book.eta, *book.centroids.shape], "<f8").tobytes() + book.centroids.astype("<f8").tobytes()


def _book(packed: bytes) -> Codebook:
    eta, *shape = np.frombuffer(packed[:32], "<f8")
    return Codebook(np.frombuffer(packed[32:], "<f8").reshape([int(n) for n in shape]).copy(), float(eta))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """vec_ids, ascending, and vectors of rows of one length."""
    ids = rows["vec_id"].to_numpy()
    x = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _fit_rows(rows: pa.Table) -> pa.Table:
    ids, x = _matrix(rows)
    pick = np.argsort(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:MOST_TRAINING]
    return pa.table({"n": rows["n"][:1], "book": pa.array([_packed_book(fit(x[pick]))], pa.binary())})


def _code_rows(rows: pa.Table, books: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return pa.table({"n": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("ids", "codes", "data", "book")}})
    ids, x = _matrix(rows)
    book = books["book"][0].as_py()
    values = (ids.astype("<i8").tobytes(), pack_codes(_book(book).encode(x)).tobytes(), x.astype("<f8").tobytes(), book)
    return pa.table({"n": rows["n"][:1], "block": rows["block"][:1], **{c: pa.array([v], pa.binary()) for c, v in zip(("ids", "codes", "data", "book"), values, strict=True)}})


def _query_rows(rows: pa.Table) -> pa.Table:
    ids, x = _matrix(rows)
    return pa.table({"n": rows["n"][:1], "q_block": rows["q_block"][:1], "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "data": pa.array([x.astype("<f8").tobytes()], pa.binary())})


_FOUND = "n int, q_block long, q_pos int, query_id long, places binary, ids binary, scores binary"


def _shortlist(most: int):
    """The scan of one block of candidates for one block of queries: each query's best places by their codes."""

    def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {c: [] for c in ("n", "q_block", "q_pos", "query_id", "places", "ids", "scores")}
        for c, q in itertools.product(rows.to_pylist(), asked.to_pylist()):
            asking, ids = np.frombuffer(q["ids"], "<i8"), np.frombuffer(c["ids"], "<i8")
            x = np.frombuffer(q["data"], "<f8").reshape(len(asking), -1)
            codes, book = np.frombuffer(c["codes"], np.uint8).reshape(len(ids), -1), _book(c["book"])
            for at in range(0, len(asking), 128):
                who = asking[at : at + 128]
                scores = book.scan(codes, x[at : at + 128])
                scores[who[:, None] == ids[None]] = -np.inf
                for k, best in enumerate(_best(scores, most)):
                    best = best[scores[k, best] > -np.inf]
                    out["places"].append(((c["block"] << 32) + best).astype("<i8").tobytes())
                    out["ids"].append(ids[best].astype("<i8").tobytes())
                    out["scores"].append(scores[k, best].astype("<f4").tobytes())
                out["q_pos"] += range(at, at + len(who))
                out["query_id"] += who.tolist()
            out["n"] += [q["n"]] * len(asking)
            out["q_block"] += [q["q_block"]] * len(asking)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    return scan


def _merged(most: int):
    """The best of a query's shortlists, one row for each place; of equal codes the smaller ids, as of equal scores in the end."""

    def merge(rows: pa.Table) -> pa.Table:
        places, ids = (np.frombuffer(b"".join(x.as_py() for x in rows[c]), "<i8") for c in ("places", "ids"))
        scores = np.frombuffer(b"".join(x.as_py() for x in rows["scores"]), "<f4")
        keep = np.lexsort((ids, -scores))[:most]
        return pa.table({**{c: pa.array([rows[c][0].as_py()] * len(keep), t) for c, t in (("n", pa.int32()), ("q_block", pa.int64()), ("q_pos", pa.int32()), ("query_id", pa.int64()))}, "place": places[keep]})

    return merge


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, block, pos, id and vector (binary) of the rows of packed blocks."""
    for batch in batches:
        for n, block, ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(ids, "<i8")
            for at in range(0, len(ids), 4096):
                own = ids[at : at + 4096]
                parts = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * n), len(own), [None, pa.py_buffer(data[8 * n * at : 8 * n * (at + len(own))])]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), n, np.int32)), pa.array(np.full(len(own), block, np.int64)), pa.array(np.arange(at, at + len(own), dtype=np.int32)), pa.array(own), parts], ["n", "block", "pos", "id", "vector"]
                )


def _score_column(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = a.to_pylist(), b.to_pylist()
    out = np.empty(len(left))
    sizes = np.array([len(x) for x in left], np.int64)
    for n in np.unique(sizes).tolist():
        for at in np.array_split(np.flatnonzero(sizes == n), max(1, len(left) * n // (16 << 20))):
            x, y = (np.frombuffer(b"".join([side[k] for k in at.tolist()]), "<f8").reshape(len(at), -1) for side in (left, right))
            out[at] = exact_scores(x, y)
    return pa.array(out)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, book: Codebook | None = None, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding; rows that :func:`usable` leaves out take no part, and a query's candidates are the rows of
    its own length, of which there may be any number: code books and blocks are made for each.  A query's own vec_id is no
    candidate.  Ties go to the smaller vec_id.  Fewer candidates than ``k`` are all returned; repeated candidates count as
    often as they occur, and a repeated query is answered as often.  An empty table gives no rows.

    Every candidate's code is scanned for every query, blocks of codes against blocks of queries; the ``rerank`` best of all
    blocks are scored with the vectors, which are moved once for each of them and not for each query block.  ``book``, if
    given, is for the vectors' only length.
    """
    rerank = max(rerank, k)
    with_n = lambda frame: usable(frame).select(F.size("vector").alias("n"), F.col("vec_id").cast("long").alias("vec_id"), "vector")
    candidates, asked = with_n(vectors), with_n(queries)
    count = lambda frame, name: frame.groupBy("n").agg(F.count("*").alias(name))
    sizes = checkpoint(count(candidates, "rows").join(count(asked, "asked"), "n"))
    sizes = sizes.withColumns({"blocks": F.ceil(F.col("rows") / BLOCK), "q_blocks": F.ceil(F.col("asked") / QUERY_BLOCK)})
    dealt = candidates.join(sizes.select("n", "rows", "blocks"), "n").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    if book is None:
        share = F.pmod(F.xxhash64(F.lit("training"), "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        training = dealt.where(share * F.col("rows") <= 1.2 * MOST_TRAINING).select("n", "vec_id", "vector")
        books = table(training.groupBy("n").applyInArrow(_fit_rows, "n int, book binary"), "books")
    else:
        books = sizes.select("n", F.lit(_packed_book(book)).alias("book"))
    each = books.join(sizes.select("n", "blocks"), "n").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "book")
    coded = dealt.select("n", "block", "vec_id", "vector").groupBy("n", "block").cogroup(each.groupBy("n", "block"))
    blocks = table(coded.applyInArrow(_code_rows, "n int, block long, ids binary, codes binary, data binary, book binary"), "blocks")
    grouped = asked.join(sizes.select("n", "q_blocks"), "n").withColumn("q_block", F.pmod(F.xxhash64(F.lit("query"), "vec_id"), "q_blocks"))
    packs = table(grouped.select("n", "q_block", "vec_id", "vector").groupBy("n", "q_block").applyInArrow(_query_rows, "n int, q_block long, ids binary, data binary"), "asked")

    # A stated query set against all rows, in blocks: a group is a block of codes and a block of queries.
    every = lambda frame, name, n: frame.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))).drop(n)
    left = every(blocks.select("n", "block", "ids", "codes", "book").join(sizes.select("n", "q_blocks"), "n"), "q_block", "q_blocks")
    right = every(packs.join(sizes.select("n", "blocks"), "n"), "block", "blocks")
    keys = ("n", "block", "q_block")
    short = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_shortlist(rerank), _FOUND)
    wanted = short.groupBy("n", "q_block", "q_pos", "query_id").applyInArrow(_merged(rerank), "n int, q_block long, q_pos int, query_id long, place long")
    wanted = wanted.select("n", "q_block", "q_pos", "query_id", F.shiftright("place", 32).alias("block"), F.col("place").bitwiseAND(2**32 - 1).cast("int").alias("pos"))
    unpacked = lambda frame: frame.mapInArrow(_unpacked, "n int, block long, pos int, id long, vector binary")
    rows = unpacked(blocks.select("n", "block", "ids", "data")).withColumnRenamed("id", "vec_id")
    heads = unpacked(packs.select("n", "q_block", "ids", "data")).select("n", F.col("block").alias("q_block"), F.col("pos").alias("q_pos"), F.col("vector").alias("q_vector"))
    few = asked.limit(MOST_SENT_QUERIES + 1).count() <= MOST_SENT_QUERIES
    met = wanted.join(rows, ["n", "block", "pos"]).join(F.broadcast(heads) if few else heads, ["n", "q_block", "q_pos"])
    scored = met.select("n", "q_block", "q_pos", "query_id", "vec_id", F.arrow_udf(_score_column, "double")("vector", "q_vector").alias("score"))
    rank = F.row_number().over(W.partitionBy("n", "q_block", "q_pos").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
