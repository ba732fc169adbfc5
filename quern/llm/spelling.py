"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of words.

An edit leaves one half of a word as it is, at the start or at the end of the other word.  Shards hold the halves of
words by the half's hash; a word is scanned by the shards of the halves that a word of its length, or one more or less,
would leave in it.  A hit counts where its offset and the lengths fit; then the pair is verified.  Halves that many words
share are dealt in blocks, so that no shard grows with them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import begin, trim
from quern.storage import checkpoint, table

#: UTF-8 of runs of A-Z, a-z and U+00C0..U+00FF, lower-cased as bytes.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LEAST_LETTERS = 6
LEAST_SEEN = 5
#: A form must occur so many times as often as the word.
RATIO = 5
#: One of so many (document, word) pairs is damaged.
DAMAGED = 199
#: Different words that a task holds before it sends their counts on (about 150 bytes each).
HELD_WORDS = 400_000
#: Rows of a shard on average, and words that share a half from which the half is dealt in blocks.
SHARD_ROWS = 100_000
BLOCK_WORDS = 20_000
#: Halves dealt in blocks that are sent to all tasks, at most; more are joined by shuffle.
MOST_SENT_HALVES = 500_000
#: Characters that are compared together.
COMPARED = 2_000_000


def _damage(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(docs: DataFrame, damaged: int = DAMAGED, least_seen: int = LEAST_SEEN, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word and n (occurrences in ``docs``), for words long and frequent enough, written once.

    Words are the runs of basic Latin and Latin-1 letters (U+00C0..U+00FF) of whole texts, A-Z lower-cased.  Where
    ``damaged`` divides the CRC-32 h of ``<doc_id>:<word>``, the letter at h modulo the length is left out.  A null doc_id
    counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("spelling")
        held: Counter[bytes] = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            rows = [(w, n) for w, n in held.items() if len(w) >= least_letters and (w.isascii() or len(w.decode()) >= least_letters)]
            for at in range(0, len(rows), 100_000):
                w, n = zip(*rows[at : at + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(_RUN.findall(text.as_py().lower())).items():
                    h = zlib.crc32(word, start)
                    held[word if h % damaged else _damage(word, h)] += n
                if len(held) >= HELD_WORDS:
                    yield from sent()
        yield from sent()
        trim()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return table(counted.where(F.col("n") >= least_seen), "words")


def _half(word: Column, right: bool, length: Column) -> Column:
    """Of a word of ``length`` letters, the half that ``word`` has if it ends up at its start (or end)."""
    left = F.floor(length / 2).cast("int")
    return F.right(word, (length - left).cast("int")) if right else F.left(word, left)


def _placed(words: DataFrame, shards: int, block: int) -> DataFrame:
    """shard, held (the shard's automaton holds this half of the word; otherwise the word is scanned), right, word and n."""
    length = F.length("word")
    mine = [F.struct(F.lit(True).alias("held"), F.lit(r).alias("right"), _half(F.col("word"), r, length).alias("half")) for r in (False, True)]
    near = [F.struct(F.lit(False).alias("held"), F.lit(r).alias("right"), _half(F.col("word"), r, length + d).alias("half")) for r in (False, True) for d in (-1, 0, 1)]
    routes = words.select("word", "n", F.explode(F.concat(F.array(*mine), F.array_distinct(F.array(*near)))).alias("x")).select("word", "n", "x.*")
    crowded = checkpoint(routes.groupBy("right", "half").agg(F.count("*").alias("c")).where(F.col("c") > block).select(F.col("right").alias("_r"), F.col("half").alias("_h"), F.ceil(F.col("c") / block).alias("blocks")))
    few = crowded.limit(MOST_SENT_HALVES + 1).count() <= MOST_SENT_HALVES
    routed = routes.join(F.broadcast(crowded) if few else crowded, (F.col("right") == F.col("_r")) & (F.col("half") == F.col("_h")), "left")
    own = F.pmod(F.xxhash64("word"), "blocks")
    all_blocks = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    routed = routed.withColumn("k", F.explode(all_blocks))
    # A block of holders meets each block of scanned words in a shard of its own.
    cell = F.when(F.col("held"), F.struct(own.alias("i"), F.col("k").alias("j"))).otherwise(F.struct(F.col("k").alias("i"), own.alias("j")))
    plain = F.pmod(F.xxhash64("right", "half"), F.lit(shards))
    shard = F.when(F.col("blocks").isNull(), plain).otherwise(F.lit(shards) + F.pmod(F.xxhash64("right", "half", cell), F.lit(2**40)))
    return routed.select(shard.alias("shard"), "held", "right", "word", "n")


def _verified(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, u: np.ndarray, v: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether u and v are exactly one edit apart, by their letters; pairs met at a right half also when the left one fits are left to that."""
    longer = lengths[u] > lengths[v]
    s, t = np.where(longer, v, u), np.where(longer, u, v)
    n, d = lengths[s], lengths[t] - lengths[s]
    ends = np.cumsum(n)
    begins = ends - n
    k = np.arange(int(ends[-1])) - np.repeat(begins, n)
    letters = codes[np.repeat(starts[s], n) + k]
    far = np.repeat(starts[t], n) + k
    top = np.repeat(n, n)
    first = np.minimum.reduceat(np.where(letters != codes[far], k, top), begins)
    last = np.maximum.reduceat(np.where(letters != codes[far + np.repeat(d, n)], k, -1), begins)
    near = np.where(d == 0, first == last, last < first)
    return near & ~(right & (first >= lengths[u] // 2))


def _scan(rows: pa.Table) -> pa.Table:
    """word, near, n and form (the best near word) for the words that a shard's automaton finds near words for."""
    import ahocorasick

    begin("spelling")
    held = rows["held"].to_numpy()
    right = rows["right"].to_numpy()
    coded = rows["word"].combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    words = coded.dictionary.to_pylist()
    amounts = np.zeros(len(words), np.int64)
    amounts[at] = rows["n"].to_numpy()
    sizes = list(map(len, words))
    #: half -> number; for each number the words by (right, length).
    numbers: dict[str, int] = {}
    holders: list[dict[tuple[bool, int], list[int]]] = []
    for w, r in zip(at[held].tolist(), right[held].tolist(), strict=True):
        half = words[w][sizes[w] // 2 :] if r else words[w][: sizes[w] // 2]
        k = numbers.setdefault(half, len(numbers))
        if k == len(holders):
            holders.append({})
        holders[k].setdefault((r, sizes[w]), []).append(w)
    lists = [{key: np.array(x, np.int64) for key, x in h.items()} for h in holders]
    automaton = ahocorasick.Automaton()
    for half, k in numbers.items():
        automaton.add_word(half, (k, len(half)))
    automaton.make_automaton()
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.array(sizes, np.int64)
    starts = np.cumsum(lengths) - lengths
    near, found_u, found_v = [], [], []
    held_chars = 0

    def compared() -> None:
        u = np.concatenate([x for x, _, _ in near])
        v = np.repeat(np.array([x for _, x, _ in near]), [len(x) for x, _, _ in near])
        r = np.repeat(np.array([x for _, _, x in near]), [len(x) for x, _, _ in near])
        good = _verified(codes, starts, lengths, u, v, r)
        found_u.append(u[good])
        found_v.append(v[good])
        near.clear()

    if numbers:
        for w in np.unique(at[~held]).tolist():
            size = sizes[w]
            for end, (k, length) in automaton.iter(words[w]):
                sides = ([False] if end + 1 == length else []) + ([True] if end + 1 == size else [])
                for r in sides:
                    for other in (size - 1, size, size + 1):
                        few = lists[k].get((r, other))
                        if few is not None:
                            near.append((few, w, r))
                            held_chars += len(few) * size
                if held_chars >= COMPARED:
                    compared()
                    held_chars = 0
    if near:
        compared()
    u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (found_u, found_v))
    # The best near word: most frequent, then first in the order of the letters.
    place = np.empty(len(words), np.int64)
    place[np.argsort(np.array(words, object), kind="stable")] = np.arange(len(words))
    order = np.lexsort((place[u], -amounts[u], v))
    u, v = u[order], v[order]
    heads = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, np.int64)
    counts = np.diff(np.r_[heads, len(v)])
    take = lambda x: pa.array([words[k] for k in x.tolist()], pa.string())
    return pa.table({"word": take(v[heads]), "near": pa.array(counts, pa.int64()), "n": pa.array(amounts[u[heads]]), "form": take(u[heads])})


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS, block: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, best_n and best (the most frequent near word, of several the first in code-point order) for the words
    of ``words`` (word, n; distinct) that are exactly one inserted, deleted or replaced code point from another."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * parts, -(-8 * words.count() // shard_rows))
    found = _placed(words, shards, block).groupBy("shard").applyInArrow(_scan, "word string, near long, n long, form string")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("form")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.form").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root: forms followed to the last, in doubling steps; each form is ``RATIO`` times as frequent, so chains are short."""
    current = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = checkpoint(current.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def variants(docs: DataFrame, ratio: int = RATIO, damaged: int = DAMAGED, least_seen: int = LEAST_SEEN, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of :func:`count_words`.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times
    the word's; root follows forms to the last and is the word itself where there is none.  Null and empty texts have no
    words; repeated rows count as often as they occur; an empty table gives no rows; other columns don't matter.  A run of
    letters may have any length.
    """
    words = count_words(docs, damaged, least_seen, least_letters)
    near = near_words(words).withColumnRenamed("word", "_near")
    fits = F.col("best_n") >= F.lit(ratio) * F.col("n")
    judged = words.join(near, F.col("word") == F.col("_near"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    judged = table(judged, "variants")
    roots = _roots(judged.where("form is not null")).withColumnRenamed("word", "_word")
    return judged.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
