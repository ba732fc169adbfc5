"""N-gram Jaccard self join with adaptive multi-match prefixes.

Shingles are ordered by hash.  Two sets with Jaccard similarity of at least ``similarity`` share that part of either set, so
prefixes that are l longer than the shortest possible share at least l shingles (Wang, Li, Feng, "Can We Beat the Prefix
Filtering?", 2012).  Prefixes come in levels, up to the whole set, with an l for each.  Every document starts at level 0.
Where a list of its prefix foretells more than ``CHEAP`` candidates, its prefix is lengthened to the level whose estimated cost is
least: the lists that it joins, and the documents that it meets in them.  A longer prefix asks for more shared shingles, so fewer
and rarer ones need a list.
A pair is sought at the lower one of its documents' levels, at which both have a prefix, and must share as many shingles as
that level asks for before it is verified.

Candidates of one shingle are first compared with one of them only, the document with the least text of its own.  What is
linked that way needs no other comparison for its component; documents of a shingle that lie in different components are
then all compared.  Every comparison counts the exact intersection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.blocks import PACKED, Packer, begin, buckets_for, only, remembers, shared_keys, texts, trim
from quern.llm.text import WordHashes, runs
from quern.operators.components import connected_components
from quern.storage import checkpoint, table

WIDTH = 5
#: Similarity as a fraction, 3/4.
NUMERATOR, DENOMINATOR = 3, 4
#: Documents of a list at level 0 up to which its documents' prefixes stay short: as many candidates at least would come of it.
CHEAP = 32
#: At level 0 one shared shingle is asked for, and one more for each so many shingles.
STEP = 8
#: What the longer levels ask for, in quarters of the least overlap; the last level is the whole set.
QUARTERS = (1, 2, 4)
TOP = len(QUARTERS)

_hashes = WordHashes()
remembers("jaccard_join", _hashes.clear)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of fewer words, the one of all; of none, nothing."""
    words = _hashes.of(text.lower().split()) if text else np.empty(0, np.uint64)
    found = runs(words, min(width, len(words))) if len(words) else words
    return np.unique(found.view(np.int64))


def _overlap(n):
    """Shingles of a set of ``n`` that any similar set has at least; works on numbers and columns."""
    return -(-n * NUMERATOR // DENOMINATOR) if isinstance(n, int) else F.ceil(n * NUMERATOR / DENOMINATOR)


def _asked(level: int, n):
    """Shared shingles that ``level`` asks of a set of ``n``."""
    if level == 0:
        return 1 + n // STEP if isinstance(n, int) else 1 + F.floor(n / STEP)
    return -(-_overlap(n) * QUARTERS[level - 1] // 4) if isinstance(n, int) else F.ceil(_overlap(n) * QUARTERS[level - 1] / 4)


def _least_shared(level: int, n):
    """What any similar set shares with one of ``n`` in their prefixes of ``level``, at least: partners may be smaller."""
    return _overlap(n) if level == TOP else _asked(level, _overlap(n))


def _prefix(level: int, n):
    if isinstance(n, int):
        return n if level == TOP else min(n, n - _overlap(n) + _asked(level, n))
    return n if level == TOP else F.least(n, n - _overlap(n) + _asked(level, n))


def _by_level(function, n: Column, *more: Column) -> Column:
    """``function(level, n, ...)`` for the level in column t."""
    out = F.when(F.col("t") == TOP, function(TOP, n, *more))
    for level in range(TOP):
        out = out.when(F.col("t") == level, function(level, n, *more))
    return out


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard_join")
        packer = Packer(buckets)
        for doc_id, text in texts(batches):
            found = shingle_set(text)
            yield from packer.add(doc_id, found[: _prefix(0, len(found))].view(np.uint64), len(found))
        yield from packer.flush()
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _sets(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard_join")
        held, weight = [], 0
        for doc_id, text in texts(batches):
            held.append((doc_id, shingle_set(text)))
            weight += len(held[-1][1])
            if weight > 500_000:
                yield block(held)
                held, weight = [], 0
        if held:
            yield block(held)

    def block(held: list) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(s) for _, s in held]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s for _, s in held])))
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), lists], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<long>")


def _repacked(sets: DataFrame, buckets: int) -> DataFrame:
    """Whole sets, for the lengthened prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard_join")
        packer = Packer(buckets)
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                yield from packer.add(doc_id, values[ends[k] : ends[k + 1]].view(np.uint64), None)
        yield from packer.flush()
        trim()

    return sets.select("doc_id", "x").mapInArrow(run, PACKED)


def _reaches(common: Column, na: Column, nb: Column) -> Column:
    return DENOMINATOR * common >= NUMERATOR * (na + nb - common)


def _with_both(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with xa and xb, the arrays x of their documents; only those documents' arrays are moved."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = only(arrays, checkpoint(ids))
    left = needed.select(F.col("doc_id").alias("a"), F.col("x").alias("xa"))
    right = needed.select(F.col("doc_id").alias("b"), F.col("x").alias("xb"))
    return pairs.join(left, "a").join(right, "b")


def _verified(pairs: DataFrame, kept: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of ``pairs`` (t, a, b, na, nb).

    ``kept`` has the shared shingles of each document's prefix at each level.  At the last level the common ones among them
    are the intersection; else enough must be common for the sets themselves to be looked at.
    """
    common = F.size(F.array_intersect("xa", "xb"))
    left = kept.select("t", F.col("doc_id").alias("a"), F.col("x").alias("xa"))
    right = kept.select("t", F.col("doc_id").alias("b"), F.col("x").alias("xb"))
    enough = F.when(F.col("t") == TOP, _reaches(common, F.col("na"), F.col("nb"))).otherwise(common >= _by_level(lambda level, a, b: F.least(_asked(level, a), _asked(level, b)), F.col("na"), F.col("nb")))
    likely = table(pairs.join(left, ["t", "a"]).join(right, ["t", "b"]).where(enough).select("t", "a", "b", "na", "nb"), "likely")
    sure = likely.where(F.col("t") == TOP).select("a", "b")
    rest = likely.where(F.col("t") < TOP)
    if rest.isEmpty():
        return sure
    return table(sure.union(_with_both(rest, sets).where(_reaches(common, F.col("na"), F.col("nb"))).select("a", "b")), "links")


def _links(lists: DataFrame, kept: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the similar pairs among documents with a common key at a level connect.

    ``lists`` has t (level), key, doc_id, n (set size), own (rank for the choice of the document compared first), after (how
    many of the document's shared keys come behind this one) and higher: the document's level is a higher one, so this level
    finds its pairs only with documents of this level.  The first common key of a pair that shares enough has enough keys
    behind it in both documents; so a pair that no key shows with as many behind it needs no comparison.
    """
    needed = _by_level(lambda level, a, b: F.ceil((a + b) * NUMERATOR / (NUMERATOR + DENOMINATOR)) if level == TOP else F.least(_asked(level, a), _asked(level, b)), F.col("na"), F.col("nb"))
    worth = (DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb")) & (F.col("a") != F.col("b")) & (F.least("after_a", "after_b") + 1 >= needed) & ~(F.col("higher_a") & F.col("higher_b"))
    first_of = F.struct(F.col("a").alias("id"), F.col("na").alias("n"))
    other_of = F.struct(F.col("b").alias("id"), F.col("nb").alias("n"))
    lo, hi = F.least(first_of, other_of), F.greatest(first_of, other_of)
    ordered = lambda pairs: pairs.select("t", lo.alias("lo"), hi.alias("hi")).distinct().select("t", F.col("lo.id").alias("a"), F.col("hi.id").alias("b"), F.col("lo.n").alias("na"), F.col("hi.n").alias("nb"))

    def side(rows: DataFrame, x: str, *more: str) -> DataFrame:
        return rows.select("t", "key", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("after").alias(f"after_{x}"), F.col("higher").alias(f"higher_{x}"), *[F.col(m).alias(f"{m}_{x}") for m in more])

    centres = lists.groupBy("t", "key").agg(F.min(F.struct("higher", "own", "doc_id", "n", "after")).alias("c")).select("t", "key", "c.*")
    stars = table(ordered(side(lists, "b").join(side(checkpoint(centres), "a"), ["t", "key"]).where(worth)), "pairs")
    first = _verified(stars, kept, sets)
    component = checkpoint(connected_components(first, "a", "b"))
    placed = lists.join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = table(placed.select("t", "key", "doc_id", "n", "after", "higher", "component"), "placed")
    torn = checkpoint(placed.groupBy("t", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.bool_and("higher").alias("none")).where("lo < hi and not none").select("t", "key"))
    if torn.isEmpty():
        return first
    open_ = table(placed.join(torn, ["t", "key"]), "open")
    # Documents of a higher level meet each other there.
    met = side(open_.where("not higher"), "a", "component").join(side(open_, "b", "component"), ["t", "key"]).where("(higher_b or a < b) and component_a <> component_b").where(worth)
    rest = ordered(met).join(stars.select("t", "a", "b"), ["t", "a", "b"], "left_anti")
    return first.union(_verified(rest, kept, sets))


def _frequencies(found: DataFrame) -> DataFrame:
    """Number of documents of each key that several have, one of them at its own level."""
    return checkpoint(found.groupBy("t", "key").agg(F.count("*").alias("df"), F.bool_and("higher").alias("none")).where("df > 1 and not none").select("t", "key", "df"))


def _rarest(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posting lists and shared shingles of the documents that share as many shingles as their level asks for.

    ``found`` has t, key, doc_id, n and higher.  Documents that must share m shingles share one of all but the m - 1 last of
    each, in any common order; here the rarest come first.  Shingles that only dropped documents had besides can't be shared.
    """
    by_doc = W.partitionBy("t", "doc_id")
    needed = _by_level(_least_shared, F.col("n"))
    ranked = found.join(_frequencies(found), ["t", "key"]).withColumns({"rank": F.row_number().over(by_doc.orderBy("df", "key")), "left": F.count("*").over(by_doc)})
    ranked = table(ranked.where(F.col("left") >= needed), "ranked")
    lists = ranked.where(F.col("rank") <= F.col("left") - needed + 1).select("t", "key", "doc_id", "n", (F.col("n") - F.col("left")).alias("own"), (F.col("left") - F.col("rank")).alias("after"), "higher", "df")
    return lists, table(ranked.groupBy("t", "doc_id").agg(F.collect_list("key").alias("x")), "kept")


def _at_least_cost(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """Postings of the documents at all levels up to their own: t, key, doc_id, n and higher (the document's level is a higher one).

    ``keys`` has the shared shingles (key, doc_id) of whole sets.  Of what a prefix shares, the rarest need lists, all but as many
    as the level asks for less one.  Joining a list costs one, and so does each document met there.  Documents that share too
    little at level 1 have no partner at any level.
    """
    ends = sets.select("doc_id", F.size("x").alias("n"), *[F.element_at("x", _prefix(t, F.size("x")).cast("int")).alias(f"end{t}") for t in range(1, TOP)])
    first_level = F.coalesce(*[F.when(F.col("key") <= F.col(f"end{t}"), t) for t in range(1, TOP)], F.lit(TOP))
    found = table(keys.join(ends, "doc_id").select("key", "doc_id", F.col("n").cast("long").alias("n"), first_level.alias("from")), "whole")
    df = checkpoint(found.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    lists = found.join(df, "key").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "from"))).alias("l"))
    inside = lists.select("doc_id", "n", *[F.filter("l", lambda x: x["from"] <= t).alias(f"l{t}") for t in range(1, TOP + 1)])
    rarest = lambda t: F.slice(f"l{t}", 1, F.greatest(F.size(f"l{t}") - _least_shared(t, F.col("n")) + 1, F.lit(0)).cast("int"))
    cost = lambda t: F.aggregate(rarest(t), F.lit(0).cast("long"), lambda a, x: a + x["df"])
    best = F.array_min(F.array(*[F.struct(cost(t).alias("cost"), F.lit(t).alias("level")) for t in range(1, TOP + 1)]))["level"]
    alive = [F.size(f"l{t}") >= _least_shared(t, F.col("n")) for t in range(1, TOP + 1)]
    levels = table(inside.where(alive[0] & alive[-1]).select("doc_id", best.alias("level")), "levels")
    # Pairs are sought at levels that some document has chosen; no others need postings.
    chosen = [r["level"] for r in levels.select("level").distinct().collect()]
    places = F.filter(F.sequence("from", "level"), lambda t: t.isin(chosen))
    postings = found.join(levels, "doc_id").where("from <= level").withColumn("t", F.explode(places))
    return postings.select("t", "key", "doc_id", "n", (F.col("t") < F.col("level")).alias("higher"))


def _lengthened(sets: DataFrame, least: int) -> DataFrame:
    """Links among the documents whose prefixes are lengthened."""
    total = sets.agg(F.sum(F.size("x"))).first()[0] or 0
    again = shared_keys(_repacked(sets, buckets_for(total, 2 * least))).select("key", "doc_id").distinct()
    lists, kept = _rarest(table(_at_least_cost(again, sets), "held"))
    return _links(lists, kept, sets)


def _nodes(docs: DataFrame, by_text: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The different texts as nodes: h, rep (smallest doc_id) and node of each; doc_id (the node) and text; whether node and rep may differ.

    A node is its text's smallest doc_id.  Where a doc_id is repeated, its other texts get ids beyond all doc_ids.
    """
    classes = table(by_text.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    reps = checkpoint(classes.select(F.col("rep").alias("doc_id")).distinct())
    held = docs.where("text is not null")
    repeated = checkpoint(by_text.where("h is not null and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id").join(reps, "doc_id"))
    if repeated.isEmpty():
        return classes.withColumn("node", F.col("rep")), only(held, reps), False
    edge = docs.agg(F.max("doc_id").alias("most"), F.min("doc_id").alias("least")).first()
    more = F.monotonically_increasing_id()
    fresh = F.lit(edge["most"]) + 1 + more if edge["most"] < 1 << 62 else F.lit(edge["least"]) - 1 - more if edge["least"] > -(1 << 62) else F.xxhash64("h")
    crowd = classes.join(repeated, classes["rep"] == repeated["doc_id"]).drop("doc_id").withColumn("nth", F.row_number().over(W.partitionBy("rep").orderBy("h")))
    crowd = table(crowd.withColumn("node", F.when(F.col("nth") == 1, F.col("rep")).otherwise(fresh)).select("h", "rep", "node"), "crowd")
    nodes = table(classes.join(crowd.select("h", "node"), "h", "left").withColumn("node", F.coalesce("node", "rep")), "nodes")
    alone = only(held, checkpoint(reps.join(repeated, "doc_id", "left_anti")))
    texts_of = only(held, repeated).withColumn("h", F.md5(F.col("text").cast("binary"))).join(crowd, "h").where("doc_id = rep").dropDuplicates(["h"])
    return nodes, alone.select("doc_id", "text").unionByName(texts_of.select(F.col("node").alias("doc_id"), "text")), True


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and h (digest of the text) of the rows; h, rep, n_shingles, root (component) and component_id of each text with words."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_text = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    nodes, texts_of_nodes, apart = _nodes(docs, by_text)

    # About 6 characters a word and a third of the shingles in a prefix.
    words = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    found = table(shared_keys(_packed(texts_of_nodes, buckets_for(words // 3, 2 * least))), "shared")
    sizes = found.where("key is null").groupBy("doc_id").agg(F.max("size").alias("n"))
    keys = found.where("key is not null").select("key", "doc_id").distinct()
    enough = keys.groupBy("doc_id").agg(F.count("*").alias("k")).join(sizes, "doc_id").where(F.col("k") >= _least_shared(0, F.col("n")))
    alive = table(keys.join(enough, "doc_id").select(F.lit(0).alias("t"), "key", "doc_id", "n", F.lit(False).alias("higher")), "alive")
    lists, kept = _rarest(alive)
    marked = table(lists.withColumn("higher", F.max("df").over(W.partitionBy("doc_id")) > CHEAP), "marked")
    dear = checkpoint(marked.where("higher").select("doc_id").distinct())
    sets = table(_sets(only(texts_of_nodes, checkpoint(kept.select("doc_id").distinct()))), "sets")
    # A longer list has documents of higher levels only.
    links = _links(marked.where(F.col("df") <= CHEAP), kept, sets)
    if not dear.isEmpty():
        links = links.union(_lengthened(table(sets.join(dear, "doc_id", "left_semi"), "dear_sets"), least))
    component = checkpoint(connected_components(links, "a", "b"))
    placed = nodes.join(sizes.withColumnRenamed("doc_id", "node"), "node").join(component.withColumnRenamed("id", "node"), "node", "left").where("n > 0")
    placed = placed.select("h", "rep", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("root"))
    if apart:
        placed = table(placed, "placed")
        placed = placed.join(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "root")
    else:
        placed = placed.withColumn("component_id", F.col("root"))
    # Results by text are materialised: then both sides of the join on the text's digest are plain shuffles, of which Spark
    # may split the one that a large group of copies makes hot.
    return by_text, table(placed, "of_text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document of ``docs`` (doc_id, text).

    Null text and text without words have no shingles and are linked with nothing, not even with one another.  Equal texts
    are one node from the start.  Rows that repeat a doc_id stay rows of their own, each with its text's result.
    Texts are read whole, however long: one text's shingles (8 bytes a word) must fit into a task.
    A row without a doc_id links nothing; it has its text's result if another row has the same text, else 0 shingles and a null component.
    """
    by_text, of_text = _joined(docs.select(F.col("doc_id").cast("long"), "text"))
    placed = by_text.join(of_text, "h", "left")
    return placed.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: one with its smallest doc_id, of several such the one whose text's digest is least.

    Rows without words stay, and so do rows without a doc_id whose text no row with one has.  ``docs`` has doc_id and text;
    other columns are passed through.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by_text, of_text = _joined(narrow)
    rows = by_text.join(of_text, "h", "left")
    gone = table(rows.where("component_id <> coalesce(doc_id, component_id - 1)").select("doc_id", "h").distinct(), "gone")
    repeated = checkpoint(by_text.where("h is not null").groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"))
    if repeated.isEmpty():
        return docs.join(checkpoint(gone.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    # A doc_id that is repeated, or null, doesn't tell which of its rows stay: their texts do.  The row travels as one
    # struct, so its columns may have any names.
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.md5(F.col("text").cast("binary")).alias("d"))
    doubtful = repeated.withColumnRenamed("doc_id", "other")
    same = F.col("id").eqNullSafe(F.col("other"))
    plain = held.join(doubtful, same, "left_anti").join(gone.select(F.col("doc_id").alias("gone_id")), F.col("id") == F.col("gone_id"), "left_anti")
    least = rows.where("doc_id = component_id").groupBy("root").agg(F.min("h").alias("least"))
    hard = held.join(doubtful, same, "left_semi").join(of_text.join(least, "root").select("h", "component_id", "least"), F.col("d") == F.col("h"), "left")
    free = hard.where("h is null").select("row", "id", "d")
    kept = hard.where("id = component_id and d = least").dropDuplicates(["d"]).select("row", "id", "d")
    return plain.unionByName(free).unionByName(kept).select("row.*")
