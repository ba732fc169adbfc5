"""Exact duplicates by 128-bit content hashes, with the bytes of each group compared.

Pass one writes a digest for every row and groups the digests.  Pass two compares the texts of groups with several rows:
the smallest and the largest text of a group are aggregated, which tasks combine before the shuffle, so that a task sends
a group's bytes twice however many copies it has read.  Where they differ two texts share a hash, and that group is
judged by the texts themselves.  Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import checkpoint, table

#: Hashes of groups (8 bytes each) that are sent to all tasks, at most; more are joined by shuffle.
MOST_SENT_GROUPS = 1_000_000
#: Parts that the copies of one group are spread over where they are joined by shuffle.
SALTS = 32

Normalise = Callable[[Column], Column]


def _same(text: Column) -> Column:
    return text


def content_hash(text: Column) -> Column:
    """The 128-bit hash, as 16 bytes."""
    return F.unhex(F.md5(text))


def _read(docs: DataFrame, normalise: Normalise, digest: Normalise) -> DataFrame:
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", text.alias("text")).withColumn("hash", digest(F.encode("text", "UTF-8")))


def _groups(rows: DataFrame, keys: list[str], smallest: bool) -> DataFrame:
    """Keys of several rows with keep_id, keep_row and the number of rows; written, so that a join may split hot keys."""
    pick, pick_by = (F.min, F.min_by) if smallest else (F.max, F.max_by)
    kept = F.coalesce(pick_by("row", "doc_id"), F.min("row"))
    return checkpoint(rows.groupBy(*keys).agg(pick("doc_id").alias("keep_id"), kept.alias("keep_row"), F.count("*").alias("group_size")).where("group_size > 1"))


def _judged(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    renamed = groups.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    single = F.col("group_size").isNull()
    return rows.join(renamed, on, "left").select(
        "doc_id", "hash", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def colliding(texts: DataFrame, groups: DataFrame, most: int = MOST_SENT_GROUPS) -> DataFrame:
    """The hashes of ``groups`` under which ``texts`` (doc_id, text, hash) holds different bytes."""
    keys = groups.select(F.xxhash64("hash").alias("_short")).distinct()
    few = keys.limit(most + 1).count() <= most
    members = texts.join(F.broadcast(keys) if few else keys, F.xxhash64("hash") == F.col("_short"), "left_semi")
    least, largest = F.min("text").alias("a"), F.max("text").alias("z")
    if not few:
        # Whole texts were shuffled by hash just now; copies of one group are spread before they meet.
        members = members.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).repartition("hash", "_salt")
        members = members.groupBy("hash", "_salt").agg(least, largest)
        least, largest = F.min("a").alias("a"), F.max("z").alias("z")
    return members.groupBy("hash").agg(least, largest).where("a <> z").select("hash")


def judge(docs: DataFrame, smallest: bool = True, normalise: Normalise = _same, digest: Normalise = content_hash, most: int = MOST_SENT_GROUPS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs`` (doc_id, text; other columns don't matter).

    Texts are equal when identical after ``normalise``; a null text counts as empty, so null and empty texts are one
    group.  Of each group the row with the smallest (or largest) doc_id is kept.  Of rows that repeat both that doc_id and
    the text exactly one is kept; a doc_id that occurs with two texts belongs to two groups.  A null doc_id loses against
    any other; a group of nothing else keeps one row and has no keep_id.  An empty table gives no rows.  A text is read
    whole, however long.
    """
    texts = _read(docs, normalise, digest)
    sha = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha")
    rows = table(texts.select("doc_id", "hash", sha, F.monotonically_increasing_id().alias("row")), "digests")
    groups = _groups(rows, ["hash"], smallest)
    mixed = checkpoint(colliding(texts, groups, most))
    if mixed.isEmpty():
        return _judged(rows, groups, ["hash"])
    # The hashes that different texts share: such rows are grouped by their texts, the others by their hashes.
    own = table(texts.join(mixed, "hash", "left_semi").select("doc_id", "hash", "text", sha, F.monotonically_increasing_id().alias("row")), "collisions")
    apart = _judged(own, _groups(own, ["hash", "text"], smallest), ["hash", "text"])
    return _judged(rows.join(mixed, "hash", "left_anti"), groups, ["hash"]).unionByName(apart)


def deduplicate(docs: DataFrame, smallest: bool = True, normalise: Normalise = _same) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns; of rows that repeat a doc_id and a text, one.

    Rows that aren't in any group pass without being compared again.
    """
    names = docs.columns
    kept = judge(docs, smallest, normalise).where("kept")
    once = kept.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), (F.col("group_size") > 1).alias("_several"))
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    found = docs.withColumn("_own", F.sha2(F.encode(text, "UTF-8"), 256)).join(once, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")))
    found = checkpoint(found.select(*names, "_own", "_several"))
    again = found.where("_several").dropDuplicates(["_own"])
    return found.where("not _several").unionByName(again).select(*names)
