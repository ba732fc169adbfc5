"""Pairing, duplicates, leakage and issue lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from quern.storage import checkpoint


def pair_up(images: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairing with ``status``: paired, missing_mask or orphan_mask."""
    left, right = images.withColumn("_i", F.lit(1)), masks.withColumn("_m", F.lit(1))
    status = F.when(F.col("_m").isNull(), "missing_mask").when(F.col("_i").isNull(), "orphan_mask").otherwise("paired")
    return left.join(right, keys, "full_outer").withColumn("status", status).drop("_i", "_m")


def unpaired(pairs: DataFrame, keys: list[str], preview: int = 10) -> DataFrame:
    """status and keys of the first rows of :func:`pair_up` in order that have no partner."""
    return pairs.where("status <> 'paired'").orderBy(*keys).limit(preview).select("status", *keys)


def assert_paired(pairs: DataFrame, keys: list[str], preview: int = 10) -> DataFrame:
    """``pairs`` of :func:`pair_up`, or an error that names the first unpaired keys."""
    bad = unpaired(pairs, keys, preview).collect()
    if bad:
        raise ValueError(f"unpaired rows: {[tuple(r) for r in bad]}")
    return pairs.drop("status")


def missing_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


#: Rows that one row is written out as at a time.
_REPEATS = 4096


def one_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """kind and keys: the rows of ``left`` that :func:`missing_in` ``right`` gives as missing, and the other way round,
    each key once, as orphan.

    Both sides meet in one aggregation, which holds a number and a mark for each key; nothing is sorted or joined.
    """
    side = lambda rows, n: rows.select(*keys, F.lit(n).cast("long").alias("_l"), F.lit(n == 0).alias("_r"))
    met = side(left, 1).unionByName(side(right, 0)).groupBy(*keys).agg(F.sum("_l").alias("_l"), F.bool_or("_r").alias("_r"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])  # such keys have no partner
    missing, orphan = (F.col("_l") > 0) & (~F.col("_r") | null), F.col("_r") & ((F.col("_l") == 0) | null)
    kinds = F.array_compact(F.array(F.when(missing, F.struct(F.lit("missing").alias("kind"), F.col("_l").alias("_n"))), F.when(orphan, F.struct(F.lit("orphan").alias("kind"), F.lit(1).cast("long").alias("_n")))))
    found = met.where(missing | orphan).select(*keys, F.inline(kinds))
    blocks = found.select("kind", *keys, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _REPEATS))).alias("_b"))
    return blocks.select("kind", *keys, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_REPEATS).cast("long"), F.col("_n") - F.col("_b") * _REPEATS))).alias("_")).select("kind", *keys)


def with_test_twin(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Training rows whose group also has a test row."""
    return train.join(test.select(group).distinct(), group, "left_semi")


def exclude_groups(rows: DataFrame, group: str, bad: Column) -> DataFrame:
    """``rows`` without every group that has a bad row."""
    return rows.join(rows.where(bad).select(group).distinct(), group, "left_anti")


def exact_groups(rows: DataFrame, content: str, *others: str) -> DataFrame:
    """Groups of equal content: size, and the number of different values of each other column."""
    return rows.groupBy(content).agg(F.count("*").alias("group_size"), *[F.count_distinct(c).alias(f"n_{c}") for c in others]).where("group_size > 1")


def members(rows: DataFrame, groups: DataFrame, content: str, kind: str) -> DataFrame:
    """The rows of duplicate groups, tagged with ``kind``; the content key is hash-partitioned once."""
    return rows.join(groups.select(content, "group_size"), content).withColumn("kind", F.lit(kind))


def tagged_members(rows: DataFrame, contents: dict[str, str]) -> DataFrame:
    """The rows of the duplicate groups of every kind of content, with ``kind``, ``hash`` and ``group_size``.

    ``contents`` names the column with the digest of each kind, null where a row has no such content.  All kinds are counted
    and met in one pass over (kind, hash); a row is there once for each kind in which it has an equal.
    """
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("hash")) for kind, c in contents.items()])
    wide = rows.select("*", F.inline(kinds)).where("hash is not null")
    groups = checkpoint(wide.groupBy(F.col("kind").alias("_kind"), F.col("hash").alias("_hash")).agg(F.count("*").alias("group_size")).where("group_size > 1"))
    return wide.join(groups, (F.col("kind") == F.col("_kind")) & (F.col("hash") == F.col("_hash"))).drop("_kind", "_hash")


def leaking(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows in several splits."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("n_splits"), F.array_sort(F.collect_set(split)).alias("splits")).where("n_splits > 1")


def component_sizes(components: DataFrame, component: str = "component") -> DataFrame:
    return components.groupBy(component).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def issue_list(rows: DataFrame, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """severity, code, count and detail of each rule that some row breaks; all rules in one scan."""
    counts = rows.agg(*[F.count_if(bad).alias(f"r{k}") for k, (_, _, bad, _) in enumerate(rules)])
    entries = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.col(f"r{k}").alias("count"), F.lit(d).alias("detail")) for k, (s, c, _, d) in enumerate(rules)])
    return counts.select(F.inline(entries)).where("count > 0")


def combine_issues(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, lists)


def transition_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("count"))


def split_shares(rows: DataFrame, split: str = "split") -> DataFrame:
    counts = rows.groupBy(split).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("count") / F.col("total")).drop("total")


def comparable(runs: DataFrame, fingerprint: Column, count: Column, expected_fingerprint: str, expected_count: int, *metrics: str) -> DataFrame:
    """``status`` of each run; metrics are null unless data and count are the expected ones."""
    status = F.when(fingerprint.isNull(), "missing").when(fingerprint != expected_fingerprint, "different_data").when(count != expected_count, "different_count").otherwise("comparable")
    out = runs.withColumn("status", status)
    return out.withColumns({m: F.when(F.col("status") == "comparable", F.col(m)) for m in metrics})


def slice_key(patient: Column, number: Column) -> Column:
    """The key that manifests and audit rows share: patient__slice_n."""
    return F.concat(patient, F.lit("__slice_"), number.cast("string"))


def matched(left: DataFrame, right: DataFrame, key: str, preview: int = 10) -> DataFrame:
    """Inner join in which every left row must find a partner; else an error that names the first keys without one."""
    missing = left.join(right.select(key), key, "left_anti").select(key).orderBy(key).limit(preview).collect()
    if missing:
        raise ValueError(f"no partner for {[r[0] for r in missing]}")
    return left.join(right, key)


def without_date(folder: Column) -> Column:
    """A folder name without the eight digits of a date at its end."""
    return F.regexp_replace(folder, "_[0-9]{8}$", "")


def unreferenced(files: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """Files that the manifest doesn't name, whatever the case of the names."""
    named = manifest.select(F.lower(path).alias("_lower")).distinct()
    return files.join(named, F.lower(files[path]) == named["_lower"], "left_anti")


def verify_files(manifest: DataFrame, files: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """The rows of ``manifest`` whose file is missing or has another digest, with ``problem``."""
    found = files.select(F.col(path).alias("_path"), F.col(digest).alias("_digest"))
    problem = F.when(F.col("_digest").isNull(), "missing_file").when(F.col("_digest") != F.col(digest), "digest_differs")
    return manifest.join(found, manifest[path] == found["_path"], "left").withColumn("problem", problem).where("problem is not null").drop("_path", "_digest")


def unified(sources: list[tuple[DataFrame, dict[str, str | Column]]], classes: dict[str, str], code: str) -> DataFrame:
    """One table from differently shaped sources: each comes with its column for every name; class codes become class names.

    A code that ``classes`` doesn't have is an error when read.
    """
    names = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    known = F.element_at(names, F.col(code))
    checked = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown class code: "), F.coalesce(F.col(code), F.lit("null")))))
    parts = [frame.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]).withColumn(code, checked) for frame, columns in sources]
    return reduce(DataFrame.unionByName, parts)


def numeric_order(rows: DataFrame, within: str, text: str) -> DataFrame:
    """``rows`` numbered from 1 within a class, by a text column read as a number; what isn't one comes last, by text."""
    number = F.col(text).try_cast("long")
    return rows.withColumn("position", F.row_number().over(W.partitionBy(within).orderBy(number.asc_nulls_last(), text)))


def with_cohort(clean: DataFrame, old: DataFrame, key: str, metric: str) -> DataFrame:
    """``clean`` with the metric of the older cohort by experiment, null where it has none, and the difference."""
    earlier = old.select(key, F.col(metric).alias(f"old_{metric}"))
    return clean.join(earlier, key, "left").withColumn(f"{metric}_change", F.col(metric) - F.col(f"old_{metric}"))


#: Severity, code, condition and detail of the rules for pairs of 512 x 512 images and masks.
SEGMENTATION_RULES = (
    ("critical", "content_hash_mismatch", "actual_image_sha256 <> image_sha256 or actual_mask_sha256 <> mask_sha256", "File bytes differ from the manifest."),
    ("high", "bad_dimensions", "image_width <> 512 or image_height <> 512 or mask_width <> 512 or mask_height <> 512", "Image or mask is not 512x512."),
    ("medium", "unexpected_bit_depth", "image_bpp <> 8 or mask_bpp <> 8", "Image or mask is not decoded as 8-bit."),
    ("high", "invalid_masks", "not mask_binary or foreground_pixels = 0 or foreground_pixels = 262144", "Mask is non-binary, empty or full."),
    ("medium", "low_information_images", "image_distinct_values < 16 or image_stddev < 5", "Image has under 16 values or a standard deviation below 5."),
)
#: The same for slices of 256 x 256 with three channels.
SLICE_RULES = (
    ("high", "bad_dimensions", "image_width <> 256 or image_height <> 256 or mask_width <> 256 or mask_height <> 256", "Image or mask is not 256x256."),
    ("high", "invalid_masks", "not mask_binary", "Mask is non-binary."),
    ("info", "empty_masks", "foreground_pixels = 0", "Mask is empty."),
    ("medium", "full_masks", "foreground_pixels = 65536", "Mask is full."),
    ("medium", "low_information_images", "red_sd < 3 and green_sd < 3 and blue_sd < 3", "All channels have a standard deviation below 3."),
)


def rule_issues(rows: DataFrame, rules: tuple[tuple[str, str, str, str], ...]) -> DataFrame:
    return issue_list(rows, [(severity, code, F.expr(condition), detail) for severity, code, condition, detail in rules])
