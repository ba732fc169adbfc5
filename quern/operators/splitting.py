"""Assignment of groups to splits without leakage.

Allocation is greedy and sequential within a stratum: its groups, which are far fewer than rows, pass through one task in
order, and each is assigned as it passes.  Strata are independent and run in parallel.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.columns import hash_int, hash_order
from quern.operators.folds import Step, in_order
from quern.schemas import SPLITS
from quern.storage import checkpoint, table

RATIOS = (0.70, 0.15, 0.15)
#: Digests in a leaf of a fingerprint's tree, on average at most.
LEAF = 256


def _with_totals(groups: DataFrame, strata: list[str], **totals: str) -> DataFrame:
    """``groups`` with the sums of fields over their stratum."""
    sums = groups.groupBy(*[F.col(s).alias(f"_{s}") for s in strata]).agg(*[F.sum(field).alias(name) for name, field in totals.items()])
    on = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in strata]
    return groups.join(sums, on).drop(*[f"_{s}" for s in strata])


def _digest(*parts: str | None) -> str:
    """The same order as ``hash_order``, where nulls are left out."""
    return hashlib.sha256("|".join(p for p in parts if p is not None).encode()).hexdigest()


def allocate_by_deficit(rows: DataFrame, strata: list[str], seed: int | Column, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """group_id and split within each stratum.

    Groups come by size, largest first, ties by hash; each goes to the split with the largest deficit relative to its
    target, ties by hash of group and split.  ``seed`` may be an expression over the strata.
    """
    seed = (seed if isinstance(seed, Column) else F.lit(seed)).cast("string")
    groups = rows.groupBy(*strata, "group_id").agg(F.count("*").alias("size")).withColumns({"g": F.col("group_id").cast("string"), "seed": seed})
    tie = hash_order(F.col("seed"), F.concat_ws(", ", *strata), F.col("group_id"))

    def start() -> Step:
        have = [0] * len(SPLITS)

        def step(row: tuple) -> tuple:
            group, size, total, seed = row
            deficits = [round((r * total - h) / max(r * total, 1.0), 12) for r, h in zip(ratios, have, strict=True)]
            best = [k for k, d in enumerate(deficits) if d == max(deficits)]
            chosen = best[0] if len(best) == 1 else min(best, key=lambda k: _digest(seed, group, SPLITS[k]))
            have[chosen] += size
            return group, SPLITS[chosen]

        return step

    order = [-F.col("size"), tie, F.col("group_id")]
    return in_order(_with_totals(groups, strata, total="size"), strata, order, ["g", "size", "total", "seed"], start, "group_id string, split string")


def allocate_stratified(rows: DataFrame, label: str, seed: int, ratios: tuple[float, float, float] = RATIOS, preview: int = 10) -> DataFrame:
    """group_id and split of whole groups by class, with the guards that a training set needs.

    Each class has its own seed, ``seed`` and a digest of its name.  Ratios that don't sum to 1, a group of several classes, a class
    with fewer than three groups and one that leaves a split empty are errors.
    """
    if len(ratios) != len(SPLITS) or abs(sum(ratios) - 1) > 1e-8:
        raise ValueError("three ratios must sum to 1")
    groups = rows.groupBy("group_id").agg(F.count_distinct(label).alias("n"))
    if mixed := [r[0] for r in groups.where("n > 1").orderBy("group_id").limit(preview).collect()]:
        raise ValueError(f"groups of several classes: {mixed}")
    if few := [r[0] for r in rows.groupBy(label).agg(F.count_distinct("group_id").alias("n")).where(F.col("n") < len(SPLITS)).orderBy(label).limit(preview).collect()]:
        raise ValueError(f"classes with fewer than {len(SPLITS)} groups: {few}")
    assigned = checkpoint(allocate_by_deficit(rows, [label], F.lit(seed) + hash_int(F.col(label)), ratios))
    if empty := [r[0] for r in assigned.groupBy(label).agg(F.count_distinct("split").alias("n")).where(F.col("n") < len(SPLITS)).orderBy(label).limit(preview).collect()]:
        raise ValueError(f"classes with an empty split: {empty}")
    return assigned


def allocate_by_error(rows: DataFrame, positive: Column, seed: int, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """group_id and split over the whole cohort, balancing samples and positive samples.

    The order is one for all groups, so they pass through one task, with six sums for a state.  Groups come by size, then positives, then hash; each goes where the sum over splits of both squared relative errors is
    least, the first unless another is better by 1e-12.
    """
    groups = rows.groupBy("group_id").agg(F.count("*").alias("size"), F.count_if(positive).alias("pos")).withColumns({"stratum": F.lit("all"), "g": F.col("group_id").cast("string")})
    order = [-F.col("size"), -F.col("pos"), hash_order(str(seed), F.col("group_id")), F.col("group_id")]

    def start() -> Step:
        have = [[0, 0] for _ in SPLITS]

        def step(row: tuple) -> tuple:
            group, size, pos, *whole = row

            def error(chosen: int) -> float:
                total = None
                for k, ratio in enumerate(ratios):
                    for f, add in enumerate((size, pos)):
                        off = (have[k][f] + (add if k == chosen else 0) - ratio * whole[f]) / max(ratio * whole[f], 1.0)
                        total = off * off if total is None else total + off * off
                return total

            chosen, least = 0, error(0)
            for k in range(1, len(SPLITS)):
                if (e := error(k)) < least - 1e-12:
                    chosen, least = k, e
            have[chosen][0] += size
            have[chosen][1] += pos
            return group, SPLITS[chosen]

        return step

    return in_order(_with_totals(groups, ["stratum"], n="size", np="pos"), ["stratum"], order, ["g", "size", "pos", "n", "np"], start, "group_id string, split string").drop("stratum")


def allocate_validation(rows: DataFrame, stratum: str, seed: int, share: float = 0.18) -> DataFrame:
    """group_id and split (train or val) of the rows that a frozen test set leaves.

    By stratum, groups in hash order go to val while that doesn't move its size further from the rounded target.
    """
    groups = rows.groupBy(stratum, "group_id").agg(F.count("*").alias("size")).withColumn("g", F.col("group_id").cast("string"))
    order = [hash_order(str(seed), F.col(stratum), F.col("group_id")), F.col("group_id")]
    totals = _with_totals(groups, [stratum], total="size").withColumn("target", F.round(F.lit(share) * F.col("total"), 0))

    def start() -> Step:
        have = 0

        def step(row: tuple) -> tuple:
            nonlocal have
            group, size, target = row
            take = abs(have + size - target) <= abs(have - target)
            have += size if take else 0
            return group, "val" if take else "train"

        return step

    return in_order(totals, [stratum], order, ["g", "size", "target"], start, "group_id string, split string")


def preserve(assigned: DataFrame, group: str, bad: Column) -> DataFrame:
    """An existing assignment without every group that has a bad row."""
    return assigned.join(assigned.where(bad).select(group).distinct(), group, "left_anti")


def validate(rows: DataFrame, sample: str = "sample_id", group: str = "group_id", split: str = "split") -> DataFrame:
    """check and violations: duplicate ids, unknown splits, leaking groups and empty splits."""
    ids = rows.groupBy(sample).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    unknown = rows.agg(F.count_if(~F.col(split).isin(*SPLITS) | F.col(split).isNull()).alias("violations"))
    leaks = rows.groupBy(group).agg(F.count_distinct(split).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    empty = rows.agg((F.lit(len(SPLITS)) - F.count_distinct(F.when(F.col(split).isin(*SPLITS), F.col(split)))).alias("violations"))
    parts = [("duplicate_ids", ids), ("unknown_split", unknown), ("leaking_groups", leaks), ("empty_splits", empty)]
    out = None
    for name, part in parts:
        part = part.select(F.lit(name).alias("check"), F.col("violations").cast("long").alias("violations"))
        out = part if out is None else out.unionByName(part)
    return out


def fingerprint(rows: DataFrame, *columns: str, trailing_newline: bool = True) -> DataFrame:
    """Digest of the records in order, and their number.

    Equal records count together, as ``digest:number``.  The sorted digests are the leaves of a tree: as many hex digits as
    make leaves of LEAF digests or fewer on average, then a level for each digit.  The depth follows from the number of
    different records, so equal tables have equal fingerprints in any partitioning, and no list grows with the table.
    """
    end = "\n" if trailing_newline else ""
    record = F.sha2(F.concat(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(end)), 256)
    digests = table(rows.select(record.alias("d")).groupBy("d").agg(F.count("*").alias("n")), "digests")
    different, depth = digests.count(), 0
    while 16**depth * LEAF < different:
        depth += 1
    level = digests.select(F.substring("d", 1, depth).alias("p"), "d", F.concat_ws(":", "d", "n").alias("x"), "n")
    for digits in range(depth, -1, -1):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda y: y["x"]), "\n")
        level = level.groupBy("p").agg(F.sha2(joined, 256).alias("x"), F.sum("n").alias("n")).select(F.substring("p", 1, max(digits - 1, 0)).alias("p"), F.col("p").alias("d"), "x", "n")
    empty = F.sha2(F.lit(""), 256)
    return level.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"), F.coalesce(F.max("x"), empty).alias("fingerprint"))


def renumber(rows: DataFrame, within: str, *order: str) -> DataFrame:
    """New ids from 1 in each class."""
    return rows.withColumn("new_id", F.row_number().over(W.partitionBy(within).orderBy(*order)))
