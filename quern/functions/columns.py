"""Guarded arithmetic, hashes and identifiers, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: what a lambda refers to is computed anew for each element otherwise."""
    return F.transform(F.array(value), use)[0]


def ratio(numerator: Column, denominator: Column, empty: Column | float) -> Column:
    """numerator / denominator, and ``empty`` where the denominator is 0."""
    value = empty if isinstance(empty, Column) else F.lit(float(empty))
    return F.when(denominator == 0, value).otherwise(numerator.cast("double") / denominator)


def hash_order(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by ``|``: an order that no seed library is needed for."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def hash_int(text: Column) -> Column:
    """The first eight hex digits of the SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def group_digest(ids: Column, prefix: str = "dedup_") -> Column:
    """Stable id of a set of ids: ``prefix`` and 16 hex digits of the sorted ids' digest.  For use in an aggregation."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(ids)), "\n"), 256), 1, 16))


def case_identifier(sample_id: Column, prefix: str = "k3m_") -> Column:
    """Identifier of letters, digits and underscores; ``case`` follows a trailing underscore."""
    clean = F.concat(F.lit(prefix), F.regexp_replace(sample_id, "[^A-Za-z0-9_]", "_"))
    return F.when(clean.endswith("_"), F.concat(clean, F.lit("case"))).otherwise(clean)


def population_moments(value: Column) -> tuple[Column, Column]:
    return F.avg(value), F.stddev_pop(value)


def sample_sd(value: Column) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long arrays in moment form; 0 where either has no variance."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    var_a, var_b = n * product(a, a) - total(a) * total(a), n * product(b, b) - total(b) * total(b)
    return F.when((var_a <= 1e-12) | (var_b <= 1e-12), F.lit(0.0)).otherwise((n * product(a, b) - total(a) * total(b)) / F.sqrt(var_a * var_b))


def fixed_digits(value: Column, digits: int = 4, signed: bool = False) -> Column:
    """A number with so many decimals, with its sign if ``signed``; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%{'+' if signed else ''}.{digits}f", value))


def percent(value: Column, digits: int = 2) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f%%", 100 * value))


def utc_stamp(time: Column) -> Column:
    """ISO 8601 to the second with the offset of UTC; the session's time zone must be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) / F.lit(1e6) - F.unix_micros(start.cast("timestamp")) / F.lit(1e6)
