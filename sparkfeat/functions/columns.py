"""Column-expression helpers shared by the operators.

Everything here returns a ``Column`` built from built-in functions, so it stays inside
whole-stage codegen and works in batch and streaming plans alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name, SQL expression string or Column."""
    if isinstance(c, Column):
        return c
    return F.expr(c)


def truthy(cond: Column) -> Column:
    """A predicate where NULL counts as False (pandas comparison semantics)."""
    return F.coalesce(cond, F.lit(False))


def pass_rate(cond: Column) -> Column:
    """Share of *all* rows that satisfy ``cond``; NULL → fail (pandas ``mask.mean()``)."""
    return F.avg(F.when(truthy(cond), F.lit(1.0)).otherwise(F.lit(0.0)))


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, ``default`` when the denominator is 0 or NULL (ANSI-safe)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def exact_total(c: Column) -> Column:
    """Sum in decimals of nine places, so that it does not depend on the order of the rows. NaN counts as missing; a
    number beyond 10^19 is an error."""
    return F.sum(_decimal(c))


def exact_sum(c: Column) -> Column:
    """``exact_total`` as a double."""
    return exact_total(c).cast("double")


def exact_mean(c: Column) -> Column:
    """Mean of the non-null values, divided once, from an exact sum; NULL without values."""
    return decimal_ratio(F.sum(_decimal(c)), F.count(_decimal(c)))


def _decimal(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x), x).cast("decimal(28,9)")


def decimal_ratio(total: Column, n: Column) -> Column:
    """total / n as doubles, NULL for n = 0."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def round6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def ts_string(c: Column) -> Column:
    """Timestamp → 'yyyy-MM-dd HH:mm:ss' text (stable across TZ/NTZ types)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def hash_unit(key: Column, salt: str | None = None) -> Column:
    """Sticky pseudo-random number in [0, 1) from a key.

    First 8 hex digits of md5(key) as an unsigned 32-bit integer / 2^32. The same value
    is reproducible in any SQL engine that has md5, so assignments can be audited.
    """
    s = key.cast("string")
    if salt:
        s = F.concat(F.lit(salt), F.lit(":"), s)
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """numpy.isclose defaults: |a-b| <= atol + rtol*|b|; NULL → False."""
    return truthy(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))


def number(c) -> Column:
    """A value as a double where pandas' idea of missing holds: text that is no number and
    NaN are NULL."""
    x = (c if isinstance(c, Column) else F.col(f"`{c}`")).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def is_missing(c: str, data_type) -> Column:
    """NULL, and NaN in floating columns."""
    x = F.col(f"`{c}`")
    return x.isNull() | F.isnan(x) if data_type.typeName() in ("double", "float") else x.isNull()


def null_safe_join(left, right, keys: list[str], how: str = "inner"):
    """Equi-join in which NULL keys match each other; the left side's keys are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])
