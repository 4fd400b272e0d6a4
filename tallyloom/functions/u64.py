"""Unsigned 64-bit arithmetic on Spark's signed types.

A value is kept as its bit pattern in a BIGINT, so equality needs no change.
Comparison and sums do; sums wrap modulo 2^64 and don't depend on ANSI mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO64 = 2**64
U64_TYPE = "decimal(20,0)"


def as_pattern(value: int) -> int:
    """The BIGINT whose bits are those of ``value`` (0 to 2^64-1)."""
    if not 0 <= value < _TWO64:
        raise ValueError(f"{value} is not an unsigned 64-bit integer")
    return value - _TWO64 if value >= 2**63 else value


def compare(col: Column, op: str, value: int, domain: str = "u64") -> Column:
    """``col op value`` for op in = < >."""
    if domain == "bigint":
        if value >= 2**63:  # beyond every BIGINT
            return F.lit(op == "<")
        return {"=": col == value, "<": col < value, ">": col > value}[op]
    k = F.lit(as_pattern(value)).cast("bigint")
    if op == "=":
        return col == k
    if value < 2**63:  # negative patterns are the large values
        return ((col > k) | (col < 0)) if op == ">" else ((col >= 0) & (col < k))
    return ((col < 0) & (col > k)) if op == ">" else ((col >= 0) | (col < k))


def unsigned(col: Column) -> Column:
    """The value of a bit pattern, as decimal(20,0)."""
    wide = col.cast(U64_TYPE)
    return F.when(col < 0, wide + F.lit(str(_TWO64)).cast(U64_TYPE)).otherwise(wide).cast(U64_TYPE)


def wrapped_sum(col: Column, domain: str = "u64") -> Column:
    """SUM(col): BIGINT in the bigint domain, else decimal(20,0) modulo 2^64.

    The four 16-bit parts of a value are summed as BIGINT, which can't overflow
    below 2^47 rows, and are put together once, from the final sums.
    """
    if domain == "bigint":
        return F.sum(col)
    out = None
    for k in range(4):
        part = F.sum(F.shiftrightunsigned(col, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("bigint")))
        kept = part.bitwiseAND(F.lit(2 ** (64 - 16 * k) - 1).cast("bigint")) if k else part  # what is beyond 2^64 wraps away
        term = (kept.cast(U64_TYPE) * F.lit(str(2 ** (16 * k))).cast("decimal(15,0)")).cast("decimal(21,0)")
        out = term if out is None else out + term
    return (out % F.lit(str(_TWO64)).cast(U64_TYPE)).cast(U64_TYPE)


def zero_as_null(col: Column) -> Column:
    return F.when(col != 0, col)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
