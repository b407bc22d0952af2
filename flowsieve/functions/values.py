"""NULL, NaN and infinity: each predicate names all three."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowsieve.schema import floating_columns, is_floating

INF = float("inf")


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL in any type, or NaN in a floating one."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if is_floating(df.schema[name].dataType) else c.isNull()


def is_inf(name: str) -> Column:
    return F.coalesce(F.abs(F.col(f"`{name}`")) == F.lit(INF), F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def total_of(conditions: list[Column]) -> Column:
    return reduce(add, [c.cast("int") for c in conditions]) if conditions else F.lit(0)


def any_missing(df: DataFrame) -> Column:
    return any_of([is_missing(df, c) for c in df.columns])


def any_inf(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    return any_of([is_inf(c) for c in floating_columns(df, exclude)])


def finite_or_zero(c: Column) -> Column:
    """Number parsed from any type; text, NULL, NaN and infinities become 0."""
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n) | (F.abs(n) == F.lit(INF)), F.lit(0.0)).otherwise(n)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return ratio(a * F.lit(100.0), b)


def ordered_bits(c: Column) -> Column:
    """A double as a long of the same order: exponent and fraction, negative for negative numbers; 0 for both zeros."""
    a = F.abs(c)
    guess = F.greatest(F.floor(F.log2(a)), F.lit(-1022))
    low, high = F.pow(F.lit(2.0), guess), F.pow(F.lit(2.0), guess + 1)
    exponent = F.when(a >= high, guess + 1).when((a < low) & (guess > -1022), guess - 1).otherwise(guess).cast("long")
    fraction = ((a / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**52)).cast("long")
    normal = F.shiftleft(exponent + 1023, 52) + fraction
    small = (a * F.lit(2.0**1022) * F.lit(2.0**52)).cast("long")
    code = F.when(a < F.lit(2.0**-1022), small).otherwise(normal)
    return F.when(c < 0, -code).otherwise(code)


def all_rows() -> Column:
    return F.count(F.lit(1))


def everything() -> WindowSpec:
    """A window over all rows: only for frames that are already grouped to a few of them."""
    return Window.partitionBy()
