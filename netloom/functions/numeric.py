"""Numeric helpers shared by every score."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(value, digits: int) -> Column:
    """Half-up rounding on the binary value; the same bits come out of any engine."""
    scale = F.lit(10.0**digits)
    return F.floor(value * scale + F.lit(0.5)) / scale


def unit(value) -> Column:
    """Clamp from above at 1."""
    return F.least(value, F.lit(1.0))


def ratio(numerator, denominator) -> Column:
    """numerator/denominator to 4 digits, 0 when the denominator is not positive."""
    return F.when(denominator <= 0, F.lit(0.0)).otherwise(rnd(numerator / denominator, 4))


def flag(condition) -> Column:
    """1 when the condition holds, 0 when it is false or null."""
    return F.when(condition, 1).otherwise(0)


def tally(condition) -> Column:
    return F.sum(flag(condition))


def scaled(value, digits: int) -> Column:
    """A value already rounded to `digits`, as an integer: sums of it do not depend on order."""
    return F.floor(value * F.lit(10.0**digits) + F.lit(0.5)).cast("bigint")


def exact_mean(value, digits: int) -> Column:
    """Order-independent mean of values already rounded to `digits`."""
    return F.sum(scaled(value, digits)) / F.count(value) / F.lit(10.0**digits)
