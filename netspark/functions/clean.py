"""Column expressions for untidy keys and missing numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\r\x0b\x0c"


def tidy_key(c: Column | str) -> Column:
    """The string without white space at both ends, in upper case; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.btrim(c.cast("string"), F.lit(BLANKS)))


def usable(c: Column | str) -> Column:
    """True where a number is neither NULL nor NaN. Never NULL itself."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c)


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(c)


def guard0(c: Column) -> Column:
    """A denominator with 0 replaced by 1, so that x / guard0(0) is x."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def is_float(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))
