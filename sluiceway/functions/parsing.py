"""Text to number and null / NaN policy, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def as_column(c: Column | str) -> Column:
    """A column from a name; names are quoted so that dots and blanks are literal."""
    return c if isinstance(c, Column) else F.col("`" + c.replace("`", "``") + "`")


def as_double(c: Column | str) -> Column:
    """Cast to double; what does not parse becomes null, also in ANSI mode."""
    return as_column(c).try_cast("double")


def text_to_double(c: Column | str) -> Column:
    """Double from text that may carry thousands commas; failures become null."""
    return F.translate(as_column(c), ",", "").try_cast("double")


def coerce_double(c: Column | str, default: float = 0.0) -> Column:
    """Cast to double with a default for null and unparsable values. NaN stays NaN."""
    return F.coalesce(as_double(c), F.lit(default))


def is_finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null itself.

    NaN sorts above infinity in Spark, so one comparison covers all cases. Naming the input
    once matters: a filter is pushed through projections by repeating their expressions.
    """
    return F.coalesce(F.abs(as_column(c)) < F.lit(_INF), F.lit(False))


def nonfinite_to_null(c: Column | str) -> Column:
    """NaN, +Inf and -Inf become null."""
    x = as_column(c)
    return F.when(F.abs(x) < F.lit(_INF), x)
