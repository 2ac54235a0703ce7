"""Null-, NaN- and ANSI-safe column expressions, and the frame checks that go with them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java reads "5d", "5f" and hex literals as numbers; in a data file they are bad
# text. One short pattern: a projection over many columns must stay small enough
# for the JVM to compile.
_JAVA_ONLY_NUMBER = r"[0-9.][dDfF]\s*$|0[xX]"


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in dict.fromkeys(names) if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def as_text(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c if isinstance(df.schema[name].dataType, T.StringType) else c.cast("string")


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double; text that is not a number (blanks around one are allowed) and other types become null."""
    dtype, c = df.schema[name].dataType, F.col(name)
    if isinstance(dtype, T.DoubleType):
        return c
    if isinstance(dtype, T.StringType):
        # Most cells have no letter: to see that takes less than the pattern does.
        no_letter = F.lower(c) == F.upper(c)
        return F.when(no_letter | ~c.rlike(_JAVA_ONLY_NUMBER), c.try_cast("double"))
    if not isinstance(dtype, T.NumericType | T.BooleanType):
        return F.lit(None).cast("double")  # a date, say, is not a number
    return c.try_cast("double")


def as_long(df: DataFrame, name: str) -> Column:
    """The column as bigint, cut towards zero; bad text, NaN and overflow become null."""
    dtype, c = df.schema[name].dataType, F.col(name)
    if isinstance(dtype, T.LongType):
        return c
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    return as_double(df, name).try_cast("bigint")


def all_present(names: Iterable[str]) -> Column:
    """True where no named column is null. Unlike ``dropna`` it lets NaN pass."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).isNotNull()
    return cond


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit to [low, high]; null and NaN stay.

    ``least`` and ``greatest`` skip nulls and rank NaN highest, so both are kept apart.
    """
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(F.isnan(c), c).when(c.isNotNull(), out)


def standard_error(sd: Column, n: Column) -> Column:
    return F.try_divide(sd, F.sqrt(n))


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate that is null, not an error, when x or y is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def keep_groups(
    df: DataFrame, name: str, wanted: Sequence | DataFrame | None
) -> DataFrame:
    """Rows whose group is wanted: ``None`` keeps all, an empty list keeps none.

    A DataFrame of wanted values (first column) becomes a left semi join.
    """
    if wanted is None:
        return df
    if isinstance(wanted, DataFrame):
        values = wanted.select(F.col(wanted.columns[0]).cast("string").alias("_wanted"))
        return df.join(values, as_text(df, name) == F.col("_wanted"), "left_semi")
    if not wanted:
        return df.filter(F.lit(False))
    return df.filter(as_text(df, name).isin([str(w) for w in wanted]))
