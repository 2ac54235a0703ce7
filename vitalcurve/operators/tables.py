"""Option lists, result-table formatting and a preview of the panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contract import PANEL, SIGNIFICANCE_LEVEL, PanelSpec
from ..functions.columns import as_text, require_columns

# Parts that the values of a group column are sorted in, and the bits of a row's place in its partition.
_RANGES = 64
_PLACE_BITS = 33


def group_options(df: DataFrame, group: str, ranges: int = _RANGES) -> DataFrame:
    """Distinct known values of a group column as sorted text, numbered from 0.

    The values are sorted in ``ranges`` parts, each in a task of its own; a
    value's number is its place in its part after the values of the parts
    before. The parts are counted from the same shuffle. A part that the count
    does not fit (a session that reads the shuffle anew for it) raises an error.
    """
    require_columns(df, group)
    values = df.select(as_text(df, group).alias(group)).filter(F.col(group).isNotNull()).distinct()
    placed = values.repartitionByRange(ranges, group).sortWithinPartitions(group).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", _PLACE_BITS), F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    counts = placed.groupBy(part.alias("_of")).agg(F.count(F.lit(1)).alias("_n"), F.min(group).alias("_low"), F.max(group).alias("_high"))
    # Each part's count goes to all parts behind it: ``ranges`` squared short rows at most.
    behind = counts.withColumn("_part", F.explode(F.sequence(F.col("_of"), F.lit(ranges - 1).cast("bigint"))))
    own = F.col("_of") == F.col("_part")
    parts = behind.groupBy("_part").agg(
        F.sum(F.when(own, 0).otherwise(F.col("_n"))).alias("_before"),
        *(F.max(F.when(own, F.col(c))).alias(c) for c in ("_n", "_low", "_high")),
    )
    fits = (F.col("_place") < F.col("_n")) & F.col(group).between(F.col("_low"), F.col("_high"))
    number = F.when(fits, F.col("_before") + F.col("_place")).otherwise(F.raise_error(F.lit("the parts were not read from the shuffle that was counted")))
    return (
        placed.select(group, part.alias("_part"), place.alias("_place"))
        .join(parts, "_part")
        .select(group, number.cast("int").alias("ordinal"))
        .orderBy(group)
    )


def stats_table(
    df: DataFrame,
    p_column: str = "p_value",
    digits: int = 2,
    p_digits: int = 4,
    as_text: bool = False,
) -> DataFrame:
    """Result table for reading: rounded floats, whole counts, a ``significant`` flag.

    ``significant`` is added if the table has a p-value column, and is false
    where p is null. ``as_text`` prints numbers with fixed digits and "N/A" for
    null, as a display does.
    """
    out = []
    for f in df.schema.fields:
        c, places = F.col(f.name), p_digits if f.name == p_column else digits
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(c)
        elif as_text:
            shown = F.format_string(f"%.{places}f", c)
            out.append(F.coalesce(F.when(c.isNotNull(), shown), F.lit("N/A")).alias(f.name))
        else:
            out.append(F.round(c, places).alias(f.name))
    if p_column in df.columns:
        significant = F.coalesce(F.col(p_column) < SIGNIFICANCE_LEVEL, F.lit(False))
        out.append(significant.alias("significant"))
    return df.select(*out)


def panel_preview(
    df: DataFrame,
    rows: int = 100,
    order: Sequence[str] | None = None,
    spec: PanelSpec = PANEL,
) -> DataFrame:
    """The first rows in a fixed order. The full table and its schema are the frame itself."""
    order = list(order or (spec.unit, spec.time))
    require_columns(df, *order)
    return df.orderBy(*order).limit(rows)
