"""Reading a panel and bringing it to the column contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contract as C
from ..functions.columns import as_double, as_long, as_text


def read_panel_csv(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """CSV with a header row, every column as text.

    No type is guessed: guessing turns the cross id ``007`` into 7 and needs a
    pass over the data. ``path`` may be any file system the session knows.
    ``multiline`` allows line breaks inside quotes but stops Spark from
    splitting a file, so it is off by default. Files whose header differs from
    the first one are refused instead of being read by position.
    """
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )


def read_panel_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def missing_columns(df: DataFrame) -> list[str]:
    """Contract columns a table lacks; standardising tolerates them."""
    expected = (*C.TEXT_COLUMNS, *C.DOUBLE_COLUMNS, *C.LONG_COLUMNS)
    return [n for n in expected if n not in df.columns]


def _casts(df: DataFrame) -> dict[str, Column]:
    """The contract columns that the table has, brought to their types."""
    casts = {n: as_text(df, n) for n in C.TEXT_COLUMNS if n in df.columns}
    casts |= {n: as_double(df, n) for n in C.DOUBLE_COLUMNS if n in df.columns}
    return casts | {n: as_long(df, n) for n in C.LONG_COLUMNS if n in df.columns}


def _lost(df: DataFrame) -> dict[str, Column]:
    """For each contract column whether a cell has a value that does not fit its type."""
    return {
        n: F.lit(False) if _is_kept(df, n) else F.col(n).isNotNull() & cast.isNull() for n, cast in _casts(df).items()
    }


def _is_kept(df: DataFrame, name: str) -> bool:
    dtype = df.schema[name].dataType
    if name in C.TEXT_COLUMNS:
        return True
    return isinstance(dtype, T.IntegralType) or (name in C.DOUBLE_COLUMNS and isinstance(dtype, T.NumericType))


def conversion_faults(df: DataFrame) -> DataFrame:
    """Per contract column of a table as read: ``known`` cells, and those that standardising turns into null, ``lost``.

    Sorted by column name, one row for each column that the table has; a table
    without contract columns gives no row.
    """
    lost = _lost(df)
    if not lost:
        return df.sparkSession.createDataFrame([], "column string, known bigint, lost bigint")
    counts = [F.struct(F.lit(n).alias("column"), F.count(F.col(n)).alias("known"), F.count_if(gone).alias("lost")) for n, gone in sorted(lost.items())]
    return df.agg(F.array(*counts).alias("_columns")).select(F.inline("_columns"))


def standardise_panel(df: DataFrame, unit_type: str | None = None, faults: Observation | None = None) -> DataFrame:
    """Cast the contract columns and derive the two group columns if absent.

    Values that do not fit their type become null. The unit key stays as read
    unless ``unit_type`` names a type. Other columns pass through. The result is
    one lazy projection, so filters and column pruning reach the scan.

    ``faults`` counts what is lost in the same pass: once an action on the result
    has run, ``faults.get`` holds ``rows`` and, for each contract column, the
    cells of it that became null. The scan then reads all contract columns.
    Without an action of its own, ``conversion_faults`` gives the same as a table.
    """
    if faults is not None:
        df = df.observe(faults, F.count(F.lit(1)).alias("rows"), *(F.count_if(gone).alias(n) for n, gone in _lost(df).items()))
    casts = _casts(df)
    if unit_type and C.PANEL.unit in df.columns:
        casts[C.PANEL.unit] = F.col(C.PANEL.unit).try_cast(unit_type)
    out = df.withColumns(casts) if casts else df

    if "housing" not in out.columns and "in_beaker" in out.columns:
        together = F.lower("in_beaker") == C.BEAKER_FLAG
        out = out.withColumn(
            "housing",
            F.when(together, C.HOUSED_TOGETHER).otherwise(C.HOUSED_ALONE),
        )
    if "genotype_housing" not in out.columns and {"genotype", "housing"} <= set(out.columns):
        out = out.withColumn(
            "genotype_housing",
            F.concat(
                F.coalesce("genotype", F.lit(C.MISSING_GENOTYPE)),
                F.lit(" ("),
                F.coalesce(as_text(out, "housing"), F.lit(C.MISSING_GROUP)),
                F.lit(")"),
            ),
        )
    present = [n for n in C.DERIVED_TEXT_COLUMNS if n in out.columns]
    return out.withColumns({n: as_text(out, n) for n in present}) if present else out
