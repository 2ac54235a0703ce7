"""Time-to-event records: one per unit, and one per individual inside the units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import PANEL, PanelSpec
from ..functions.columns import all_present, as_long, as_text, require_columns
from .reductions import final_per_unit

# Time steps handled by one window task, and individuals emitted by one task row.
_STEPS_PER_CHUNK = 4096
_ROWS_PER_BLOCK = 4096


def unit_time_to_event(
    df: DataFrame, threshold: float = 1.0, spec: PanelSpec = PANEL
) -> DataFrame:
    """Last day of each unit, and 1 if its final survival is below the threshold.

    A null final survival is censored (0). Groups are those of the first row.
    """
    require_columns(df, spec.unit, spec.time, spec.survival)
    groups = [g for g in spec.unit_groups if g in df.columns]
    last = final_per_unit(df, groups, spec, name="_final", with_time=True)
    return last.select(
        spec.unit,
        F.col(spec.time).alias("duration"),
        F.when(F.col("_final") < threshold, 1).otherwise(0).alias("event_observed"),
        *groups,
    ).filter(all_present([spec.unit, "duration"]))


def individuals_weighted(
    df: DataFrame, spec: PanelSpec = PANEL, chunk: int = _STEPS_PER_CHUNK
) -> DataFrame:
    """Deaths and survivors per unit and day, rebuilt from cumulative counts.

    On each day with a known cumulative count the deaths are its rise over the
    last known count (never negative; a fall still lowers the base). Survivors
    are the ``remaining`` on the unit's last day, if the count of that row is
    known. Units without a unit key or without an initial count on their first
    row give nothing. Rows without a day are dropped: they cannot be placed in
    time. Equal days are taken in ascending count; of equal first days one with a
    known initial count is preferred.

    Equal (unit, day) rows are combined before any shuffle. Then the running
    comparison is done on chunks of ``chunk`` time steps, and a table of one row
    per (unit, chunk) carries the last count, the last day and the groups from
    chunk to chunk, so no task ever holds the full history of a long unit.
    """
    require_columns(
        df,
        spec.unit,
        spec.time,
        spec.cumulative,
        spec.initial,
        spec.remaining,
        spec.genotype,
        spec.housing,
        spec.density,
    )
    groups = (spec.genotype, spec.housing_type, spec.density)
    rows = df.select(
        F.col(spec.unit),
        as_long(df, spec.time).alias("time"),
        as_long(df, spec.cumulative).alias("_cum"),
        as_long(df, spec.remaining).alias("_left"),
        as_long(df, spec.initial).alias("_initial"),
        as_text(df, spec.genotype).alias(spec.genotype),
        as_text(df, spec.housing).alias(spec.housing_type),
        as_text(df, spec.density).alias(spec.density),
    ).filter(all_present([spec.unit, "time"]))
    rows = rows.withColumn("_chunk", F.floor(F.col("time") / chunk))

    # One row per (unit, day): the smallest and greatest count say all about ties.
    days = rows.groupBy(spec.unit, "_chunk", "time").agg(
        F.min("_cum").alias("_cum_low"),
        F.max("_cum").alias("_cum_high"),
        F.sum(F.when(F.col("_cum").isNotNull() & (F.col("_left") > 0), F.col("_left"))).alias(
            "_survivors"
        ),
    )
    earlier = Window.partitionBy(spec.unit, "_chunk").orderBy("time")
    days = days.withColumn(
        "_before",
        F.last("_cum_high", ignorenulls=True).over(
            earlier.rowsBetween(Window.unboundedPreceding, -1)
        ),
    )

    summaries = rows.groupBy(spec.unit, "_chunk").agg(
        F.max(F.when(F.col("_cum").isNotNull(), F.struct("time", "_cum"))).alias("_tail"),
        F.min(
            F.struct(
                "time",
                F.col("_initial").isNull().alias("_no_initial"),
                "_initial",
                *groups,
            )
        ).alias("_head"),
        F.max("time").alias("_end"),
    )
    along = Window.partitionBy(spec.unit).orderBy("_chunk")
    carried = summaries.select(
        F.col(spec.unit),
        F.col("_chunk"),
        F.last("_tail._cum", ignorenulls=True)
        .over(along.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry"),
        F.first("_head").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_head"),
        F.max("_end")
        .over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("_last_day"),
    ).filter(F.col("_head._initial").isNotNull())

    zero = F.lit(0).cast("bigint")
    base = F.coalesce("_before", "_carry", zero)
    deaths = F.col("_cum_high") - F.least(F.col("_cum_low"), base)
    survivors = F.when(F.col("time") == F.col("_last_day"), F.col("_survivors"))
    return (
        days.join(carried, [spec.unit, "_chunk"])
        .select(
            spec.unit,
            *(F.col("_head").getField(g).alias(g) for g in groups),
            "time",
            F.when(F.col("_cum_high").isNotNull(), deaths).otherwise(zero).alias("deaths"),
            F.coalesce(survivors, zero).alias("censored"),
        )
        .filter((F.col("deaths") > 0) | (F.col("censored") > 0))
    )


def _most_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle starts from: the adaptive number if it is set, else that of shuffles, else the cores."""
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.shuffle.partitions")
    set_ = [v for v in (spark.conf.get(n, None) for n in names) if v and v.isdigit()]
    return int(set_[0]) if set_ else spark.sparkContext.defaultParallelism


def individuals(
    df: DataFrame, spec: PanelSpec = PANEL, block: int = _ROWS_PER_BLOCK
) -> DataFrame:
    """One row per individual: time and event (1 died, 0 still there on the last day).

    A row that stands for many individuals is first cut into blocks, and the
    blocks are spread, so that no single task writes them all. Prefer the
    weighted form where a weight will do.
    """
    weighted = individuals_weighted(df, spec)
    counts = F.array(
        F.struct(F.lit(1).alias("event"), F.col("deaths").alias("n")),
        F.struct(F.lit(0).alias("event"), F.col("censored").alias("n")),
    )
    kept = [spec.unit, spec.genotype, *spec.strata, "time"]
    by_event = weighted.select(*kept, F.explode(counts).alias("_c")).filter("_c.n > 0")
    blocks = by_event.select(
        *kept,
        F.col("_c.event").alias("event"),
        F.col("_c.n").alias("_n"),
        F.floor((F.col("_c.n") - 1) / block).alias("_last"),
    )
    # In two steps: no array has more than block + 1 elements, for rows of up to block ** 3 individuals.
    step = F.lit(block).cast("bigint")
    blocks = blocks.withColumn("_high", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_last") / step))))
    within = F.least(step - 1, F.col("_last") - F.col("_high") * step)
    blocks = blocks.withColumn("_low", F.explode(F.sequence(F.lit(0).cast("bigint"), within)))
    blocks = blocks.withColumn("_block", F.col("_high") * step + F.col("_low")).drop("_high", "_low", "_last")
    # By number: adaptive execution would merge the partitions again, as blocks are
    # tiny until they are written out.
    spread = blocks.repartition(_most_partitions(df.sparkSession), spec.unit, "time", "event", "_block")
    size = F.least(F.lit(block).cast("bigint"), F.col("_n") - F.col("_block") * block)
    return spread.select(
        *kept, "event", F.explode(F.array_repeat(F.lit(1), size.cast("int"))).alias("_one")
    ).drop("_one")


def weigh(individual_rows: DataFrame, groups: Sequence[str] = PANEL.strata) -> DataFrame:
    """Individual rows back to deaths and survivors per groups and time."""
    require_columns(individual_rows, *groups, "time", "event")
    return individual_rows.groupBy(*groups, "time").agg(
        F.sum(F.col("event").cast("bigint")).alias("deaths"),
        F.sum((1 - F.col("event")).cast("bigint")).alias("censored"),
    )
