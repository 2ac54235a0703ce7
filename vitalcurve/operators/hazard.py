"""Nelson-Aalen cumulative hazard by housing and density."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..contract import PANEL
from ..functions.columns import all_present, keep_groups, require_columns
from ..functions.harmonic import reciprocal_square_sum, reciprocal_sum
from .events import weigh

Wanted = Sequence | DataFrame | None
TIES = ("fleming_harrington", "plain")


def nelson_aalen(
    events: DataFrame,
    housings: Wanted = None,
    densities: Wanted = None,
    confidence: bool = False,
    alpha: float = 0.05,
    ties: str = "fleming_harrington",
    groups: tuple[str, str] = PANEL.strata,
    time_block: float | None = None,
) -> DataFrame:
    """Cumulative hazard per (housing, density), named by ``groups``, at every observed time.

    ``events`` holds individual rows (``time``, ``event``) or weighted ones
    (``time``, ``deaths``, ``censored``). Rows with a null group or time are left
    out. A row at time 0 is added to a curve that has none. ``confidence`` adds
    the log-transformed interval, which is 0 where the hazard is 0.

    ``ties='fleming_harrington'`` adds 1/n + 1/(n-1) + ... for the deaths of one
    time, with the squares as variance; ``'plain'`` adds d/n, with variance
    d(n-d)/n^3.

    The windows run on the table of one row per group and distinct time, which
    is aggregated on the map side first, not on the individuals. Those rows of a
    group are in one task; for a time axis of millions of steps ``time_block``
    cuts it into ranges of that length: sums run inside a range, and a table of
    one row per range carries them over.
    """
    if time_block is not None and not time_block > 0:
        raise ValueError("time_block must be positive")
    if ties not in TIES:
        raise ValueError(f"ties must be one of {TIES}")
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    if "event" in events.columns:
        events = weigh(events, groups)
    require_columns(events, *groups, "time", "deaths", "censored")
    rows = keep_groups(keep_groups(events, groups[0], housings), groups[1], densities)
    steps = (
        rows.filter(all_present([*groups, "time"]))
        .groupBy(*groups, "time")
        .agg(
            F.sum("deaths").cast("bigint").alias("deaths"),
            F.sum("censored").cast("bigint").alias("censored"),
        )
    )
    zero = F.lit(0).cast("bigint")
    whole = Window.partitionBy(*groups)
    if time_block is None:
        steps, in_range = _with_totals(_leaving(steps).withColumn("_left", zero), whole), whole
    else:
        # Ranges of a group lie in many tasks, one row each in a table that carries sums from range to range.
        # A range is never null; were it, the join would filter its sides and read two shuffles.
        at = F.coalesce(F.floor(F.col("time") / time_block), zero)
        steps = _leaving(steps.withColumn("_range", at).repartition(*groups, "_range"))
        ahead = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = steps.groupBy(*groups, "_range").agg(
            F.sum("_leaving").alias("_leaving"), F.min("time").alias("time"), F.max("_zero").alias("_zero")
        )
        ranges = _with_totals(ranges, whole).withColumn("_left", F.coalesce(F.sum("_leaving").over(ahead), zero))
        steps = steps.join(ranges.drop("_leaving", "time", "_zero"), [*groups, "_range"])
        in_range = Window.partitionBy(*groups, "_range")
    so_far = in_range.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    n, d = F.col("at_risk"), F.col("deaths")
    if ties == "plain":
        step, square = F.try_divide(d, n), F.try_divide(d * (n - d), n.cast("double") ** 3)
    else:
        step, square = reciprocal_sum(n, d), reciprocal_square_sum(n, d)
    left = F.col("_left") + F.sum("_leaving").over(so_far) - F.col("_leaving")
    curve = (
        steps.withColumn("at_risk", F.col("_all") - left)
        .withColumns({"_step": step, "_square": square})
        .withColumns({"hazard": F.sum("_step").over(so_far), "variance": F.sum("_square").over(so_far)})
    )
    if time_block is not None:
        sums = curve.groupBy(*groups, "_range").agg(F.sum("_step").alias("_step"), F.sum("_square").alias("_square"))
        carried = sums.select(
            *groups,
            "_range",
            F.coalesce(F.sum("_step").over(ahead), F.lit(0.0)).alias("_hazard"),
            F.coalesce(F.sum("_square").over(ahead), F.lit(0.0)).alias("_variance"),
        )
        curve = curve.join(carried, [*groups, "_range"]).withColumns(
            {"hazard": F.col("hazard") + F.col("_hazard"), "variance": F.col("variance") + F.col("_variance")}
        )
    fields = ("time", "at_risk", "deaths", "censored", "hazard", "variance")
    row = F.struct(*fields)
    origin = F.struct(
        zero.cast(curve.schema["time"].dataType).alias("time"),
        F.col("_all").alias("at_risk"),
        zero.alias("deaths"),
        zero.alias("censored"),
        F.lit(0.0).alias("hazard"),
        F.lit(0.0).alias("variance"),
    )
    needs_origin = (F.col("time") == F.col("_first")) & ~F.col("_has_zero")
    curve = curve.select(
        *groups,
        F.explode(F.when(needs_origin, F.array(origin, row)).otherwise(F.array(row))).alias("_r"),
    ).select(
        *groups,
        F.concat_ws(" - ", *groups).alias("label"),
        *(F.col("_r").getField(f).alias(f) for f in fields),
    )
    if confidence:
        z = NormalDist().inv_cdf(1 - alpha / 2)
        spread = F.exp(F.try_divide(z * F.sqrt("variance"), F.col("hazard")))
        some = F.col("hazard") > 0
        curve = curve.withColumns(
            {
                "lower": F.when(some, F.try_divide(F.col("hazard"), spread)).otherwise(0.0),
                "upper": F.when(some, F.col("hazard") * spread).otherwise(0.0),
            }
        )
    return curve.orderBy(*groups, "time")


def _leaving(steps: DataFrame) -> DataFrame:
    return steps.withColumns({"_leaving": F.col("deaths") + F.col("censored"), "_zero": F.col("time") == 0})


def _with_totals(rows: DataFrame, group: WindowSpec) -> DataFrame:
    """All who leave a group, its first time, and whether it has a time 0."""
    return rows.withColumns(
        {"_all": F.sum("_leaving").over(group), "_first": F.min("time").over(group), "_has_zero": F.max("_zero").over(group)}
    )
