"""The part and lineitem tables seen as a survival panel.

A part is a unit, its line items are the individuals and a shipment is a death.
Days are periods of 30 calendar days from 1995-01-01; a part is watched for
40 + (p_partkey mod 45) periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LAST_POSSIBLE_DAY = 40 + 44
# Units whose rows one task makes: at most 85 rows each, some half a million in all.
_UNITS_PER_TASK = 8192


def clean_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed panel with one row per part and period.

    Line items are counted per (part, period) on the map side, then per part, so
    one part may hold any share of them. What is collected per part is bounded by
    the 85 periods it can be watched. The panel rows are generated from one row
    per part and the windows over a part reuse that partitioning: the panel
    itself is never shuffled. Adaptive execution would merge the partitions by
    their size before the rows are made, which is small; so their number is
    given, by the rows of ``part`` (a count that reads file footers alone).
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shipped = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    per_period = (
        items.select("l_partkey", F.floor(shipped / 30).alias("period"))
        .groupBy("l_partkey", "period")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    watched = F.col("period").between(0, _LAST_POSSIBLE_DAY)
    tasks = max(spark.sparkContext.defaultParallelism, -(-part.count() // _UNITS_PER_TASK))
    per_part = per_period.repartition(tasks, "l_partkey").groupBy("l_partkey").agg(
        F.sum("n").alias("initial_count"),
        F.map_from_entries(F.collect_list(F.when(watched, F.struct("period", "n")))).alias("deaths"),
    )
    units = part.join(per_part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_partkey").alias("dish_id"),
        F.col("p_brand").alias("genotype"),
        F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no").alias("in_beaker"),
        F.when(F.col("p_size") % 2 == 0, "Beaker").otherwise("Dish").alias("housing"),
        F.when(F.col("initial_count") < 25, "low")
        .when(F.col("initial_count") < 35, "mid")
        .otherwise("high")
        .alias("density_category"),
        F.col("p_type").alias("cross_id"),
        "initial_count",
        (F.col("p_size") * 10).cast("bigint").alias("vol_water_total"),
        "deaths",
        F.explode(F.sequence(F.lit(0).cast("bigint"), 40 + F.col("p_partkey") % 45)).alias(
            "days_since_fertilization"
        ),
    )
    by_day = Window.partitionBy("dish_id").orderBy("days_since_fertilization")
    day, initial = F.col("days_since_fertilization"), F.col("initial_count")
    return (
        units.withColumn("fish_deaths", F.coalesce(F.col("deaths")[day], F.lit(0).cast("bigint")))
        .drop("deaths")
        .withColumn(
            "cumulative_deaths",
            F.sum("fish_deaths").over(by_day.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("remaining", initial - F.col("cumulative_deaths"))
        .withColumn("survival_rate", F.lit(100.0) * F.col("remaining") / initial)
        .withColumn(
            "survival_rate_change",
            F.col("survival_rate") - F.lag("survival_rate").over(by_day),
        )
        .withColumns(
            {
                "genotype_housing": F.concat("genotype", F.lit(" ("), "housing", F.lit(")")),
                "volume_per_fish": F.col("vol_water_total").cast("double") / initial,
                "fish_density": initial.cast("double") / F.col("vol_water_total"),
                "cumulative_deaths": F.col("cumulative_deaths").cast("double"),
                "remaining": F.col("remaining").cast("double"),
            }
        )
    )


def dirty_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean panel as text, with faults: what a CSV scan of it would give.

    With k = 100 * dish_id + day. The derived group columns are left out, so that
    standardising has to make them.
    """
    clean = clean_panel(spark, sf_dir)
    unit, day = F.col("dish_id"), F.col("days_since_fertilization")
    k = unit * 100 + day
    last = day == 40 + unit % 45
    missing = F.lit(None).cast("string")

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    # The cumulative count is 1 too low on day 20 of some units.
    counted = F.when((unit % 23 == 0) & (day == 20), F.col("cumulative_deaths") - 1).otherwise(
        F.col("cumulative_deaths")
    )
    rows = clean.select(
        text("dish_id").alias("dish_id"),
        F.when(unit % 17 != 0, F.col("genotype")).alias("genotype"),
        F.when(unit % 11 == 0, missing)
        .when(unit % 7 == 0, F.upper("in_beaker"))
        .otherwise(F.col("in_beaker"))
        .alias("in_beaker"),
        F.when(unit % 13 != 0, F.col("density_category")).alias("density_category"),
        "cross_id",
        F.when(k % 73 == 0, missing)
        .when(k % 79 == 0, F.concat(text("days_since_fertilization"), F.lit(".9")))
        .otherwise(text("days_since_fertilization"))
        .alias("days_since_fertilization"),
        F.when(unit % 31 != 0, text("initial_count")).alias("initial_count"),
        text("fish_deaths").alias("fish_deaths"),
        F.when((k % 83 == 0) | ((unit % 37 == 0) & last), missing)
        .otherwise(counted.cast("string"))
        .alias("cumulative_deaths"),
        text("remaining").alias("remaining"),
        F.when(k % 97 == 0, "n/a")
        .when((k % 89 == 0) | ((unit % 29 == 0) & last), missing)
        .when((unit % 41 == 0) & (day == 5), "NaN")
        .otherwise(text("survival_rate"))
        .alias("survival_rate"),
        text("survival_rate_change").alias("survival_rate_change"),
        text("vol_water_total").alias("vol_water_total"),
        text("volume_per_fish").alias("volume_per_fish"),
        text("fish_density").alias("fish_density"),
        F.when(unit % 43 == 0, missing)
        .when(F.col("remaining") > 0, "active")
        .otherwise("ended")
        .alias("status"),
        F.when(k % 101 == 0, missing).when(day % 7 == 0, "yes").otherwise("no").alias("water_changed"),
        F.when(k % 103 == 0, F.concat(text("vol_water_total"), F.lit(".7")))
        .when(k % 107 == 0, "5d")
        .when(day % 7 == 0, text("vol_water_total"))
        .otherwise("0")
        .alias("vol_water_changed"),
        F.when(k % 113 == 0, "-").otherwise((F.lit(-0.25) * (day % 13 + 1)).cast("string")).alias("max_decline"),
        F.when(k % 109 == 0, "NaN").otherwise((day % 31).cast("string")).alias("critical_day"),
        # The last day of some units is written twice.
        F.when((unit % 19 == 0) & last, 2).otherwise(1).alias("_copies"),
    )
    return rows.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))
    ).drop("_copies", "_copy")
