"""Exact quantiles by group without holding a group in one task.

The built-in exact percentile keeps every distinct value of a group in one
aggregation buffer. Here equal values are counted first, and every value gets an
integer in the same order (the bits of the double). The counted values are dealt
out once by the high and middle bits, their sums by the high bits alone; a
running sum over the high bits names the bucket that holds a wanted rank, and
inside it the middle bits, and inside those the low bits are searched the same
way, each on the table as it already lies. All measures, ranks and the moments
come from that one count. Every step is a deterministic aggregate, so a lost
task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_present

# Bits below the middle part and below the high part: no window sorts more than 2^20
# rows of one rank, and the first one at most 4,096 for each power of two in the group.
_MIDDLE, _HIGH = 20, 40
_TOTALS = ("n", "low", "high", "mean", "sd")


def with_ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with a bigint ``name`` for each double ``value`` (not NaN), in the order of the doubles; 0 for both zeros.

    Built up in columns of its own, each written once: as one expression it
    would hold itself dozens of times over.
    """
    steps = {
        "_size": f"abs({value})",
        "_guess": "try_cast(floor(log2(_size)) AS INT)",
        # A logarithm next to a power of two may be rounded over it.
        "_power": "CASE WHEN pow(2D, _guess) > _size THEN _guess - 1 WHEN pow(2D, _guess + 1) <= _size THEN _guess + 1 ELSE _guess END",
        "_magnitude": f"""CASE WHEN _size = 0 THEN 0L
          WHEN _size = double('Infinity') THEN 2047 * {1 << 52}L
          WHEN _size < pow(2D, -1022) THEN CAST(_size * pow(2D, 537) * pow(2D, 537) AS BIGINT)
          ELSE (_power + 1023) * {1 << 52}L + CAST((_size / pow(2D, _power) - 1) * pow(2D, 52) AS BIGINT) END""",
        # Known not to be null, or joins on it would filter their sides and read shuffles of their own.
        name: f"coalesce(CASE WHEN {value} < 0 THEN -_magnitude ELSE _magnitude END, 0L)",
    }
    for new, sql in steps.items():
        df = df.withColumn(new, F.expr(sql))
    return df.drop(*(c for c in steps if c != name))


def _with_base(df: DataFrame) -> DataFrame:
    """``_base``: a number no further from the values whose bits begin with ``_high`` than they are from one another; 0 for infinities."""
    steps = 1 << (52 - _HIGH)
    power = f"(floor(abs(_high) / {steps}) - 1023)"
    base = f"CASE WHEN {power} > 1023 THEN 0D ELSE signum(_high) * pow(2D, {power}) * (1 + (abs(_high) % {steps}) / {steps}) END"
    return df.withColumn("_base", F.expr(base))


def _ranked(points: DataFrame, groups: list[str], measure: list[str], probs: Sequence[float]) -> DataFrame:
    """One row per group, measure and wanted rank: n, low, high, mean, sd, ``_i`` and the value ``_v`` there.

    ``_i`` numbers the ranks below (even) and above (odd) ``p * (n - 1)`` of each p.
    """
    keys = [*groups, *measure]
    counted = with_ordered_bits(points.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), "_v", "_bits")
    counted = counted.select(
        *keys, "_v", "_n", F.expr(f"shiftright(_bits, {_MIDDLE})").alias("_middle"), F.expr(f"shiftright(_bits, {_HIGH})").alias("_high")
    ).repartition(*keys, "_high", "_middle")
    # Sums of differences from a number close by, so that squares lose nothing. One array, since both readers
    # of the shuffle must ask for the same columns to share it; doubles hold the counts and bits exactly.
    off = "(_v - _base)"
    sums = F.expr(f"array(CAST(sum(_n) AS DOUBLE), sum(_n * {off}), sum(_n * {off} * {off}), min(_v), max(_v), CAST(first(_middle) AS DOUBLE))")
    cells = _with_base(counted).groupBy(*keys, "_high", "_middle").agg(sums.alias("_sums")).select(*keys, "_high", "_sums").repartition(*keys, "_high")
    # All measures of a group together, as the result wants them: some thousand rows each.
    highs = _with_base(
        cells.groupBy(*keys, "_high")
        .agg(
            F.expr("CAST(sum(_sums[0]) AS BIGINT)").alias("_n"),
            F.expr("sum(_sums[1])").alias("_off"),
            F.expr("sum(_sums[2])").alias("_square"),
            F.expr("min(_sums[3])").alias("_low"),
            F.expr("max(_sums[4])").alias("_top"),
        )
        .repartition(*groups)
    )
    middles = cells.select(*keys, "_high", F.expr("CAST(_sums[5] AS BIGINT)").alias("_middle"), F.expr("CAST(_sums[0] AS BIGINT)").alias("_n"))

    group = Window.partitionBy(*keys)
    ranks = ", ".join(f"struct({2 * i} AS i, CAST(floor({p!r}D * (n - 1)) AS BIGINT) AS rank), struct({2 * i + 1} AS i, CAST(ceil({p!r}D * (n - 1)) AS BIGINT) AS rank)" for i, p in enumerate(probs))
    found = (
        highs.withColumns(
            {
                "_mean": F.expr("_base + _off / _n"),
                "_end": F.sum("_n").over(_up_to_here(group.orderBy("_high"))),
                "n": F.sum("_n").over(group),
                "low": F.min("_low").over(group),
                "high": F.max("_top").over(group),
            }
        )
        .withColumn("mean", F.sum(F.expr("_n * _mean / n")).over(group))
        .withColumn("_squares", F.sum(F.expr("_square - _off * _off / _n + _n * (_mean - mean) * (_mean - mean)")).over(group))
        .select(
            *keys, "n", "low", "high", "mean", F.expr("CASE WHEN n > 1 THEN sqrt(greatest(_squares, 0D) / (n - 1)) END").alias("sd"),
            "_high", "_n", "_end", F.expr(f"inline(array({ranks}))").alias("_i", "_rank"),
        )
    )
    found = _holding_the_rank(found)
    for table, narrowed, column in ((middles, ["_high"], "_middle"), (counted, ["_high", "_middle"], "_v")):
        # The join leaves the rows of a bucket together, so the window needs no exchange.
        along = Window.partitionBy(*keys, *narrowed, "_i").orderBy(column)
        held = table.join(found, [*keys, *narrowed]).withColumn("_end", F.sum("_n").over(_up_to_here(along)))
        found = _holding_the_rank(held)
    return found.select(*keys, *_TOTALS, "_i", "_v")


def _mixed(n: Column, below: Column, above: Column, p: float) -> Column:
    """The value at ``p * (n - 1)``, between those at the ranks next to it."""
    weight = p * (n - 1) - F.floor(p * (n - 1))
    return F.when((below == above) | (weight == 0), below).otherwise(below * (1 - weight) + above * weight)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    moments: bool = True,
) -> DataFrame:
    """Per key group: ``n``, ``low``, ``high``, ``mean``, ``sd`` and ``q0``, ``q1``, ... for ``probs``.

    Quantiles interpolate linearly between the ranks next to ``p * (n - 1)``:
    between a finite and an infinite value lies the infinite one, between
    infinities of both signs NaN. Null and NaN values are left out, and so are
    rows with a null key. ``moments=False`` leaves out mean and deviation.
    """
    keys = list(keys)
    points = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        all_present([*keys, "_v"]) & ~F.isnan("_v")
    )
    wide = _ranked(points, keys, [], probs).groupBy(*keys).agg(
        *(F.max(c).alias(c) for c in _TOTALS),
        *(F.expr(f"max(CASE WHEN _i = {i} THEN _v END)").alias(f"_x{i}") for i in range(2 * len(probs))),
    )
    kept = [c for c in _TOTALS if moments or c not in ("mean", "sd")]
    quantiles = [
        _mixed(F.col("n"), F.col(f"_x{2 * i}"), F.col(f"_x{2 * i + 1}"), p).alias(f"q{i}") for i, p in enumerate(probs)
    ]
    return wide.select(*keys, *kept, *quantiles)


def exact_quantiles_of(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """As ``exact_quantiles`` for several measures in one search: a struct column for each, with the fields it gives.

    A group in which a measure has no value has a null struct.
    """
    keys, values = list(keys), list(values)
    numbered = F.array(*(F.struct(F.lit(m).alias("m"), F.col(v).cast("double").alias("v")) for m, v in enumerate(values)))
    points = df.select(*keys, F.explode(numbered).alias("_p")).select(*keys, F.col("_p.m").alias("_m"), F.col("_p.v").alias("_v"))
    points = points.filter(all_present([*keys, "_v"]) & ~F.isnan("_v"))

    def of(m: int, c: str, i: int | None = None) -> Column:
        return F.expr(f"max(CASE WHEN _m = {m}{'' if i is None else f' AND _i = {i}'} THEN {c} END)")

    wide = _ranked(points, keys, ["_m"], probs).groupBy(*keys).agg(
        *(of(m, c).alias(f"_{c}{m}") for m in range(len(values)) for c in _TOTALS),
        *(of(m, "_v", i).alias(f"_x{m}_{i}") for m in range(len(values)) for i in range(2 * len(probs))),
    )

    def summary(m: int) -> Column:
        n = F.col(f"_n{m}")
        quantiles = [_mixed(n, F.col(f"_x{m}_{2 * i}"), F.col(f"_x{m}_{2 * i + 1}"), p).alias(f"q{i}") for i, p in enumerate(probs)]
        return F.when(n.isNotNull(), F.struct(*(F.col(f"_{c}{m}").alias(c) for c in _TOTALS), *quantiles))

    return wide.select(*keys, *(summary(m).alias(v) for m, v in enumerate(values)))


def _up_to_here(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _holding_the_rank(rows: DataFrame) -> DataFrame:
    """The rows that the 0-based rank falls on, with the rank counted from the start of each."""
    held = rows.filter("_rank >= _end - _n AND _rank < _end")
    return held.withColumn("_rank", F.expr("_rank - (_end - _n)")).drop("_n", "_end")
