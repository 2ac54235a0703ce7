"""One stored row per unit that the per-unit reductions are read from.

Final values, first groups and steepest declines are extremes of structs, so a
table of them merges: the state of old days and that of new days give the state
of all days, and the old rows are never read again. Stored bucketed by unit, the
table is neither shuffled to be merged nor to be read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contract as C
from ..contract import PANEL, PanelSpec
from ..functions.columns import as_double, as_long, as_text, require_columns


def _first(groups: Sequence[str]) -> str:
    return "__".join(["first", *groups])


@dataclass(frozen=True)
class UnitSummary:
    """States per unit; ``welch_ttest``, ``one_way_anova``, ``distribution_box``, ``critical_period_stats`` and the
    reductions they use take it in place of a panel.

    ``groups`` are the lists of group columns whose first values are known
    together, ``declines`` the group columns that steepest declines are known by.
    """

    states: DataFrame
    groups: tuple[tuple[str, ...], ...]
    declines: tuple[str, ...]
    spec: PanelSpec = PANEL

    def final(self, groups: Sequence[str], name: str, with_time: bool) -> DataFrame:
        """As ``final_per_unit`` on the panel."""
        groups = tuple(groups)
        if groups not in self.groups:
            raise ValueError(f"the summary does not have the groups {list(groups)} together, but {[list(g) for g in self.groups]}")
        time = [F.col("last.t").alias(self.spec.time)] if with_time else []
        first = F.col(_first(groups))
        return self.states.select(self.spec.unit, *time, F.col("last.v").alias(name), *(first.getField(g).alias(g) for g in groups))

    def decline(self, group: str) -> DataFrame:
        """As ``steepest_decline_per_unit`` on the panel."""
        if group not in self.declines:
            raise ValueError(f"the summary has no declines by {group!r}, but by {list(self.declines)}")
        low, first = F.col(f"low__{group}"), F.col(f"change__{group}")
        return self.states.filter(low.isNotNull()).select(
            self.spec.unit, low["t"].alias(C.CRITICAL_DAY), low["v"].alias("max_decline"), first.getField(group).alias(group)
        )

    def merge(self, newer: UnitSummary) -> UnitSummary:
        """The summary of both panels together; of a unit that both have, the states meet."""
        if (self.groups, self.declines, self.spec) != (newer.groups, newer.declines, newer.spec):
            raise ValueError("summaries of different columns")
        unit = self.spec.unit
        old, new = self.states.alias("old"), newer.states.alias("new")
        both = old.join(new, F.col(f"old.{unit}") == F.col(f"new.{unit}"), "full_outer")

        def met(name: str) -> Column:
            # greatest and least leave nulls out, as max and min do
            pick = F.greatest if name == "last" else F.least
            return pick(F.col(f"old.{name}"), F.col(f"new.{name}")).alias(name)

        states = [n for n in self.states.columns if n != unit]
        return replace(self, states=both.select(F.coalesce(f"old.{unit}", f"new.{unit}").alias(unit), *map(met, states)))

    def save(self, table: str, buckets: int, path: str | None = None) -> UnitSummary:
        """Writes the states as a table bucketed by unit (replacing one of that name) and gives the summary that reads it.

        A table cannot be replaced by what is read from it: merge into one of another name.
        """
        writer = self.states.write.mode("overwrite").format("parquet").bucketBy(buckets, self.spec.unit).sortBy(self.spec.unit)
        (writer.option("path", path) if path else writer).saveAsTable(table)
        return replace(self, states=self.states.sparkSession.table(table))


def unit_summary(
    df: DataFrame,
    groups: Sequence[Sequence[str]] | None = None,
    declines: Sequence[str] | None = None,
    spec: PanelSpec = PANEL,
) -> UnitSummary:
    """States of every unit of a panel, by one map-side combined aggregate.

    ``groups``: lists of group columns (default: genotype, housing and density
    alone, and genotype with housing); ``declines``: group columns (default:
    density). Rows without a unit are left out, also by operators that count
    them as a unit when they read a panel.
    """
    groups = _groups(groups, spec)
    declines = tuple(declines or (spec.density,))
    columns = list(dict.fromkeys([*(g for one in groups for g in one), *declines]))
    require_columns(df, spec.unit, spec.time, spec.survival, spec.change, *columns)
    t, v, change = as_long(df, spec.time), as_double(df, spec.survival), as_double(df, spec.change)
    text = {c: as_text(df, c) for c in columns}
    states = [F.max(F.struct(t.alias("t"), v.alias("v"))).alias("last")]
    states += [F.min(F.struct(t.alias("t"), *(text[g].alias(g) for g in one))).alias(_first(one)) for one in groups]
    for g in declines:
        known = text[g].isNotNull() & t.isNotNull() & change.isNotNull()
        states.append(F.min(F.when(known, F.struct(change.alias("v"), t.alias("t")))).alias(f"low__{g}"))
        states.append(F.min(F.when(known, F.struct(t.alias("t"), text[g].alias(g)))).alias(f"change__{g}"))
    return UnitSummary(df.filter(F.col(spec.unit).isNotNull()).groupBy(F.col(spec.unit)).agg(*states), groups, declines, spec)


def stored_summary(
    spark: SparkSession,
    table: str,
    groups: Sequence[Sequence[str]] | None = None,
    declines: Sequence[str] | None = None,
    spec: PanelSpec = PANEL,
) -> UnitSummary:
    """The summary that ``save`` wrote, with the columns that it was made with."""
    return UnitSummary(spark.table(table), _groups(groups, spec), tuple(declines or (spec.density,)), spec)


def _groups(groups: Sequence[Sequence[str]] | None, spec: PanelSpec) -> tuple[tuple[str, ...], ...]:
    usual = ((spec.genotype,), (spec.housing,), (spec.density,), (spec.genotype, spec.housing))
    return tuple(tuple(g) for g in groups) if groups else usual
