"""Column contract of a measurement panel, and the names operators work with."""

from __future__ import annotations

from dataclasses import dataclass

# Column names, types, labels and notes a panel file and its
# result tables are agreed on.
TEXT_COLUMNS = (
    "genotype",
    "in_beaker",
    "density_category",
    "cross_id",
    "status",
    "water_changed",
)
DERIVED_TEXT_COLUMNS = ("housing", "genotype_housing")
DOUBLE_COLUMNS = (
    "survival_rate",
    "volume_per_fish",
    "fish_density",
    "survival_rate_change",
    "remaining",
    "cumulative_deaths",
    "max_decline",
)
LONG_COLUMNS = (
    "days_since_fertilization",
    "initial_count",
    "fish_deaths",
    "vol_water_total",
    "vol_water_changed",
    "critical_day",
)
HOUSED_TOGETHER = "Beaker"
HOUSED_ALONE = "Dish"
BEAKER_FLAG = "yes"
MISSING_GENOTYPE = "NA"
MISSING_GROUP = "Unknown"
NEVER_REACHED = "> Max Day"
FINAL_SURVIVAL = "final_survival_rate"
CRITICAL_DAY = "critical_day"
NOTE_INSUFFICIENT = "Insufficient data"
NOTE_NAN = "Calculation resulted in NaN"
NOTE_SIGNIFICANT = "Significant (p<0.05)"
NOTE_NOT_SIGNIFICANT = "Not Significant (p>=0.05)"
ANOVA_SIGNIFICANT = "Significant difference between {} groups (p<0.05)"
ANOVA_NOT_SIGNIFICANT = "No significant difference between {} groups (p>=0.05)"
ANOVA_NAN = "Result is NaN"
ANOVA_SKIPPED = "ANOVA Not Performed"
SIGNIFICANCE_LEVEL = 0.05


@dataclass(frozen=True)
class PanelSpec:
    """Names of the panel columns; the defaults are the contract above.

    ``housing_type`` is the name that tables of individuals give to the housing.
    """

    unit: str = "dish_id"
    time: str = "days_since_fertilization"
    survival: str = "survival_rate"
    change: str = "survival_rate_change"
    cumulative: str = "cumulative_deaths"
    remaining: str = "remaining"
    initial: str = "initial_count"
    genotype: str = "genotype"
    housing: str = "housing"
    density: str = "density_category"
    genotype_housing: str = "genotype_housing"
    cross: str = "cross_id"
    water: str = "vol_water_total"
    volume_per_unit: str = "volume_per_fish"
    crowding: str = "fish_density"
    housing_type: str = "housing_type"

    @property
    def unit_groups(self) -> tuple[str, ...]:
        """Columns that group units."""
        return (self.genotype, self.housing, self.density, self.cross, self.genotype_housing)

    @property
    def strata(self) -> tuple[str, str]:
        """Columns that a table of individuals is stratified by."""
        return (self.housing_type, self.density)


PANEL = PanelSpec()
