from .curves import (
    cumulative_events,
    faceted_curves,
    median_survival,
    rate_change_curve,
    remaining_curve,
    survival_curve,
    unit_curves,
    worst_day,
)
from .distributions import (
    critical_period_stats,
    distribution_box,
    distribution_histogram,
    distribution_points,
)
from .events import individuals, individuals_weighted, unit_time_to_event, weigh
from .hazard import nelson_aalen
from .inference import one_way_anova, welch_ttest
from .quantiles import exact_quantiles, exact_quantiles_of
from .reductions import (
    final_per_unit,
    first_metric_per_unit,
    latest_rows,
    metric_per_unit,
    steepest_decline_per_unit,
)
from .sketches import (
    approximate_quantiles,
    merge_quantile_states,
    merge_unit_counts,
    quantile_rank_error,
    quantile_states,
    quantiles_of_states,
    unit_count_error,
    unit_count_states,
    unit_counts,
)
from .snapshots import final_level, final_points, linear_trend, scatter
from .summaries import UnitSummary, stored_summary, unit_summary
from .tables import group_options, panel_preview, stats_table

__all__ = [
    "UnitSummary",
    "approximate_quantiles",
    "critical_period_stats",
    "cumulative_events",
    "distribution_box",
    "distribution_histogram",
    "distribution_points",
    "exact_quantiles",
    "exact_quantiles_of",
    "faceted_curves",
    "final_level",
    "final_per_unit",
    "final_points",
    "first_metric_per_unit",
    "group_options",
    "individuals",
    "individuals_weighted",
    "latest_rows",
    "linear_trend",
    "median_survival",
    "merge_quantile_states",
    "merge_unit_counts",
    "metric_per_unit",
    "nelson_aalen",
    "one_way_anova",
    "panel_preview",
    "quantile_rank_error",
    "quantile_states",
    "quantiles_of_states",
    "rate_change_curve",
    "remaining_curve",
    "scatter",
    "stats_table",
    "steepest_decline_per_unit",
    "stored_summary",
    "survival_curve",
    "unit_count_error",
    "unit_count_states",
    "unit_counts",
    "unit_curves",
    "unit_summary",
    "unit_time_to_event",
    "weigh",
    "welch_ttest",
    "worst_day",
]
