"""Panel and survival analytics on Spark: plain functions from DataFrame to DataFrame."""

from .contract import PANEL, PanelSpec
from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .session import build_session
from .sources import conversion_faults, missing_columns, read_panel_csv, read_panel_parquet, standardise_panel

__all__ = [
    "PANEL",
    "PanelSpec",
    "build_session",
    "conversion_faults",
    "missing_columns",
    "read_panel_csv",
    "read_panel_parquet",
    "standardise_panel",
    *_operators,
]
