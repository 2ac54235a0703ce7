from .panel import conversion_faults, missing_columns, read_panel_csv, read_panel_parquet, standardise_panel

__all__ = ["conversion_faults", "missing_columns", "read_panel_csv", "read_panel_parquet", "standardise_panel"]
