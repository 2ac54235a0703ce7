from .line_item_panel import clean_panel, dirty_panel

__all__ = ["clean_panel", "dirty_panel"]
