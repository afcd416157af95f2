from cadenza.functions.calendar import (
    elapsed_ms,
    iso_week,
    parse_timestamp,
    release_year,
    sunday_week,
    week_number,
    week_since_anchor,
    week_start,
)
from cadenza.functions.measures import listenability, playtime_ratio

__all__ = [
    "elapsed_ms", "iso_week", "listenability", "parse_timestamp", "playtime_ratio",
    "release_year", "sunday_week", "week_number", "week_since_anchor", "week_start",
]
