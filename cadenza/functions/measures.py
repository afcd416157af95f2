"""Listening measures, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.calendar import as_column, elapsed_ms


def listenability(
    play_count: Column | str = "play_count",
    playtime_ratio: Column | str = "playtime_ratio",
    like_count: Column | str = "like_count",
) -> Column:
    """Plays weighted by how much was heard, plus likes."""
    return as_column(play_count) * as_column(playtime_ratio) + as_column(like_count)


def playtime_ratio(
    next_event_type: Column | str = "next_event_type",
    start: Column | str = "timestamp",
    end: Column | str = "next_timestamp",
    duration_ms: Column | str = "duration_ms",
) -> Column:
    """Heard share of a play: up to the skip that follows it, else all of it.

    Not clamped.  A skipped play of a track without a usable duration has no
    ratio (null), so averages leave it out.
    """
    skipped = as_column(next_event_type).eqNullSafe(F.lit("skip"))
    heard = F.try_divide(elapsed_ms(start, end), as_column(duration_ms).cast("double"))
    return F.when(skipped, heard).otherwise(F.lit(1.0))
