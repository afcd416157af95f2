"""The feature table: one lazy plan from raw log to model input."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.calendar import DEFAULT_ANCHOR
from cadenza.operators.panel import (
    drop_weeks,
    expanded,
    fill_zero,
    track_cells,
    with_release_year,
    with_week,
)
from cadenza.schemas import FEATURE_COLUMNS

# The incomplete first and last week of the published three-year log.
PUBLISHED_PARTIAL_WEEKS = [1, 158]

STATIC = ["popularity", "release_date", "duration_ms", "danceability", "acousticness", "instrumentalness"]
MEASURES = {
    "play_count": ("play_count", 0),
    "lag_like_count": ("like_count", 1),
    "lag_skip_count": ("skip_count", 1),
    "lag_playtime_ratio": ("playtime_ratio", 1),
    **{f"lag_{k}": ("play_count", k) for k in range(1, 6)},
}


def build_features(
    sessions: DataFrame,
    tracks: DataFrame,
    anchor: date = DEFAULT_ANCHOR,
    *,
    partial_weeks: list[int],
    calendar: bool = False,
) -> DataFrame:
    """17 columns per track and week, the week to forecast included.

    `sessions` is the raw log, `tracks` the catalogue keyed by track_id with
    release_date as text.  `partial_weeks` names the incomplete weeks of this log,
    which are left out.
    """
    return feature_rows(feature_tracks(sessions, tracks, anchor, partial_weeks=partial_weeks, calendar=calendar))


def feature_tracks(
    sessions: DataFrame,
    tracks: DataFrame,
    anchor: date = DEFAULT_ANCHOR,
    *,
    partial_weeks: list[int],
    calendar: bool = False,
) -> DataFrame:
    """What build_features holds, one row per track and not yet expanded to weeks: its size follows the log, not
    tracks times weeks."""
    log = with_week(drop_weeks(sessions, partial_weeks, anchor), anchor)
    return track_cells(log, with_release_year(tracks), STATIC, future=True, calendar=calendar)


def feature_rows(by_track: DataFrame) -> DataFrame:
    """The feature rows of the tracks in a table of feature_tracks."""
    return fill_zero(expanded(by_track, STATIC, MEASURES)).select(*FEATURE_COLUMNS)


#: Weeks of a track that are laid out by week as one row, and the rows that a task makes of them.
WEEKS_TOGETHER = 16
LAID_OUT_ROWS = 2_000_000


def rows_by_week(by_track: DataFrame) -> DataFrame:
    """The rows of feature_rows in order of week and track, some weeks and a share of the tracks in each task.

    A track is shuffled as one row for every `WEEKS_TOGETHER` weeks, with the cells that these look back to, and expanded
    where it arrives: what a row of the grid repeats is not shuffled with it.
    """
    weeks = by_track.select("_weeks").limit(1)
    first = weeks.first()
    n_weeks = len(first["_weeks"] or ()) if first else 0
    if not n_weeks:
        return feature_rows(by_track)
    together = min(WEEKS_TOGETHER, n_weeks)
    slices = max(-(-by_track.count() * together // LAID_OUT_ROWS), 1)
    begin, end = F.col("_from"), F.least(F.col("_from") + together, F.lit(n_weeks)) - 1
    deepest = max(k for _, k in MEASURES.values())
    seen = F.get("_weeks", F.greatest(begin - deepest, F.lit(0))), F.get("_weeks", end)
    parts = by_track.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_weeks - 1), F.lit(together))).alias("_from"))
    cells = F.map_filter("_cells", lambda week, _: week.between(*seen))
    task = F.floor(begin / together) * slices + F.pmod(F.xxhash64("track_id"), F.lit(slices))
    laid_out = parts.select("track_id", *STATIC, "_from", cells.alias("_cells")).repartitionById(
        -(-n_weeks // together) * slices, task.cast("int"))
    rows = expanded(laid_out.withColumn("_weeks", weeks.scalar()), STATIC, MEASURES, F.sequence(begin, end))
    return fill_zero(rows).select(*FEATURE_COLUMNS).sortWithinPartitions("week", "track_id")


#: Rows that a task unpacks at a time.
UNPACKED_ROWS = 50_000


def packed(by_track: DataFrame) -> DataFrame:
    """A table of feature_tracks in the form `unpacked` reads: attributes as doubles, the weeks of the log, and of the
    track's non-empty weeks their numbers and measures."""
    entries = F.map_entries("_cells")
    measures = sorted({m for m, _ in MEASURES.values()})
    cells = by_track.select("*", entries.alias("_entries"))
    return cells.select(
        *[F.col(c).cast("double").alias(c) for c in STATIC], F.col("_weeks").alias("weeks"),
        F.col("_entries.key").alias("cell_weeks"), *[F.col("_entries.value")[m].alias(m) for m in measures])


def unpacked(columns: list[str]):
    """A function that makes the feature rows, the given columns without track and week, of batches of `packed`.

    The rows are those of feature_rows, as doubles: what is null or NaN there is 0.  For operators that expand the tracks in the
    task that reads them; nothing but arrays of numbers is made for a row.  Nested, so that it travels to the executors whole.
    """
    static, measured, at_a_time = list(STATIC), dict(MEASURES), UNPACKED_ROWS

    def expand(rows, weeks):
        tracks, span = len(rows), len(weeks)
        held = [() if w is None else w for w in rows["cell_weeks"]]
        track = np.repeat(np.arange(tracks), [len(w) for w in held])
        place = np.searchsorted(weeks, np.concatenate([np.asarray(w, dtype=weeks.dtype) for w in held]))
        out = np.zeros((len(columns), tracks, span))
        of_cells = {}
        for i, c in enumerate(columns):
            if c in static:
                out[i] = rows[c].to_numpy(dtype=float)[:, None]
                continue
            measure, back = measured[c]
            if measure not in of_cells:
                of_cells[measure] = np.concatenate([np.asarray(() if v is None else v, dtype=float) for v in rows[measure]])
            # What a week holds is seen `back` weeks of the log later.
            inside = place + back < span
            out[i, track[inside], place[inside] + back] = of_cells[measure][inside]
        out[np.isnan(out)] = 0.0
        return pd.DataFrame(out.reshape(len(columns), -1).T, columns=columns)

    def run(batches):
        for batch in batches:
            known = batch[batch["weeks"].notna()]
            if len(known) and len(known["weeks"].iloc[0]):
                # All tracks have the same weeks.
                weeks = np.asarray(known["weeks"].iloc[0])
                step = max(at_a_time // len(weeks), 1)
                for start in range(0, len(known), step):
                    yield expand(known.iloc[start:start + step], weeks)

    return run
