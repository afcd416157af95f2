"""The track x week panel: counts, grid, lags, future week, attributes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import functions as fn
from cadenza.functions.calendar import DEFAULT_ANCHOR
from cadenza.operators.catalogue import first_row
from cadenza.operators.sequence import COUNTED_EVENTS, mean_ratio, weekly_cells


def with_week(sessions: DataFrame, anchor: date = DEFAULT_ANCHOR) -> DataFrame:
    """Add the week number; rows without a timestamp are dropped."""
    return sessions.filter(F.col("timestamp").isNotNull()).withColumn(
        "week", fn.week_since_anchor("timestamp", anchor)
    )


def drop_weeks(sessions: DataFrame, weeks: list[int], anchor: date = DEFAULT_ANCHOR) -> DataFrame:
    """Leave out incomplete weeks, usually the first and the last.

    The condition is on the raw timestamp, so it reaches the file scan.
    """
    for week in weeks:
        # As text: a Python datetime would be read in the driver's own time zone.
        begin, end = (
            F.lit(fn.week_start(w, anchor).isoformat(" ")).cast("timestamp_ntz") for w in (week, week + 1)
        )
        sessions = sessions.filter((F.col("timestamp") < begin) | (F.col("timestamp") >= end))
    return sessions


def weekly_event_counts(sessions: DataFrame) -> DataFrame:
    """Plays, likes and skips per (track, week); a fixed set of columns, 0 where none."""
    return (
        sessions.filter(F.col("track_id").isNotNull() & F.col("event_type").isNotNull())
        .groupBy("track_id", "week")
        .agg(*[
            F.count_if(F.col("event_type") == event).alias(f"{event}_count") for event in COUNTED_EVENTS
        ])
    )


def mean_playtime(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Mean heard share per (track, week) over the plays of known tracks; the log is read once."""
    plays = weekly_cells(sessions).filter("play_count > 0")
    ratio = mean_ratio(
        F.col("play_count"), F.col("skipped_plays"), F.col("skipped_ms"), F.col("duration_ms")
    )
    return plays.join(unique_tracks(tracks, ["duration_ms"]), "track_id").select(
        "track_id", "week", ratio.alias("playtime_ratio")
    )


def unique_tracks(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """One row per non-null track id; of repeated ids the one that comes first by all its columns
    in order of name, nulls last, whichever columns are asked for.

    Spread by track over a fixed number of tasks: the rows are few, but what
    follows expands each of them to all weeks, and adaptive merging of small
    partitions would leave that to a handful of tasks.
    """
    tasks = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = tracks.filter(F.col("track_id").isNotNull())
    if not columns:
        return known.select("track_id").repartition(tasks, "track_id").distinct()
    return (
        known.repartition(tasks, "track_id").groupBy("track_id")
        .agg(first_row(tracks).alias("_row"))
        .select("track_id", *[F.col("_row")[c].alias(c) for c in columns])
    )


def observed_weeks(rows: DataFrame, calendar: bool = False, future: bool = False) -> DataFrame:
    """One row, one column: the sorted array of weeks that rows are seen in.

    All rows count, also those without a track.  `calendar` fills gaps,
    `future` adds one week after the last.  The array is as long as the
    calendar span of the log in weeks, whatever the number of rows.
    """
    span = rows.agg(F.sort_array(F.collect_set("week")).alias("weeks"))
    seen = F.col("weeks")
    if calendar:
        seen = F.sequence(F.array_min("weeks"), F.array_max("weeks"))
    if future:
        seen = F.concat(seen, F.array(F.array_max("weeks") + 1))
    return span.select(F.when(F.size("weeks") > 0, seen).alias("weeks"))


def track_week_grid(tracks: DataFrame, sessions: DataFrame, calendar: bool = False) -> DataFrame:
    """Every track in every observed week.

    Each track row is expanded in place from the week array: no join, and
    the grid stays distributed the way the tracks are.
    """
    weeks = observed_weeks(sessions, calendar)
    return unique_tracks(tracks, []).select("track_id", F.explode(weeks.scalar()).alias("week"))


def left_join_measures(grid: DataFrame, measures: DataFrame) -> DataFrame:
    """Attach (track, week) measures to the grid, 0 where there are none."""
    joined = grid.join(measures, ["track_id", "week"], "left")
    return fill_zero(joined.select(
        *grid.columns,
        *[F.col(c).cast("double") for c in measures.columns if c not in ("track_id", "week")],
    ))


def append_future_week(panel: DataFrame, tracks: DataFrame) -> DataFrame:
    """One more row per track for the week after the last, with zero measures."""
    coming = panel.agg((F.max("week") + 1).alias("week"))
    measures = [c for c in panel.columns if c not in ("track_id", "week")]
    rows = unique_tracks(tracks, []).select(
        "track_id", coming.scalar().alias("week"), *[F.lit(0.0).alias(c) for c in measures]
    )
    return panel.unionByName(rows)


def lagged(panel: DataFrame, lags: dict[str, tuple[str, int]]) -> DataFrame:
    """Add columns named in `lags`: {new: (column, rows back)}, per track by week."""
    by_week = W.partitionBy("track_id").orderBy("week")
    return panel.withColumns({new: F.lag(c, k).over(by_week) for new, (c, k) in lags.items()})


#: Last week's likes, skips and ratio, and five weeks of play counts; three weeks of past listenability.
FEATURE_LAGS = {
    "lag_like_count": ("like_count", 1),
    "lag_skip_count": ("skip_count", 1),
    "lag_playtime_ratio": ("playtime_ratio", 1),
    **{f"lag_{k}": ("play_count", k) for k in range(1, 6)},
}
LISTENABILITY_LAGS = {f"lag_{k}": ("listenability", k) for k in range(1, 4)}


def lag_features(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """The lags of every track and week, looked up per track: the grid is not shuffled or sorted for them."""
    return dense_panel(sessions, tracks, [], FEATURE_LAGS)


def listenability_lags(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    return dense_panel(sessions, tracks, [], LISTENABILITY_LAGS)


def with_release_year(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("release_date", fn.release_year("release_date"))


def enrich_tracks(panel: DataFrame, tracks: DataFrame, columns: list[str]) -> DataFrame:
    """Left join track attributes; which side is broadcast, if any, is decided by size."""
    return panel.join(unique_tracks(tracks, columns), "track_id", "left")


def fill_zero(df: DataFrame) -> DataFrame:
    """Null to 0 in every numeric column."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=numeric)


def track_cells(
    sessions: DataFrame, tracks: DataFrame, columns: list[str], future: bool = False, calendar: bool = False
) -> DataFrame:
    """One row per track: the given columns, `_cells`, a map from week to its measures, and `_weeks`, all weeks of the log.

    The log is reduced to non-empty (track, week) cells and these to one map per track.  The weeks come
    from the same cells, those of rows without a track among them, so the log is scanned and shuffled once:
    both uses of the cells read the one exchange that places them by track, and the maps are made once.  A cell is one column,
    unpacked for the weeks by a generator, as an exchange that lacks a column is another one.  They meet the tracks under a key that is never
    null itself, or the join would leave out the null track below and so take the exchange from the other use.
    """
    tasks = int(sessions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = list(dict.fromkeys([*columns, "duration_ms"]))
    measures = F.struct("play_count", "like_count", "skip_count", "skipped_plays", "skipped_ms")
    placed = weekly_cells(sessions).select(
        F.struct("track_id").alias("_key"), F.struct("week", measures.alias("measures")).alias("_cell")
    ).repartition(tasks, "_key")
    cells = placed.groupBy("_key").agg(F.map_from_entries(F.collect_list("_cell")).alias("_cells"))

    def measured(_, cell):
        ratio = mean_ratio(
            cell["play_count"], cell["skipped_plays"], cell["skipped_ms"], F.col("duration_ms")
        )
        heard = F.coalesce(F.when(cell["play_count"] > 0, ratio), F.lit(0.0))
        return F.struct(
            *[cell[c].cast("double").alias(c) for c in ("play_count", "like_count", "skip_count")],
            heard.alias("playtime_ratio"),
            fn.listenability(cell["play_count"], heard, cell["like_count"]).alias("listenability"),
        )

    seen = placed.select(F.inline(F.array("_cell"))).select("week")
    return (
        unique_tracks(tracks, needed).withColumn("_key", F.struct("track_id")).repartition(tasks, "_key")
        .join(cells, "_key", "left")
        .withColumn("_cells", F.transform_values("_cells", measured))
        .withColumn("_weeks", observed_weeks(seen, calendar, future).scalar())
        .select("track_id", *columns, "_cells", "_weeks")
    )


def dense_panel(
    sessions: DataFrame,
    tracks: DataFrame,
    columns: list[str],
    measures: dict[str, tuple[str, int]],
    future: bool = False,
    calendar: bool = False,
) -> DataFrame:
    """The panel with its history, built without shuffling a single grid row.

    The log is reduced to one row of `track_cells` per track; only then is each track
    expanded to all its weeks.  A row k weeks back is a map lookup, so there is no
    window sort over the grid either.

    Returns track_id, week, the given track columns, and the columns named in
    `measures`: {new: (measure, rows back)}, where a measure is one of
    play_count, like_count, skip_count, playtime_ratio, listenability.  Cells
    without events are 0; rows before the first week are null.
    """
    return expanded(track_cells(sessions, tracks, columns, future, calendar), columns, measures)


def expanded(
    cells: DataFrame, columns: list[str], measures: dict[str, tuple[str, int]], places: Column | None = None
) -> DataFrame:
    """The panel from the table of track_cells, in place: what is asked of it decides which weeks and columns are made.

    `places` are the numbers, from 0, of the weeks that a row is expanded to; all of them by default.
    """
    depths = sorted({k for _, k in measures.values()})
    held = ["track_id", *columns, "_cells", "_weeks"]
    if places is None:
        rows = cells.select(*held, F.posexplode("_weeks").alias("_pos", "week"))
    else:
        rows = cells.select(*held, F.explode(places).alias("_pos")).withColumn("week", F.get("_weeks", F.col("_pos")))
    rows = (
        rows
        .select("track_id", "week", *columns, "_pos", *[
            F.try_element_at("_cells", F.get("_weeks", F.col("_pos") - k)).alias(f"_back_{k}") for k in depths
        ])
    )
    return rows.select("track_id", "week", *columns, *[
        F.when(F.col("_pos") >= k, F.coalesce(F.col(f"_back_{k}")[m], F.lit(0.0))).alias(name)
        for name, (m, k) in measures.items()
    ])
