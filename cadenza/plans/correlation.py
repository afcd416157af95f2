"""Correlation report over eight row sets of the listenability panel."""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.calendar import DEFAULT_ANCHOR
from cadenza.operators.correlation import MOMENTS, correlations, merge_moments, moment_state
from cadenza.operators.panel import drop_weeks, expanded, track_cells, with_release_year, with_week
from cadenza.schemas import TRACK_ATTRIBUTES

# Fixed value: weeks up to this one have incomplete lags and are the warm-up.
WARM_UP = 4


#: Measures of a track's week, and how many rows of the panel a task expands at a time.
CELL_MEASURES = ["play_count", "like_count", "playtime_ratio", "listenability"]
PANEL_ROWS = 50_000


def _marked(sessions: DataFrame, tracks: DataFrame, anchor: date, partial_weeks: list[int] | None) -> tuple[DataFrame, DataFrame]:
    """The log by week without its incomplete weeks, and the catalogue with `active`: whether a track occurs anywhere."""
    log = with_week(drop_weeks(sessions, partial_weeks or [], anchor), anchor)
    played = sessions.select("track_id").filter(F.col("track_id").isNotNull()).distinct()
    # Marked on the catalogue, before it is expanded to weeks.
    marked = with_release_year(tracks).join(played.withColumn("active", F.lit(True)), "track_id", "left")
    return log, marked.fillna(False, ["active"])


def listenability_panel(
    sessions: DataFrame,
    tracks: DataFrame,
    attributes: list[str],
    anchor: date = DEFAULT_ANCHOR,
    partial_weeks: list[int] | None = None,
) -> DataFrame:
    """Per track and week: measures, listenability, its lags, attributes, `active`.

    `active` marks tracks that occur anywhere in the log, the incomplete
    weeks included.  Lags before the first week are null.
    """
    return listenability_rows(listenability_tracks(sessions, tracks, attributes, anchor, partial_weeks), attributes)


def listenability_tracks(
    sessions: DataFrame,
    tracks: DataFrame,
    attributes: list[str],
    anchor: date = DEFAULT_ANCHOR,
    partial_weeks: list[int] | None = None,
) -> DataFrame:
    """What listenability_panel holds, one row per track: to be stored (`write_features(…, format="tracks")`) where the
    panel is read more than once, or every pass would start from the log."""
    log, marked = _marked(sessions, tracks, anchor, partial_weeks)
    return track_cells(log, marked, [*attributes, "active"])


def listenability_rows(by_track: DataFrame, attributes: list[str]) -> DataFrame:
    """The panel rows of the tracks in a table of listenability_tracks."""
    return expanded(by_track, [*attributes, "active"], {
        **{m: (m, 0) for m in ("play_count", "like_count", "playtime_ratio", "listenability")},
        **{f"lag_{k}": ("listenability", k) for k in (1, 2, 3)},
    })


def listenability_totals(panel: DataFrame, attributes: list[str]) -> DataFrame:
    """Summed listenability and the attributes of each track; one grouping, no join."""
    return panel.groupBy("track_id", "active").agg(
        F.sum("listenability").alias("listenability"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("week"))).alias(c) for c in attributes],
    )


def listenability_cells(
    sessions: DataFrame,
    tracks: DataFrame,
    attributes: list[str] | None = None,
    anchor: date = DEFAULT_ANCHOR,
    partial_weeks: list[int] | None = None,
) -> DataFrame:
    """What listenability_panel holds, one row per track and not yet expanded: `active`, the attributes, the weeks
    of the log, and of the track's non-empty weeks their numbers and measures."""
    attributes = attributes or TRACK_ATTRIBUTES
    log, marked = _marked(sessions, tracks, anchor, partial_weeks)
    cells = track_cells(log, marked, [*attributes, "active"]).withColumn("_entries", F.map_entries("_cells"))
    return cells.select(
        "track_id", "active", *[F.col(c).cast("double").alias(c) for c in attributes], F.col("_weeks").alias("weeks"),
        F.col("_entries.key").alias("cell_weeks"), *[F.col("_entries.value")[m].alias(m) for m in CELL_MEASURES])


def _panel_moments(attributes: list[str]):
    """The function each task runs over its tracks: it expands some of them at a time to all weeks and adds them
    to the states of all row sets: the four strata of the weekly panel with nulls filled, the panel as it is,
    and the sums of tracks."""
    of_batch, merged, lines = moment_state()
    measures = ["listenability", "lag_1", "lag_2", "lag_3", *attributes]
    columns = {
        "weekly": ["week", *measures], "parts": ["week", "play_count", "like_count", "playtime_ratio", *measures],
        "totals": ["listenability", *attributes],
    }

    def moments(batches):
        states = {}

        def add(key, x):
            if len(x):
                part = of_batch(x)
                states[key] = merged(states[key], part) if key in states else part

        def expand(rows):
            weeks = rows["weeks"].iloc[0]
            if weeks is None or not len(weeks):
                return
            weeks = np.asarray(weeks)
            tracks, span = len(rows), len(weeks)
            empty = np.empty(0)
            held = [empty if w is None else w for w in rows["cell_weeks"]]
            track = np.repeat(np.arange(tracks), [len(w) for w in held])
            place = np.searchsorted(weeks, np.concatenate(held).astype(weeks.dtype))
            dense = {}
            for m in CELL_MEASURES:
                dense[m] = np.zeros((tracks, span))
                dense[m][track, place] = np.concatenate([empty if v is None else v for v in rows[m]])
            for k in (1, 2, 3):
                dense[f"lag_{k}"] = np.full((tracks, span), np.nan)
                dense[f"lag_{k}"][:, k:] = dense["listenability"][:, :-k]
            fixed = rows[attributes].to_numpy(dtype=float)
            dense["week"] = np.broadcast_to(weeks.astype(float), (tracks, span))
            full = {"weekly": np.empty((tracks, span, len(columns["weekly"]))), "parts": np.empty((tracks, span, len(columns["parts"])))}
            for name, x in full.items():
                for i, c in enumerate(columns[name]):
                    x[:, :, i] = dense[c] if c in dense else fixed[:, [attributes.index(c)]]
            add(("parts", None, None), full["parts"].reshape(-1, len(columns["parts"])))
            np.nan_to_num(full["weekly"], copy=False)
            active, late = rows["active"].to_numpy(dtype=bool), weeks > WARM_UP
            sums = np.c_[dense["listenability"].sum(axis=1), np.nan_to_num(fixed)]
            for a in (False, True):
                add(("totals", a, None), sums[active == a])
                mine = full["weekly"][active == a]
                for z in (False, True):
                    add(("weekly", a, z), mine[:, late == z].reshape(-1, mine.shape[2]))

        for batch in batches:
            if len(batch):
                weeks = batch["weeks"].iloc[0]
                step = max(PANEL_ROWS // max(len(weeks) if weeks is not None else 1, 1), 1)
                for start in range(0, len(batch), step):
                    expand(batch.iloc[start:start + step])
        for (rows, active, late), state in states.items():
            out = lines(state, columns[rows])
            out.insert(0, "row_set", rows)
            out.insert(1, "active", pd.array([active] * len(out), dtype="boolean"))
            out.insert(2, "late", pd.array([late] * len(out), dtype="boolean"))
            yield out

    return moments


def correlation_report(cells: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Correlations in long form (variant, attr_a, attr_b, r), from the table of listenability_cells.

    Variants: all, warm (warm-up weeks removed), active, active_warm,
    totals, totals_active, with_week, with_parts.  Nulls are 0 except in
    with_parts, which is pairwise-complete.  The weekly row sets are unions
    of disjoint strata.  One pass over the tracks serves all of them: a task expands its tracks to weeks in
    memory, some at a time, and hands on one line per row set and column pair.  No row of the
    panel is shuffled or written.
    """
    attributes = attributes or TRACK_ATTRIBUTES
    lines = cells.drop("track_id").mapInPandas(
        _panel_moments(attributes), f"row_set string, active boolean, late boolean, {MOMENTS}")
    on_week = (F.col("attr_a") == "week") | (F.col("attr_b") == "week")

    def variants(**members: Column) -> Column:
        return F.filter(F.array(*[F.when(c, F.lit(v)) for v, c in members.items()]), lambda v: v.isNotNull())

    always = F.lit(True)
    member = (
        F.when(F.col("row_set") == "parts", variants(with_parts=always))
        .when(F.col("row_set") == "totals", variants(totals=always, totals_active=F.col("active")))
        .when(on_week, variants(with_week=always))
        .otherwise(variants(all=always, with_week=always, warm=F.col("late"), active=F.col("active"), active_warm=F.col("late") & F.col("active")))
    )
    moments = merge_moments(lines.withColumn("variant", F.explode(member)).drop("row_set", "active", "late"), ["variant"])
    return correlations(moments, ["variant"])
