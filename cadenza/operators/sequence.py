"""What follows an event, and what a week holds of a track: next_event, playtime_ratio, weekly_cells.

Events are ordered within (week, track, user).  One such group may be huge
(an anonymous user id, a bot), so it is cut into ten-minute slots that Spark
can sort on different tasks; the last event of a slot is then matched with the
first event of the group's next slot, of which there are at most 1008 a week.
A play and the skip that ends it mostly share a slot.  The result is the same
as one window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza import functions as fn
from cadenza.operators.catalogue import first_row

GROUP = ["week", "track_id", "user_id"]
COUNTED_EVENTS = ["play", "like", "skip"]
#: Groups a week that rows outside any sequence are spread over.
SALTS = 64


def time_slot(ts: str = "timestamp") -> Column:
    """Number of the ten minutes a time lies in; never decreases with time."""
    return F.unix_date(F.to_date(ts)) * 144 + F.hour(ts) * 6 + F.floor(F.minute(ts) / 10)


def event_order(sessions: DataFrame) -> list[str]:
    """Order of events in a group.

    Equal timestamps fall back to event_id; a log without one falls back to
    the event type, which puts a play before its skip.
    """
    return ["timestamp", "event_id" if "event_id" in sessions.columns else "event_type"]


def without_likes(sessions: DataFrame) -> DataFrame:
    """Drop likes; unlike a plain <> this keeps rows whose event type is null."""
    return sessions.filter(~F.col("event_type").eqNullSafe("like"))


def _slotted(sessions: DataFrame) -> DataFrame:
    """Add _user and _slot, which with week and track cut all rows into small groups.

    Rows that take no part in a sequence, likes and those with a null key, have no _user.  Neither
    order nor user matters for them, so a hot null track or user is salted over `SALTS` groups a week.
    """
    keyed = ~F.col("event_type").eqNullSafe("like")
    for key in GROUP:
        keyed = keyed & F.col(key).isNotNull()
    salt = F.pmod(F.xxhash64("timestamp", "event_type"), F.lit(SALTS))
    return sessions.withColumns({"_user": F.when(keyed, F.col("user_id")), "_slot": F.when(keyed, time_slot()).otherwise(salt)})


SLOT_GROUP = ["week", "track_id", "_user"]


def next_event(sessions: DataFrame) -> DataFrame:
    """Add next_timestamp and next_event_type within (week, track, user), likes removed.

    Rows with a null key belong to no group and get nulls.  One window runs over the rows, within their slots; the
    last row of a slot, which it leaves open, meets the first one of the next slot in a window over
    those two rows of each slot.  Both parts read the rows from one shuffle.
    """
    order = event_order(sessions)
    in_slot = W.partitionBy(*SLOT_GROUP, "_slot").orderBy(*order)
    across = W.partitionBy(*SLOT_GROUP).orderBy("_slot", *order)
    following = F.struct("timestamp", "event_type")
    rows = _slotted(without_likes(sessions)).withColumns({
        "_next": F.lead(following).over(in_slot), "_first": F.row_number().over(in_slot) == 1,
    })
    inside = rows.filter(F.col("_next").isNotNull())
    edges = rows.filter(F.col("_next").isNull() | F.col("_first")).withColumn("_after", F.lead(following).over(across))
    last = edges.filter(F.col("_next").isNull()).withColumn("_next", F.col("_after"))
    found = F.when(F.col("_user").isNotNull(), F.col("_next"))
    return inside.drop("_first").unionByName(last.drop("_first", "_after")).select(
        *sessions.columns, found["timestamp"].alias("next_timestamp"), found["event_type"].alias("next_event_type"))


def playtime_ratio(sessions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Every play of a known track with the share of it that was heard."""
    durations = tracks.filter(F.col("track_id").isNotNull()).groupBy("track_id").agg(first_row(tracks)["duration_ms"].alias("duration_ms"))
    plays = next_event(sessions).filter(F.col("event_type") == "play")
    return plays.join(durations, "track_id").withColumn("playtime_ratio", fn.playtime_ratio())


def weekly_cells(sessions: DataFrame) -> DataFrame:
    """Per (track, week): plays, likes, skips, plays cut short by a skip, and milliseconds heard in them.

    All that features need of the log, from one scan and one shuffle of its rows: a slot is reduced to one row
    that carries its counts, its pairs, and its first and last event for the pair that may cross into the next.
    Rows without a track count too, as the cells of a null track tell the weeks they are in.
    """
    in_slot = W.partitionBy(*SLOT_GROUP, "_slot").orderBy(*event_order(sessions))
    across = W.partitionBy(*SLOT_GROUP).orderBy("_slot")
    in_sequence = F.col("_user").isNotNull()
    is_play = in_sequence & F.col("event_type").eqNullSafe("play")
    is_skip = in_sequence & F.col("event_type").eqNullSafe("skip")
    pair = F.col("_is_play") & F.col("_next_skip")
    heard = fn.elapsed_ms("timestamp", "_next_ts")
    carried = F.coalesce(F.col("_last_play") & F.lead("_first_skip").over(across), F.lit(False))
    carried_ms = fn.elapsed_ms("_last_ts", F.lead("_first_ts").over(across))

    marked = (
        _slotted(sessions.filter(F.col("week").isNotNull()))
        .select(*SLOT_GROUP, "_slot", *dict.fromkeys([*event_order(sessions), "event_type"]), is_play.alias("_is_play"), is_skip.alias("_is_skip"))
        .withColumns({
            "_next_ts": F.lead("timestamp").over(in_slot),
            "_next_skip": F.lead("_is_skip").over(in_slot),
            "_place": F.row_number().over(in_slot),
        })
    )
    first, last = F.col("_place") == 1, F.col("_next_ts").isNull()
    slots = marked.groupBy(*SLOT_GROUP, "_slot").agg(
        *[F.count_if(F.col("event_type") == event).alias(f"_{event}") for event in COUNTED_EVENTS],
        F.count_if(pair).alias("_pairs"),
        F.sum(F.when(pair, heard)).alias("_ms"),
        F.max(F.when(first, F.col("timestamp"))).alias("_first_ts"),
        F.max(F.when(first, F.col("_is_skip"))).alias("_first_skip"),
        F.max(F.when(last, F.col("timestamp"))).alias("_last_ts"),
        F.max(F.when(last, F.col("_is_play"))).alias("_last_play"),
    )
    return (
        slots.withColumns({"_carried": carried, "_carried_ms": carried_ms})
        .groupBy("track_id", "week")
        .agg(
            *[F.sum(f"_{event}").alias(f"{event}_count") for event in COUNTED_EVENTS],
            F.sum(F.col("_pairs") + F.col("_carried").cast("int")).alias("skipped_plays"),
            F.sum(
                F.coalesce("_ms", F.lit(0.0)) + F.when(F.col("_carried"), F.col("_carried_ms")).otherwise(0.0)
            ).alias("skipped_ms"),
        )
    )


def play_skip_pairs(sessions: DataFrame) -> DataFrame:
    """The (track, week) cells in which a skip cut a play short: how many, and milliseconds heard in them."""
    cells = weekly_cells(sessions).filter("track_id IS NOT NULL AND skipped_plays > 0")
    return cells.select("track_id", "week", "skipped_plays", "skipped_ms")


def mean_ratio(plays: Column, skipped_plays: Column, skipped_ms: Column, duration_ms: Column) -> Column:
    """Mean heard share from the sums of play_skip_pairs; plays not cut short count 1."""
    whole = plays - F.coalesce(skipped_plays, F.lit(0))
    heard = F.try_divide(F.coalesce(skipped_ms, F.lit(0.0)), duration_ms.cast("double"))
    return F.when(heard.isNotNull(), F.try_divide(whole + heard, plays)).otherwise(
        F.when(whole > 0, F.lit(1.0))
    )
