import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from conftest import rows

from cadenza.operators.panel import mean_playtime, with_week
from cadenza.operators.sequence import next_event, play_skip_pairs, playtime_ratio

ANCHOR = date(2021, 1, 4)


@pytest.fixture
def tracks(spark):
    data = [("a", 1000), ("b", 0), ("c", None), ("d", 2000)]
    return spark.createDataFrame(data, "track_id string, duration_ms long")


def ratios(log, tracks):
    return {r["event_id"]: r["playtime_ratio"] for r in playtime_ratio(with_week(log, ANCHOR), tracks).collect()}


def test_skip_likes_and_unknown_types(make_log, tracks):
    log = make_log([
        ("2021-01-04T10:00:00.0", 1, "a", "play"),
        ("2021-01-04T10:00:00.1", 1, "a", "like"),     # not part of the sequence
        ("2021-01-04T10:00:00.25", 1, "a", "skip"),
        ("2021-01-04T11:00:00.0", 1, "a", "play"),
        ("2021-01-04T11:00:01.0", 1, "a", None),       # kept: breaks the pair
        ("2021-01-04T11:00:02.0", 1, "a", "skip"),
        ("2021-01-04T12:00:00.0", 1, "a", "play"),
        ("2021-01-04T12:00:03.0", 1, "a", "skip"),     # longer than the track: not clamped
        ("2021-01-04T12:00:00.0", 1, "x", "play"),     # not in the catalogue
    ])
    assert ratios(log, tracks) == {0: 0.25, 3: 1.0, 6: 3.0}


def test_week_edge_is_not_crossed_but_hours_and_days_are(make_log, tracks):
    log = make_log([
        ("2021-01-10T23:59:59", 1, "d", "play"), ("2021-01-11T00:00:00", 1, "d", "skip"),
        ("2021-01-12T09:59:59", 1, "d", "play"), ("2021-01-12T10:00:00", 1, "d", "skip"),
        ("2021-01-12T23:59:59", 2, "d", "play"), ("2021-01-13T00:00:01", 2, "d", "skip"),
    ])
    assert ratios(log, tracks) == {0: 1.0, 2: 0.5, 4: 1.0}
    pairs = rows(play_skip_pairs(with_week(log, ANCHOR)))
    assert pairs == [("d", 2, 2, 3000.0)]


def test_unusable_duration_has_no_ratio(make_log, tracks):
    log = make_log([
        ("2021-01-04T10:00:00", 1, "b", "play"), ("2021-01-04T10:00:01", 1, "b", "skip"),
        ("2021-01-04T10:00:02", 1, "b", "play"),
        ("2021-01-04T10:00:00", 1, "c", "play"), ("2021-01-04T10:00:01", 1, "c", "skip"),
    ])
    assert ratios(log, tracks) == {0: None, 2: 1.0, 3: None}
    means = rows(mean_playtime(with_week(log, ANCHOR), tracks), "track_id")
    assert means == [("b", 1, 1.0), ("c", 1, None)]


def test_rows_without_user_have_no_next_event(make_log, tracks):
    log = make_log([
        ("2021-01-04T10:00:00", None, "a", "play"), ("2021-01-04T10:00:01", None, "a", "skip"),
        ("2021-01-04T10:00:00", 3, None, "advertisement"),
    ])
    got = next_event(with_week(log, ANCHOR))
    assert sorted(r["event_id"] for r in got.collect()) == [0, 1, 2]
    assert {r["next_event_type"] for r in got.collect()} == {None}
    assert ratios(log, tracks) == {0: 1.0}


def test_ties_follow_event_id_and_else_event_type(make_log, tracks):
    log = make_log([("2021-01-04T10:00:00", 1, "a", "skip"), ("2021-01-04T10:00:00", 1, "a", "play")])
    assert ratios(log, tracks) == {1: 1.0}
    assert [r["playtime_ratio"] for r in playtime_ratio(with_week(log.drop("event_id"), ANCHOR), tracks).collect()] == [0.0]


def test_hot_group_and_random_log_match_a_plain_loop(make_log, tracks):
    """A third of the rows are one user on one track in one week."""
    rng = random.Random(7)
    start = datetime(2021, 1, 4)
    events = []
    for i in range(900):
        user, track = (1, "a") if i % 3 == 0 else (rng.randint(1, 4), rng.choice(["a", "b", "d", None]))
        minute = rng.randint(0, 7 * 1440 - 1) if i % 3 == 0 else rng.randint(0, 21 * 1440)
        events.append((start + timedelta(minutes=minute), user, track, rng.choice(["play", "play", "skip", "like", None])))
    log = with_week(make_log(events), ANCHOR)

    groups = defaultdict(list)
    for i, (t, user, track, kind) in enumerate(events):
        if kind != "like" and track is not None:
            groups[((t - start).days // 7 + 1, track, user)].append((t, i, kind))
    follow, cells = {}, defaultdict(list)
    durations = {"a": 1000, "b": 0, "d": 2000}
    for (week, track, _), members in groups.items():
        members.sort(key=lambda m: m[:2])
        for here, after in zip(members, members[1:] + [(None, None, None)]):
            follow[here[1]] = (after[0], after[2])
            if here[2] == "play":
                if after[2] != "skip":
                    cells[(track, week)].append(1.0)
                elif durations[track]:
                    cells[(track, week)].append((after[0] - here[0]).total_seconds() * 1000 / durations[track])

    got = {r["event_id"]: (r["next_timestamp"], r["next_event_type"]) for r in next_event(log).collect() if r["track_id"]}
    assert got == follow
    means = {(r[0], r[1]): r[2] for r in mean_playtime(log, tracks).collect() if r[2] is not None}
    assert means.keys() == {k for k, values in cells.items() if values}
    for key, value in means.items():
        assert value == pytest.approx(sum(cells[key]) / len(cells[key]), rel=1e-12)


def test_repeated_track_ids_do_not_multiply_plays(spark, make_log):
    log = make_log([("2021-01-05T10:00:00", 1, "a", "play"), ("2021-01-05T10:00:01", 1, "a", "skip")])
    log = with_week(log, ANCHOR)
    twice = spark.createDataFrame([("a", None, "z"), ("a", 4000, "y"), ("a", 2000, "z"), (None, 1, "x")], "track_id string, duration_ms long, name string")
    ratios = [r["playtime_ratio"] for r in playtime_ratio(log, twice).collect()]
    assert ratios == [0.5] == [r["playtime_ratio"] for r in mean_playtime(log, twice).collect()]
