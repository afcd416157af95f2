from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cadenza import functions as fn

ANCHOR = date(2020, 12, 28)


def test_week_borders_and_times_before_the_anchor(spark):
    times = ["2020-12-27T23:59:59", "2020-12-28T00:00:00", "2021-01-03T23:59:59", "2021-01-04T00:00:00", "2020-12-20T00:00:00"]
    df = spark.createDataFrame([(datetime.fromisoformat(t),) for t in times], "ts timestamp_ntz")
    weeks = [r[0] for r in df.select(fn.week_since_anchor("ts", ANCHOR)).collect()]
    assert weeks == [0, 1, 1, 2, -1]
    assert fn.week_number("2021-01-03") == 1 and fn.week_number("2021-01-04") == 2
    assert fn.week_start(2) == datetime(2021, 1, 4)


def test_sunday_week_is_percent_u(spark):
    days = [date(2021, m, d) for m in range(1, 13) for d in (1, 2, 3, 9, 28)] + [date(2022, 1, 1), date(2023, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(fn.sunday_week("d")).collect()]
    assert got == [int(d.strftime("%U")) for d in days]


def test_iso_week(spark):
    days = [date(2020, 12, 31), date(2021, 1, 1), date(2021, 1, 4), date(2024, 12, 30)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(fn.iso_week("d")).collect()] == [d.isocalendar().week for d in days]


def test_release_year_is_lenient(spark):
    texts = ["2020", "2020-05", "2020-05-06", "n/a", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fn.release_year("t")).collect()] == [2020, 2020, 2020, None, None, None]


def test_parse_timestamp_raises_on_bad_input(spark):
    good = spark.createDataFrame([("2021-01-04T10:00:00.5",)], "t string").select(fn.parse_timestamp("t"))
    assert good.first()[0] == datetime(2021, 1, 4, 10, 0, 0, 500000)
    with pytest.raises(Exception, match="CAST|PARSE"):
        spark.createDataFrame([("soon",)], "t string").select(fn.parse_timestamp("t")).collect()


def test_elapsed_ms_keeps_microseconds(spark):
    df = spark.createDataFrame([(datetime(2021, 1, 1), datetime(2021, 1, 1, 0, 0, 1, 500))], "a timestamp_ntz, b timestamp_ntz")
    assert rows(df.select(fn.elapsed_ms("a", "b"), F.lit(1))) == [(1000.5, 1)]
