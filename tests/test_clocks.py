"""Clocks give the same in sessions of three zones, at ends of days, years and daylight saving."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clocks

STAMPS = ["2026-07-01T12:00:00.5Z", "2026-01-01T00:30:00Z", "2025-12-31T23:59:59Z", "2026-03-08T06:59:59Z", "2026-03-08T07:00:00Z", "2026-11-01T05:30:00Z", "2026-11-01T06:30:00.999Z", "1969-12-31T23:00:00Z", "2026-03-08T02:30:00Z"]


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Tokyo"])
def session(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stamps_and_local_clocks(session):
    want = {}
    for s in STAMPS:
        t = datetime.strptime(s.split(".")[0].rstrip("Z"), "%Y-%m-%dT%H:%M:%S").replace(tzinfo=timezone.utc)
        local = t.astimezone(ZoneInfo("America/New_York"))
        month = datetime(t.year, t.month, 1, tzinfo=timezone.utc)
        us = lambda x: (x - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
        want[s] = (us(t), local.strftime("%Y-%m-%d %H:%M"), local.utcoffset().total_seconds() / 3600, bool(local.dst()), us(month))
    df = session.createDataFrame([(s,) for s in [*STAMPS, "not a stamp", "2026-07-01"]], "s string").withColumn("t", clocks.utc_stamp(F.col("s")))
    zone, t = "America/New_York", F.col("t")
    rows = df.select("s", F.unix_micros("t").alias("us"), clocks.local_time(t, zone).alias("local"), clocks.offset_hours(t, zone).alias("off"), clocks.daylight_saving(t, zone).alias("dst"), clocks.month_start(t).alias("month")).collect()
    assert {r.s: tuple(r)[1:] for r in rows if r.us is not None} == want
    assert [r.us for r in rows if r.s not in want] == [None, None]


def test_anchors_of_many_periods(session):
    rows = [("g", "2026-03-05", p, f"{(8 + p) % 12 + 1}:30 {'PM' if p < 3 else 'AM'}") for p in range(1, 15)] + [("g", "2026-03-05", 15, "no clock"), ("h", "2026-07-01", 1, "9:00 AM")]
    starts = session.createDataFrame(rows, "g string, day string, period int, clock string")
    found = {r.g: r for r in clocks.anchor_faults(clocks.local_anchors(starts, ["g"], "day", "period", "clock"), span_hours=40).withColumn("us", F.transform("anchors", lambda a: F.unix_micros(a["at"]))).collect()}
    assert len(found["g"].anchors) == 14 and found["h"].fault == "hour"  # no period is left out
    first = datetime(2026, 3, 5, 22, 30, tzinfo=ZoneInfo("America/New_York"))
    assert found["g"].us[0] == int(first.timestamp()) * 1_000_000 and found["g"].fault is None
    assert found["g"].us == sorted(found["g"].us)


def test_clocks_shown_twice_or_never(session):
    """As DuckDB's timezone: the second of two, and an hour further where an hour is left out."""
    duckdb = pytest.importorskip("duckdb")
    zones = {"America/New_York": ["2016-11-06 00:59:59", "2016-11-06 01:00:00", "2016-11-06 01:26:00", "2016-11-06 02:00:00", "2016-11-05 01:26:00", "2016-11-07 01:26:00", "2016-03-13 01:59:00", "2016-03-13 02:30:00", "2016-03-13 03:00:00", "2016-03-12 02:30:00"], "Australia/Lord_Howe": ["2024-04-07 01:29:00", "2024-04-07 01:45:00", "2024-04-07 02:00:00", "2024-10-06 02:15:00"], "Asia/Tokyo": ["2016-11-06 01:26:00"]}
    for zone, clock in zones.items():
        rows = session.createDataFrame([(c,) for c in clock], "c string").withColumn("local", F.to_timestamp(F.concat("c", F.lit("Z")), "yyyy-MM-dd HH:mm:ssX"))
        got = {r.c: r.us for r in rows.select("c", F.unix_micros(clocks.zone_time(F.col("local"), zone)).alias("us")).collect()}
        assert got == {c: duckdb.execute(f"select epoch_us(timezone('{zone}', timestamp '{c}'))").fetchone()[0] for c in clock}


def test_anchors_in_the_repeated_hour(session):
    starts = session.createDataFrame([("g", "2016-11-05", 1, "11:00 AM"), ("g", "2016-11-05", 2, "1:26 AM")], "g string, day string, period int, clock string")
    found = clocks.local_anchors(starts, ["g"], "day", "period", "clock").select(F.transform("anchors", lambda a: F.unix_micros(a["at"])).alias("us")).first()
    assert found.us[1] == 1478413560000000


def test_event_times_before_the_repeated_hour(session):
    """A period that ends at the second 1:26 AM lasts an hour longer."""
    starts = session.createDataFrame([("g", "2016-11-05", 1, "11:00 PM"), ("g", "2016-11-05", 2, "1:26 AM")], "g string, day string, period int, clock string")
    rows = session.createDataFrame([("g", 1, 360.0)], "g string, period int, clock double")
    at = clocks.event_times(rows, clocks.local_anchors(starts, ["g"], "day", "period", "clock"), ["g"], "period", "clock").select(F.unix_micros("at").alias("us")).first()
    assert at.us == (1478401200 + 1478413560) * 500_000
