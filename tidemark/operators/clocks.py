"""Wall clocks: UTC stamps, local anchors of periods, their validation, and times between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: No function here asks for the session's time zone, so none gives another result in another one.
_DAY_US = 86_400_000_000


def utc_stamp(text: Column) -> Column:
    """An ISO stamp as a timestamp, without fraction and Z; null of other texts. Read as UTC."""
    plain = F.regexp_replace(F.regexp_replace(text, r"Z+$", ""), r"\..*$", "")
    return F.try_to_timestamp(F.concat(plain, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def utc_clock(ts: Column) -> Column:
    """What a clock in UTC shows at a timestamp, without a zone."""
    us = F.unix_micros(ts.cast("timestamp"))
    days, rest = F.floor(us / F.lit(_DAY_US).cast("decimal(20,0)")).cast("int"), F.pmod(us, F.lit(_DAY_US))
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(days, F.lit(0), F.lit(0), (rest.cast("decimal(20,0)") / 1000000).cast("decimal(18,6)"))


def local_clock(ts: Column, zone: str) -> Column:
    """What a zone's clock shows at a UTC timestamp; the zone's rules know of daylight saving."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_clock(ts))


def local_time(ts: Column, zone: str) -> Column:
    """The zone's clock as text, to the minute: 2026-07-01 08:00."""
    return F.substring(local_clock(ts, zone).cast("string"), 1, 16)


def zone_time(local: Column, zone: str) -> Column:
    """The UTC timestamp at which a zone's clock shows `local` (a timestamp whose UTC fields are the clock's).
    A clock that is shown twice, as when daylight saving ends, is the later of the two; one that is
    left out goes on by what was left out. Expects no two changes of the zone within a day."""
    let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  works x out once
    shown = lambda at: F.from_utc_timestamp(at, zone)
    later = lambda first, us: F.timestamp_micros(F.unix_micros(first) + us)
    # how far the zone's clock is set back within a day: by as much the second of two is later
    back = lambda clock, first: F.unix_micros(clock) - F.unix_micros(shown(later(first, _DAY_US))) + _DAY_US
    read = lambda clock, first, us: F.when((us > 0) & (shown(later(first, us)) == clock), later(first, us)).otherwise(first)
    return let(local, lambda clock: let(F.to_utc_timestamp(clock, zone), lambda first: let(back(clock, first), lambda us: read(clock, first, us))))


def _seconds(clock: Column) -> Column:
    """Whole seconds since 1970 that a clock without a zone shows."""
    return F.unix_date(clock.cast("date")).cast("long") * 86400 + F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)


def offset_hours(ts: Column, zone: str) -> Column:
    """Hours between a zone's clock and UTC at that time."""
    return (_seconds(local_clock(ts, zone)) - _seconds(utc_clock(ts))) / 3600


def daylight_saving(ts: Column, zone: str) -> Column:
    """Whether the zone's clock is ahead of its least offset in that year (January and July)."""
    of = lambda month: offset_hours(F.timestamp_seconds(F.unix_date(F.make_date(F.year(utc_clock(ts)), F.lit(month), F.lit(1))).cast("long") * 86400 + 43200), zone)
    return offset_hours(ts, zone) > F.least(of(1), of(7))


def month_start(ts: Column) -> Column:
    """Microseconds since 1970 at which the UTC month of a timestamp began."""
    return F.unix_date(F.trunc(utc_clock(ts).cast("date"), "month")).cast("long") * _DAY_US


def local_anchors(starts: DataFrame, by: list[str], day: str, period: str, clock: str, zone: str = "America/New_York") -> DataFrame:
    """by, day, anchors: array of struct(period, at), the UTC times of period starts given as a local clock
    like "10:13 PM". The first is on `day`; a later one is on the date of the one before, or on the
    next if it wouldn't be after it. Texts that are no clock are left out; of an hour that the zone
    shows twice the second counts (zone_time). A group's array has a row for each of its periods, and
    its fold runs in the JVM."""
    minutes = F.expr(f"try_to_timestamp(trim({clock}), 'h:mm a')")
    secs = F.hour(minutes) * 3600 + F.minute(minutes) * 60
    rows = starts.where(F.col(period).isNotNull() & minutes.isNotNull()).select(*by, F.col(day).cast("date").alias("day"), F.col(period).cast("int").alias("period"), secs.alias("secs"))
    rows = rows.groupBy(*by, "day", "period").agg(F.min("secs").alias("secs"))
    folded = rows.groupBy(*by, "day").agg(F.array_sort(F.collect_list(F.struct("period", "secs"))).alias("_p"))
    # (days since the first, seconds): a start that isn't later than the last is a day further
    start = F.struct(F.lit(0).alias("shift"), F.lit(-1).alias("last"), F.array().cast("array<struct<period:int,shift:int,secs:int>>").alias("out"))

    def step(at: Column, p: Column) -> Column:
        shift = at["shift"] + (p["secs"] <= at["last"]).cast("int")
        return F.struct(shift.alias("shift"), p["secs"].alias("last"), F.concat(at["out"], F.array(F.struct(p["period"].alias("period"), shift.alias("shift"), p["secs"].alias("secs")))).alias("out"))

    folded = folded.withColumn("_f", F.aggregate("_p", start, step)["out"])
    local = lambda x: F.timestamp_seconds(F.unix_date(F.date_add("day", x["shift"])) * 86400 + x["secs"])
    return folded.select(*by, "day", F.transform("_f", lambda x: F.struct(x["period"].alias("period"), zone_time(local(x), zone).alias("at"))).alias("anchors"))


def anchor_faults(anchors: DataFrame, zone: str = "America/New_York", hours: tuple[int, int] = (12, 23), span_hours: float = 6.0) -> DataFrame:
    """anchors with fault: the first check that a group's anchors fail (null: none): the first start is
    on another local date, at an unlikely hour, starts don't advance, or span too long."""
    first, last = F.element_at("anchors", 1)["at"], F.element_at("anchors", -1)["at"]
    local = local_clock(first, zone)
    back = F.exists(F.sequence(F.lit(1), F.size("anchors") - 1), lambda k: F.element_at("anchors", k + 1)["at"] <= F.element_at("anchors", k)["at"])
    back = F.when(F.size("anchors") > 1, back).otherwise(False)
    span = (F.unix_micros(last) - F.unix_micros(first)) / 3.6e9
    fault = F.when(local.cast("date") != F.col("day"), "date").when(~F.hour(local).between(*hours), "hour").when(back, "order").when(span > span_hours, "span")
    return anchors.withColumn("fault", fault)


def event_times(events: DataFrame, anchors: DataFrame, by: list[str], period: str, clock: str, fallback: float = 2.2, periods: int = 4, secs: float = 720.0, extra_secs: float = 300.0) -> DataFrame:
    """events with at: the time on the line between its period's start and the next. Where there is
    no next start, a period lasts the mean ratio of real to played time of the group's others
    (fallback without any) times its length. Null where the period has no start."""
    length = lambda p: F.when(p <= periods, secs).otherwise(extra_secs)
    us = lambda x: F.unix_micros(x["at"])
    a = F.col("anchors")
    steps = F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda k: (us(F.element_at(a, k + 1)) - us(F.element_at(a, k))) / 1e6 / length(F.element_at(a, k)["period"]))).otherwise(F.array().cast("array<double>"))
    good = F.filter(steps, lambda r: r > 0)
    ratio = F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, r: s + r) / F.size(good)).otherwise(F.lit(fallback))
    per = anchors.select(*by, F.col("anchors").alias("_a"), ratio.alias("_ratio"))
    rows = events.join(per, by, "left").withColumn("_s", F.try_element_at(F.filter("_a", lambda x: x["period"] == F.col(period)), F.lit(1))["at"]).withColumn("_e", F.try_element_at(F.filter("_a", lambda x: x["period"] == F.col(period) + 1), F.lit(1))["at"])
    real = F.coalesce((F.unix_micros("_e") - F.unix_micros("_s")) / 1e6, F.col("_ratio") * length(F.col(period)))
    share = F.least(F.greatest((length(F.col(period)) - F.col(clock)) / length(F.col(period)), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("at", F.timestamp_micros(F.unix_micros("_s") + F.bround(share * real * 1e6).cast("long"))).drop("_a", "_ratio", "_s", "_e")
