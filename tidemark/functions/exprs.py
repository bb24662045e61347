"""Scalar expressions: pure Column functions that stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """A timestamp as microseconds, for arithmetic and RANGE frames."""
    return F.unix_micros(ts.cast("timestamp"))


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def ladder(x: Column, bounds: list, labels: list[str]) -> Column:
    """labels[k] for the first bound with x <= bounds[k], the last label beyond."""
    out = F.when(x <= bounds[0], labels[0])
    for bound, label in zip(bounds[1:], labels[1:]):
        out = out.when(x <= bound, label)
    return out.otherwise(labels[-1])


def expected_points(value: Column, distance: Column, paint: float = 8.0, rates=((3, 1.08), (2, 1.26), (2, 0.84))) -> Column:
    """Expected points of a shot by value and distance: long, close, other; null if no shot."""
    (_, three), (_, close), (_, mid) = rates
    return F.when(value == 3, three).when((value == 2) & (distance < paint), close).when(value == 2, mid)


def minutes_elapsed(period: Column, clock_secs: Column, period_secs: float = 720.0) -> Column:
    """Minutes since the start, every period counted as a regular one."""
    return ((period - 1) * period_secs + (period_secs - F.least(clock_secs.cast("double"), F.lit(period_secs)))) / 60.0


def minutes_left(period: Column, clock_secs: Column, period_secs: float = 720.0, periods: int = 4, floor: float = 0.0) -> Column:
    """Minutes left: of an extra period its own clock alone, so it never runs below the floor for good."""
    return F.greatest(F.greatest(F.lit(periods) - period, F.lit(0)) * (period_secs / 60.0) + clock_secs / 60.0, F.lit(floor))


def match_minute(now: Column, kickoff: Column, half: float = 45.0, pause: float = 15.0) -> Column:
    """Minute of a match by the wall clock (timestamps): 0 before kickoff, frozen through the
    half-time pause, running on after it."""
    gone = (F.unix_micros(now) - F.unix_micros(kickoff)) / 60e6
    return F.when(gone <= 0, 0.0).when(gone <= half, gone).when(gone <= half + pause, half).otherwise(gone - pause)


def time_leverage(left: Column, total: float = 48.0) -> Column:
    return F.lit(1.0) - F.sqrt(clip(left / total, 0.0, 1.0))


def lead_z(diff: Column, left: Column, floor: float = 0.5) -> Column:
    return diff / F.sqrt(F.greatest(left, F.lit(floor)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -20.0, 20.0)))


def decided_risk(diff: Column, left: Column, centre: float = 15.0, scale: float = 5.0, total: float = 48.0) -> Column:
    return sigmoid((F.abs(diff) - centre) / scale) * (F.lit(1.0) - clip(left / total, 0.0, 1.0))


def signed(side: Column, amount: Column, plus: str = "home", minus: str = "away") -> Column:
    return F.when(side == plus, amount).when(side == minus, -amount).otherwise(F.lit(0))


def shrink_weight(n: Column, prior: float = 40.0, most: float = 0.85) -> Column:
    return F.least(n / (n + F.lit(prior)), F.lit(most))


def confidence(*counts: Column) -> Column:
    """log(1 + least count), at least 0."""
    return F.log1p(F.greatest(F.least(*counts) if len(counts) > 1 else counts[0], F.lit(0)).cast("double"))


def any_flag(*flags: Column) -> Column:
    return F.greatest(*[F.coalesce(f.cast("int"), F.lit(0)) for f in flags], F.lit(0)) if flags else F.lit(0)


def blend(n: Column, observed: Column, predicted: Column, prior: float = 50.0) -> Column:
    """Shrinkage: n / (n + prior) of what was observed, the rest predicted."""
    w = n / (n + F.lit(prior))
    return w * observed + (F.lit(1.0) - w) * predicted


def logit_delta(entry_cents: Column, cents: Column) -> Column:
    """Change in log-odds between two prices in cents, clipped to .01 and .99."""
    p, q = clip(entry_cents / 100.0, 0.01, 0.99), clip(cents / 100.0, 0.01, 0.99)
    return F.ln(q / (F.lit(1.0) - q)) - F.ln(p / (F.lit(1.0) - p))


def fee(rate: str, contracts: Column, cents: Column) -> Column:
    """ceil(rate * C * P * (1 - P) * 100) / 100 in exact decimals; doubles round some legs up."""
    p = cents.cast("decimal(5,0)")
    raw = F.lit(rate).cast("decimal(6,4)") * contracts.cast("decimal(9,0)") * p * (F.lit(100).cast("decimal(3,0)") - p)
    return (F.ceil(raw / F.lit(100).cast("decimal(3,0)")) / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)")


def position_size(strength: Column, anchor: float, slope: float, least: int, most: int) -> Column:
    return clip(((F.abs(strength) - anchor) * slope).cast("int"), least, most)


def clock_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 clock like PT11M40.00S; null if it isn't one."""
    m = F.regexp_extract(text, r"^PT(\d+)M([\d.]+)S$", 1)
    s = F.regexp_extract(text, r"^PT(\d+)M([\d.]+)S$", 2)
    return F.when(m != "", m.try_cast("double") * 60 + s.try_cast("double"))


def display_minutes(text: Column) -> Column:
    """90'+14' as 104; null unless it is such a clock."""
    base = F.regexp_extract(text, r"^(\d+)'(?:\+(\d+)')?$", 1)
    more = F.regexp_extract(text, r"^(\d+)'(?:\+(\d+)')?$", 2)
    return F.when(base != "", base.try_cast("double") + F.coalesce(F.when(more != "", more.try_cast("double")), F.lit(0.0)))


def set_id(ids: Column) -> Column:
    """Order-free id of an array of numbers: first 12 hex digits of md5 of the sorted, joined list."""
    return F.substring(F.md5(F.array_join(F.transform(F.array_sort(ids.cast("array<bigint>")), lambda x: x.cast("string")), ",")), 1, 12)


def parse_ticker(ticker: Column, pattern: str = r"^[A-Z]+-(\d{2}[A-Z]{3}\d{2})([A-Z]{3})([A-Z]{3})-([A-Z]{3})(\d+)$") -> Column:
    """struct(day, away, home, team, points); null fields if the ticker has another form."""
    part = lambda k: F.nullif(F.regexp_extract(ticker, pattern, k), F.lit(""))
    day = F.to_date(F.initcap(F.lower(F.regexp_replace(part(1), r"^(\d{2})([A-Z]{3})(\d{2})$", "$1-$2-$3"))), "yy-MMM-dd")
    return F.struct(day.alias("day"), part(2).alias("away"), part(3).alias("home"), part(4).alias("team"), part(5).cast("int").alias("points"))


def first_blocking(gates: list[tuple[str, Column]]) -> Column:
    """Name of the first gate that isn't passed (null counts as not passed); null if all are."""
    out = F.when(~F.coalesce(gates[0][1], F.lit(False)), gates[0][0])
    for name, passed in gates[1:]:
        out = out.when(~F.coalesce(passed, F.lit(False)), name)
    return out


def gate_columns(gates: list[tuple[str, Column]]) -> dict[str, Column]:
    """blocked (see first_blocking), and pass_<gate> of each: null where an earlier gate blocked."""
    out, reached = {"blocked": first_blocking(gates)}, F.lit(True)
    for name, passed in gates:
        fine = F.coalesce(passed, F.lit(False))
        out[f"pass_{name}"] = F.when(reached, fine)
        reached = reached & fine
    return out
