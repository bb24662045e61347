"""Game-state features as Column functions, and the derived block that batch and streams share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import exprs as X


def run_sign(side: Column) -> Column:
    """1 for home, -1 for away, 0 for none."""
    return F.when(side == "home", 1.0).when(side == "away", -1.0).otherwise(0.0)


def run_efficiency(points: Column, length: Column) -> Column:
    """Points per row of the run."""
    return points.cast("double") / F.greatest(length.cast("double"), F.lit(1.0))


def run_fragility(three_share: Column, paint_share: Column) -> Column:
    return three_share.cast("double") - paint_share.cast("double")


def edge(home: Column, away: Column) -> Column:
    """Home minus away; flags count as 0 and 1."""
    return home.cast("double") - away.cast("double")


def swing_accel(home_5: Column, away_5: Column, home_10: Column, away_10: Column) -> Column:
    """The last five rows' swing minus that of the five before them."""
    recent = edge(home_5, away_5)
    return recent - (edge(home_10, away_10) - recent)


def trend_edge(home: Column, home_before: Column, away: Column, away_before: Column) -> Column:
    return edge(home, home_before) - edge(away, away_before)


def pace_reference(to_date: Column, expected: Column, elapsed: Column) -> Column:
    """This game's mean pace, shrunk to the expected one while few rows have gone by."""
    w = X.shrink_weight(F.greatest(elapsed.cast("double"), F.lit(0.0)))
    return w * to_date + (F.lit(1.0) - w) * expected


def pace_surprise(last: Column, to_date: Column, expected: Column, elapsed: Column) -> Column:
    return last - pace_reference(to_date, expected, elapsed)


def bounded(since: Column, cap: float = 30.0) -> Column:
    return F.least(since.cast("double"), F.lit(cap))


def none_yet(since: Column, sentinel: int = 999) -> Column:
    return (since >= sentinel).cast("double")


def remaining(used: Column, limit: float) -> Column:
    """What is left of a limit, from 0 to the limit."""
    return X.clip(F.lit(float(limit)) - used.cast("double"), 0.0, float(limit))


def state_flags(diff: Column, period: Column, clock: Column) -> dict[str, Column]:
    """Blowout, garbage time, close at the end, urgency and comeback of a score and clock."""
    left = X.minutes_left(period, clock, floor=1.0)
    blowout = F.abs(diff) > 20
    return {
        "is_blowout": blowout,
        "is_garbage_time": blowout & (period >= 4) & (clock < 360),
        "q4_close_game": (period == 4) & (F.abs(diff) <= 5),
        "trailing_team_urgency": F.abs(diff) / left,
        "comeback_probability_proxy": diff.cast("double") * diff / left,
    }


def derived_block(df: DataFrame, by: str = "game_id", order: tuple[str, ...] = ("possession_id",)) -> DataFrame:
    """df with the derived columns of a row's raw state. Needs expected_pace (the pregame prior).

    Missing counts are 0; a missing timeout counter means that none has been called. Rows elapsed
    and the shot-quality trend are windows over one shuffle by game."""
    if "expected_pace" not in df.columns:
        raise ValueError("expected_pace is needed: join the pregame rows first")
    pace = next((c for c in ("pace_game_to_date", "pace_season_baseline") if c in df.columns), None)
    if pace is None:
        raise ValueError("the mean pace within the game is needed")
    c = F.col
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    w = Window.partitionBy(by).orderBy(*order)
    elapsed = F.row_number().over(w) - 1
    left = X.minutes_left(c("period"), c("game_clock_secs"), floor=0.5)
    since = F.coalesce(c("possessions_since_last_timeout"), F.lit(999))
    trend = lambda side: F.coalesce(F.avg(f"{side}_xppp").over(w.rowsBetween(-5, -1)), F.lit(1.0)) - F.coalesce(F.avg(f"{side}_xppp").over(w.rowsBetween(-10, -6)), F.lit(1.0))
    sign = run_sign(c("current_run_team"))
    return df.withColumns({
        "lead_z": X.lead_z(c("score_diff"), left),
        "time_leverage": X.time_leverage(X.minutes_left(c("period"), c("game_clock_secs"))),
        "garbage_time_risk": X.decided_risk(c("score_diff"), X.minutes_left(c("period"), c("game_clock_secs"))),
        "current_run_team_encoded": sign,
        "run_signed_points": sign * c("current_run_points"),
        "run_efficiency": run_efficiency(c("current_run_points"), c("current_run_length")),
        "run_fragility": run_fragility(c("current_run_3pt_pct"), c("current_run_paint_pct")),
        "swing_5": edge(c("home_points_last_5_poss"), c("away_points_last_5_poss")),
        "swing_accel": swing_accel(*[c(f"{s}_points_last_{n}_poss") for n in (5, 10) for s in ("home", "away")]),
        "pace_ref": pace_reference(c(pace), c("expected_pace"), elapsed),
        "pace_surprise": pace_surprise(c("pace_last_10_possessions"), c(pace), c("expected_pace"), elapsed),
        "xppp_edge": edge(c("home_xPPP_last_5"), c("away_xPPP_last_5")),
        "luck_edge": edge(c("home_actual_vs_expected_PPP"), c("away_actual_vs_expected_PPP")),
        "quality_trend_edge": trend("home") - trend("away"),
        "team_foul_edge": edge(zero("home_team_fouls_q"), zero("away_team_fouls_q")),
        "home_fouls_until_bonus": remaining(zero("home_team_fouls_q"), 5),
        "away_fouls_until_bonus": remaining(zero("away_team_fouls_q"), 5),
        "star_trouble_edge": edge(c("home_trouble_star_tier") > 0, c("away_trouble_star_tier") > 0),
        "star_on_court_edge": edge(c("home_star_on_court"), c("away_star_on_court")),
        "sub_count_edge": edge(zero("home_sub_count"), zero("away_sub_count")),
        "poss_since_timeout": bounded(since),
        "no_timeout_yet": none_yet(since),
        "timeout_called_edge": edge(c("home_called_timeout_in_last_3_poss"), c("away_called_timeout_in_last_3_poss")),
        "timeouts_remaining_edge": edge(remaining(zero("home_timeouts_used"), 4), remaining(zero("away_timeouts_used"), 4)),
        "lineup_confidence": X.confidence(zero("home_lineup_sample_size"), zero("away_lineup_sample_size")),
        "lineup_changed_edge": edge(c("home_lineup_just_changed"), c("away_lineup_just_changed")),
        "lineup_changed_any": X.any_flag(c("home_lineup_just_changed"), c("away_lineup_just_changed")).cast("double"),
    })
