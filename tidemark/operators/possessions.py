"""The grammar of possessions: a game's events to none, one or more possession rows each.

A possession ends with a made shot, the last free throw of a series, a defensive rebound of a shot
that missed, a turnover, a violation (of which goaltending counts as a made shot of two points),
or the end of a period while a missed shot is in the air. The machine runs over tables
(possession_rows) and in streams (stream.keyed), so both give the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .folds import Machine, unfolded

# The kinds of events, the distance below which a shot counts as from the paint, and
# gaps in seconds between possessions that count towards the pace.
KINDS = ("period", "jumpball", "2pt", "3pt", "freethrow", "rebound", "turnover", "violation", "substitution", "foul", "timeout")
PAINT, LONGEST_GAP = 8.0, 60.0
SERIES = re.compile(r"(\d+)\s+of\s+(\d+)", re.IGNORECASE)
#: What the machine takes of an event, in this order.
TAKES = ("event_id", "kind", "side", "sub", "made", "text", "distance", "area", "period", "clock")
ROW = "event_id long, possession long, period int, clock double, side string, team_scored string, points int, shot_value int, shot_distance double, shot_area string, had_foul boolean, had_shooting_foul boolean, had_personal_foul boolean, had_sub boolean"
FEATURES = "run_side string, run_length long, run_points long, run_threes long, run_paint long, home_5 long, away_5 long, pace double, fouls_home long, fouls_away long, subs_home long, subs_away long, timeouts_home long, timeouts_away long, since_timeout long"

_FLAGS = ("foul", "shooting", "personal", "sub")
_VALUES = "possessing string, missed string, missed_distance double, missed_area string, missed_value int, ft_made int, ft_side string, ft_clock double, ft_period int, n long, foul boolean, shooting boolean, personal boolean, sub boolean, run_side string, run_length long, run_points long, run_threes long, run_paint long, last_clock double, last_period int, pace_sum double, pace_n long, subs_home long, subs_away long, timeouts_home long, timeouts_away long, timeout_at long"


def _start(first: str) -> dict:
    zero = dict.fromkeys(("missed_value", "ft_made", "ft_period", "n", "run_length", "run_points", "run_threes", "run_paint", "pace_n", "subs_home", "subs_away", "timeouts_home", "timeouts_away"), 0)
    return zero | {"possessing": first, "missed": "", "missed_distance": 0.0, "missed_area": "", "ft_side": "", "ft_clock": 0.0, "run_side": "", "last_clock": 720.0, "last_period": 1, "pace_sum": 0.0, "timeout_at": None, "last": [], "fouls": {}} | dict.fromkeys(_FLAGS, False)


def _other(side: str) -> str:
    return "away" if side == "home" else "home"


def _features(s: dict, period: int) -> tuple:
    """What is known before a possession's row, which then advances the state."""
    points = lambda side: sum(p for at, p in s["last"] if at == side)
    return (
        s["run_side"], s["run_length"], s["run_points"], s["run_threes"], s["run_paint"], points("home"), points("away"), s["pace_sum"] / s["pace_n"] if s["pace_n"] else None,
        s["fouls"].get(f"home {period}", 0), s["fouls"].get(f"away {period}", 0), s["subs_home"], s["subs_away"], s["timeouts_home"], s["timeouts_away"],
        None if s["timeout_at"] is None else s["n"] - s["timeout_at"],
    )


def _advance(s: dict, period: int, clock: float, scored: str, points: int, value: int, distance: float) -> None:
    if points > 0:
        three, paint = value == 3, distance < PAINT and value != 3
        if scored != s["run_side"]:
            s["run_side"], s["run_length"], s["run_points"], s["run_threes"], s["run_paint"] = scored, 0, 0, 0, 0
        s["run_length"] += 1
        s["run_points"] += points
        s["run_threes"] += int(three)
        s["run_paint"] += points if paint else 0
    s["last"] = [*s["last"], (scored, points)][-5:]
    gap = s["last_clock"] - clock
    if period == s["last_period"] and 0 < gap < LONGEST_GAP:
        s["pace_sum"] += gap
        s["pace_n"] += 1
    s["last_clock"], s["last_period"] = clock, period
    s["n"] += 1
    s["subs_home"] = s["subs_away"] = 0
    s.update(dict.fromkeys(_FLAGS, False))


def grammar(first: str = "", features: bool = False) -> Machine:
    """Steps over rows of TAKES to ROW, with `features` to ROW and FEATURES before each row. first: the
    side that has the ball at the start. Events of unknown side are the possessing side's."""

    def step(s, row):
        event, kind, side, sub, made, text, distance, area, period, clock = row
        known = side or ""
        side, sub, text = known or s["possessing"], (sub or "").lower(), text or ""
        distance, area = 0.0 if distance is None or distance != distance else distance, area or ""
        period = s["last_period"] if period is None else period
        clock = 0.0 if clock is None or clock != clock else clock
        shot = (s["missed_value"], s["missed_distance"], s["missed_area"])

        def ends(scored: str, points: int, value: int, far: float, where: str, after: str | None, at: tuple | None = None) -> list[tuple]:
            p, c = at or (period, clock)
            out = (event, s["n"], p, c, s["possessing"], scored, points, value, far, where, *[s[f] for f in _FLAGS])
            if features:
                out += _features(s, p)
            _advance(s, p, c, scored, points, value, far)
            s["missed"] = ""
            if after is not None:
                s["possessing"] = after
            return [out]

        if kind == "period":
            said = f"{sub} {text.lower()}"
            if "end" in said and s["missed"]:
                return ends("", 0, *shot, None)
            if "end" not in said and "start" in said:
                s["missed"] = ""
        elif kind == "jumpball":
            s["possessing"] = known or s["possessing"]
        elif kind in ("2pt", "3pt"):
            value = 3 if kind == "3pt" else 2
            if made:
                return ends(side, value, value, distance, area, _other(side))
            s["missed"], s["missed_distance"], s["missed_area"], s["missed_value"] = side, distance, area, value
            s["possessing"] = side
        elif kind == "freethrow":
            found = SERIES.search(text)
            if "technical" in sub or "technical" in text.lower():
                k, of = 1, 1
            elif found:
                k, of = int(found[1]), int(found[2])
            else:
                return []
            if k == 1:
                s["ft_made"], s["ft_side"], s["ft_clock"], s["ft_period"] = 0, side, clock, period
            s["ft_made"] += bool(made)
            if k >= of:
                points = s["ft_made"]
                return ends(s["ft_side"] if points else "", points, 1, 0.0, "Free Throw", _other(s["ft_side"]), (s["ft_period"], s["ft_clock"]))
        elif kind == "rebound" and s["missed"]:
            if sub == "offensive" or (sub != "defensive" and known == s["missed"]):
                s["missed"] = ""
            else:
                return ends("", 0, *shot, known or _other(s["possessing"]))
        elif kind == "violation" and "goaltending" in sub:
            offense = s["missed"] or s["possessing"]
            return ends(offense, 2, 2, 0.0, "", _other(offense))
        elif kind in ("turnover", "violation"):
            return ends("", 0, 0, 0.0, "", _other(side))
        elif kind == "foul":
            s["foul"] = True
            if "shooting" in sub or "S.FOUL" in text.upper():
                s["shooting"] = True
            elif "personal" in sub or not sub:
                s["personal"] = True
            if known:
                s["fouls"][f"{known} {period}"] = s["fouls"].get(f"{known} {period}", 0) + 1
        elif kind == "substitution":
            s["sub"] = True
            if known:
                s[f"subs_{known}"] += 1
        elif kind == "timeout":
            s["timeout_at"] = s["n"]
            if known:
                s[f"timeouts_{known}"] += 1
        return []

    return Machine(step, lambda: _start(first), _VALUES, {"last": "side string, points int"}, {"fouls": ("side_period string", "n long")})


def possession_rows(events: DataFrame, by: list[str], order: list[str], first: str = "", features: bool = False) -> DataFrame:
    """by and ROW (and FEATURES) of every possession. events has the columns TAKES: kind is one of KINDS,
    side home, away or null (unknown), made whether a shot went in, text a description in which
    free throws say `1 of 2`. Nulls count as empty or 0; a game that ends without an event for it
    leaves its last possession open. A game is one sequence, which one task folds with its state alone."""
    return unfolded(events, by, order, list(TAKES), grammar(first, features), ROW + (", " + FEATURES if features else ""))
