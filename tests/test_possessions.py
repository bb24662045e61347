"""The grammar of possessions by hand, and its features against plain recounting."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import possessions


def played(events, first="", features=False):
    """Rows of one game. An event: kind, side, then whatever else it says."""
    m = possessions.grammar(first, features)
    state, out = m.start(), []
    for n, (kind, side, *more) in enumerate(events):
        said = {"sub": None, "made": None, "text": None, "distance": 10.0, "area": "x", "period": 1, "clock": 700.0 - n} | (more[0] if more else {})
        out += m.step(state, (n, kind, side, *(said[k] for k in possessions.TAKES[3:])))
    return out


def short(rows):
    """(event, side that had the ball, who scored, points, value)."""
    return [(r[0], r[4], r[5], r[6], r[7]) for r in rows]


MADE, MISS = {"made": True}, {"made": False}
ft = lambda k, n, made, **more: {"text": f"Free Throw {k} of {n}", "made": made} | more


def test_shots_rebounds_and_turnovers():
    rows = played([("jumpball", "away"), ("2pt", "away", MISS), ("rebound", "away", {"sub": "offensive"}), ("3pt", "away", MADE), ("2pt", "home", MISS), ("rebound", "away", {"sub": "defensive"}), ("turnover", "away"), ("rebound", "home", {"sub": "defensive"})])
    assert short(rows) == [(3, "away", "away", 3, 3), (5, "home", "", 0, 2), (6, "away", "", 0, 0)]
    assert [r[1] for r in rows] == [0, 1, 2]


def test_a_rebound_without_a_kind_goes_by_side():
    assert short(played([("2pt", "home", MISS), ("rebound", "home"), ("2pt", "home", MISS), ("rebound", "away")])) == [(3, "home", "", 0, 2)]


def test_free_throw_series_end_with_the_last_and_keep_the_first_clock():
    rows = played([("freethrow", "home", ft(1, 3, True, clock=50.0)), ("freethrow", "home", ft(2, 3, False, clock=49.0)), ("freethrow", "home", ft(3, 3, True, clock=48.0)), ("2pt", None, MADE)])
    assert short(rows) == [(2, "", "home", 2, 1), (3, "away", "away", 2, 2)] and rows[0][3] == 50.0 and rows[0][9] == "Free Throw"
    assert short(played([("freethrow", "away", ft(1, 2, False)), ("freethrow", "away", ft(2, 2, False))])) == [(1, "", "", 0, 1)]
    assert short(played([("freethrow", "away", {"text": "T.FREE THROW technical", "made": True})])) == [(0, "", "away", 1, 1)]
    assert played([("freethrow", "away", {"text": "no numbers", "made": True})]) == []


def test_violations():
    kicked = played([("jumpball", "home"), ("violation", "home", {"sub": "kicked ball"}), ("2pt", None, MADE)])
    assert short(kicked) == [(1, "home", "", 0, 0), (2, "away", "away", 2, 2)]
    goaltending = played([("2pt", "home", MISS), ("violation", "away", {"sub": "Defensive Goaltending"}), ("2pt", None, MADE)])
    assert short(goaltending) == [(1, "home", "home", 2, 2), (2, "away", "away", 2, 2)]
    assert short(played([("jumpball", "away"), ("violation", None, {"sub": "goaltending"})])) == [(1, "away", "away", 2, 2)]


def test_period_ends_flush_a_shot_in_the_air():
    rows = played([("period", None, {"sub": "start"}), ("3pt", "home", MISS | {"distance": 26.0}), ("period", None, {"sub": "end"}), ("period", None, {"text": "End of 1st Period"})])
    assert short(rows) == [(2, "home", "", 0, 3)] and rows[0][8] == 26.0
    assert played([("3pt", "home", MISS), ("period", None, {"sub": "start"}), ("period", None, {"sub": "end"})]) == []


def test_flags_hold_within_a_possession():
    rows = played([("foul", "home"), ("foul", "home", {"text": "S.FOUL (P1)"}), ("2pt", "home", MADE), ("substitution", "away"), ("2pt", "away", MADE), ("2pt", "home", MADE)])
    assert [r[10:14] for r in rows] == [(True, True, True, False), (False, False, False, True), (False,) * 4]


def test_features_are_recounted():
    rng = random.Random(4)
    events = []
    for n in range(3000):
        kind = rng.choice(["2pt", "3pt", "rebound", "turnover", "freethrow", "foul", "substitution", "timeout", "violation"])
        k = rng.randrange(1, 3)
        more = ft(k, 2, rng.random() < 0.7) if kind == "freethrow" else {"made": rng.random() < 0.5, "distance": float(rng.randrange(30))}
        events.append((kind, rng.choice(["home", "away"]), more | {"period": 1 + n // 800, "clock": 720.0 - n % 800 * 0.9}))
    rows = played(events, features=True)
    assert len(rows) > 500
    names = [x.split()[0] for x in (possessions.ROW + ", " + possessions.FEATURES).split(", ")]
    rows = [dict(zip(names, r)) for r in rows]
    run, last, gaps, before = ["", 0, 0, 0, 0], [], [], (720.0, 1)
    for k, r in enumerate(rows):
        seen = [(e, *x) for e, x in enumerate(events) if e < r["event_id"]]
        own = [x for x in seen if k == 0 or x[0] > rows[k - 1]["event_id"]]
        assert [r["run_side"], r["run_length"], r["run_points"], r["run_threes"], r["run_paint"]] == run
        assert [r["home_5"], r["away_5"]] == [sum(p for s, p in last[-5:] if s == side) for side in ("home", "away")]
        assert r["pace"] == (pytest.approx(sum(gaps) / len(gaps)) if gaps else None)
        for side in ("home", "away"):
            assert r[f"fouls_{side}"] == sum(x[1] == "foul" and x[2] == side and x[3]["period"] == r["period"] for x in seen)
            assert r[f"subs_{side}"] == sum(x[1] == "substitution" and x[2] == side for x in own)
            assert r[f"timeouts_{side}"] == sum(x[1] == "timeout" and x[2] == side for x in seen)
        out = [x[0] for x in seen if x[1] == "timeout"]
        assert r["since_timeout"] == (sum(q["event_id"] > out[-1] for q in rows[:k]) if out else None)
        if r["points"]:
            run = run if run[0] == r["team_scored"] else [r["team_scored"], 0, 0, 0, 0]
            three, paint = r["shot_value"] == 3, r["shot_distance"] < 8 and r["shot_value"] != 3
            run = [run[0], run[1] + 1, run[2] + r["points"], run[3] + three, run[4] + r["points"] * paint]
        last.append((r["team_scored"], r["points"]))
        if r["period"] == before[1] and 0 < before[0] - r["clock"] < 60:
            gaps.append(before[0] - r["clock"])
        before = (r["clock"], r["period"])


def test_over_a_table_with_nulls_and_no_rows(spark):
    kinds = "game long, us long, event_id long, kind string, side string, sub string, made boolean, text string, distance double, area string, period int, clock double, _t0 int"
    rows = [(1, 1, 1, "2pt", None, None, True, None, None, None, None, None, 0), (None, 2, 2, "turnover", "home", None, None, None, None, None, 1, 3.0, 0), (1, None, 3, None, None, None, None, None, None, None, None, None, 0), (None, 1, 1, "jumpball", "home", None, None, None, None, None, 1, 5.0, 0)]
    df = spark.createDataFrame(rows, kinds)
    got = sorted(((r.game, r.event_id, r.side, r.team_scored, r.points) for r in possessions.possession_rows(df, ["game"], ["us"], features=True).collect()), key=str)
    assert got == [(1, 1, "", "", 2), (None, 2, "home", "", 0)]
    assert possessions.possession_rows(df.where(F.lit(False)), ["game"], ["us"]).count() == 0
