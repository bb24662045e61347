"""Streams drained to a table, and event parsing as sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import clocks, feed, possessions, ratings, sequences
from ..streaming import machines, stream
from .q_joins import HOUR, events
from .registry import query

#: Microseconds that rows may come late. Slices follow one another in time, so that most rows step
#: through before the last batch and state is carried from batch to batch.
LATE = 24 * HOUR


def _stream(t, closing=None):
    """The event log as a stream of four batches in order of time."""
    return stream.sliced_stream(t.events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts")), "us", closing=closing)


def _keyed(t, machine, columns, out, more=None, shape=lambda rows: rows):
    """What a machine per user gives for the event log; the closing row lets the last day's rows go."""
    rows = shape(_stream(t, LATE + HOUR)).withColumns(more or {})
    return stream.drained(stream.keyed(rows, "user_id", machine, columns, ["us", "event_id"], out, LATE))


@query("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL""")
def st09_tumbling(t):
    out = stream.drained(stream.windowed(_stream(t), ["event_type"], "ts", "value", "1 day", late="60 days"), "complete")
    return out.withColumn("total", F.round("total", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT min(event_id) AS event_id, user_id FROM events WHERE value > 0 GROUP BY user_id, ts")
def st01_ingest(t):
    rows = _stream(t).select("event_id", "user_id", "ts", "value")
    return stream.drained(stream.ingest(rows, "user_id", "ts", "value", "60 days")).select("event_id", "user_id")


_SNAP = """SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n, round(sum(value) OVER w, 6) AS total, round(value - first_value(value) OVER w, 6) AS velocity FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)"""


@query(_SNAP)
def st02_rolling(t):
    """Features of the last six hours of each user's ticks, by keyed state."""
    out = _keyed(t, machines.rolling_snapshot(6 * HOUR), ["event_id", "us", "value"], "event_id long, n long, total double, velocity double")
    return out.select("event_id", "n", F.round("total", 6).alias("total"), F.round("velocity", 6).alias("velocity"))


_FEATURES = ("bid", "ask", "spread", "last", "interest", "volume", "ms_since_trade", "interest_change", "d_bid", "d_spread", "velocity", "acceleration", "off_last")


@query()
def st02_st03_snapshot(t):
    """Views ask for the market's 13 features and whether it has data; all other events are its ticks."""
    more = {"asks": F.col("event_type") == "view", "bid": F.floor("value"), "ask": F.floor("value") + F.col("event_id") % 4, "last": F.floor("value") + 1, "volume": F.floor(F.col("event_id") / 3), "interest": F.col("event_id") % 100}
    takes = ["event_id", "us", "asks", "bid", "ask", "last", "volume", "interest"]
    return _keyed(t, machines.market_snapshot(48 * HOUR, 24 * HOUR, 12 * HOUR, 24 * HOUR), takes, "event_id long, has_data boolean, " + ", ".join(f"{f} double" for f in _FEATURES), more)


_RUN = f"""WITH e AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS side, CASE WHEN event_type IN ('purchase', 'signup') THEN round(value) ELSE 0 END AS points FROM events),
s AS (SELECT *, CASE WHEN points > 0 THEN side END AS sc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM e),
p AS (SELECT *, last_value(sc IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM s),
i AS (SELECT *, sum(CASE WHEN sc IS NOT NULL AND (prior IS NULL OR prior <> sc) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM p),
c AS (SELECT *, count(sc) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS len, sum(CASE WHEN sc IS NOT NULL THEN points END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS pts FROM i)
SELECT event_id, coalesce(prior, '') AS run_side, CAST(coalesce(last_value(CASE WHEN sc IS NOT NULL THEN len END IGNORE NULLS) OVER b, 0) AS BIGINT) AS run_length, CAST(coalesce(last_value(CASE WHEN sc IS NOT NULL THEN pts END IGNORE NULLS) OVER b, 0) AS DOUBLE) AS run_points,
CAST(coalesce(sum(CASE WHEN side = 'home' THEN points ELSE 0 END) OVER f, 0) AS DOUBLE) AS home_5, CAST(coalesce(sum(CASE WHEN side = 'away' THEN points ELSE 0 END) OVER f, 0) AS DOUBLE) AS away_5, pos - 1 AS elapsed,
coalesce(pos - max(CASE WHEN event_type = 'error' THEN pos END) OVER b, 999) AS since_timeout FROM c
WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""


@query(_RUN)
def st04_possession_state(t):
    """The state before each row by a stream's keyed state: run, points of the last five, rows elapsed, rows since an error."""
    more = {"side": F.when(F.col("event_id") % 2 == 0, "home").otherwise("away"), "points": F.when(F.col("event_type").isin("purchase", "signup"), F.round("value")).otherwise(0.0)}
    return _keyed(t, machines.possession_state("error"), ["event_id", "side", "points", "event_type"], "event_id long, run_side string, run_length long, run_points double, home_5 double, away_5 double, elapsed long, since_timeout long", more)


@query()
def st05_l18_break_fade(t):
    """Enter, exit or wait at each tick; hours since the start of the month play the match's minutes."""
    more = {"minute": (F.col("us") - clocks.month_start(F.col("ts"))) / float(HOUR)}
    out = _keyed(t, machines.break_fade((48.0, 240.0, 480.0), 72.0, 96.0, 10.0, 48.0), ["event_id", "minute", "value"], "event_id long, action string, side string, drift double", more)
    return out.withColumn("drift", F.round("drift", 6))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, event_type, value, CASE WHEN value > 90 THEN 'signup' ELSE 'view' END AS best, event_id % 3 = 0 AS open, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, event_type AS market, 'start' AS decision FROM r WHERE n = 1 UNION ALL
SELECT d.user_id, d.event_id, d.n, CASE WHEN d.decision = 'swap' THEN d.best ELSE d.market END, d.decision FROM (SELECT r.*, f.market, CASE WHEN r.event_type <> f.market OR r.value BETWEEN 20 AND 80 THEN 'stay' WHEN r.best = f.market THEN 'best_is_current' WHEN r.open THEN 'swap_deferred_open' ELSE 'swap' END AS decision
FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1) d) SELECT event_id, decision, market FROM f""")
def st08_swap(t):
    more = {"best": F.when(F.col("value") > 90, F.lit("signup")).otherwise(F.lit("view")), "open": F.col("event_id") % 3 == 0}
    return _keyed(t, machines.swap_with_hysteresis(), ["event_id", "event_type", "value", "best", "open"], "event_id long, decision string, market string", more)


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def st10_telemetry(t):
    agg = _stream(t).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean"))
    return stream.drained(agg, "update", ["user_id"]).withColumn("mean", F.round("mean", 6))


@query("SELECT event_id, n_name FROM events LEFT JOIN nation ON user_id % 25 = n_nationkey WHERE event_type = 'signup'")
def st07_enriched(t):
    rows = _stream(t).where("event_type = 'signup'").withColumn("n_nationkey", F.col("user_id") % 25).select("event_id", "n_nationkey")
    return stream.drained(stream.enriched(rows, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])).select("event_id", "n_name")


@query("""WITH l AS (SELECT user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM l)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, no""")
def st09_sessions(t):
    """Sessions of each user's events, six hours apart, given once their end has passed."""
    rows = _stream(t, LATE + 8 * HOUR).withColumn("at", F.timestamp_micros("us"))
    out = stream.drained(stream.sessions(rows, ["user_id"], "at", "value", "6 hours", "1 day"))
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n", F.round("total", 6).alias("total"))


@query("""SELECT s.event_id, p.value AS price, epoch_us(p.ts) AS since FROM (SELECT * FROM events WHERE event_type = 'signup') s ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON s.user_id = p.user_id AND s.ts >= p.ts""")
def st07_versions(t):
    """Signups of the stream with the price that the user's last purchase had set by then."""
    kinds = events(t)
    versions = kinds.where("event_type = 'purchase'").select("user_id", F.col("us").alias("since"), F.col("value").alias("price"))
    rows = _stream(t).where("event_type = 'signup'").select("event_id", "user_id", "us")
    return stream.drained(stream.enriched_as_of(rows, versions, "user_id", "us", "since", ["price", "since"])).select("event_id", "price", "since")


_KINDS = ("view", "click", "error", "purchase", "signup")
_LAST = ", ".join(f"last_value(CASE WHEN event_type = '{k}' THEN value END IGNORE NULLS) OVER w AS {k}" for k in _KINDS)


@query(f"""WITH l AS (SELECT event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS gone, {_LAST} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, coalesce(gone >= {48 * HOUR} AND {" AND ".join(f"({k} <= 40 OR {k} >= 60)" for k in _KINDS)}, false) AS settled FROM l""")
def st06_settled(t):
    """Whether all of a user's markets have settled, after each tick and two days at least."""
    return _keyed(t, machines.settlement(40.0, 60.0, 48 * HOUR, len(_KINDS)), ["event_id", "us", "event_type", "value"], "event_id long, settled boolean")


_ACTIONS = """WITH a AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'made' WHEN 'click' THEN 'miss' WHEN 'view' THEN 'rebound' WHEN 'error' THEN 'turnover' ELSE 'foul' END AS kind, event_id % 2 AS side, value FROM events),
e AS (SELECT *, kind IN ('made', 'turnover') OR (kind = 'rebound' AND coalesce(lag(kind) OVER w = 'miss' AND lag(side) OVER w <> side, false)) AS fin FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, coalesce(sum(CAST(fin AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pid FROM e)"""


def _actions(t):
    kind = F.expr("case event_type when 'purchase' then 'made' when 'click' then 'miss' when 'view' then 'rebound' when 'error' then 'turnover' else 'foul' end")
    return events(t).select("user_id", "us", "event_id", kind.alias("kind"), (F.col("event_id") % 2).alias("side"), F.when(kind == "made", F.col("value")).otherwise(0.0).alias("points"))


@query(_ACTIONS + " SELECT user_id, CAST(pid AS BIGINT) AS possession, count(*) AS actions, arg_max(kind, (ts, event_id)) AS outcome, round(sum(CASE WHEN kind = 'made' THEN value ELSE 0 END), 6) AS points FROM p GROUP BY user_id, pid")
def e01_possessions(t):
    out = sequences.possessions(_actions(t), ["user_id"], ["us", "event_id"])
    return out.select("user_id", "possession", "actions", "outcome", F.round("points", 6).alias("points"))


#: Users play games: the kind of an event goes by its number, its side and outcome too.
_GAME_KINDS = ("2pt", "3pt", "rebound", "2pt", "freethrow", "freethrow", "rebound", "turnover", "violation", "period", "jumpball", "foul", "substitution")


def _game(rows):
    n, v = F.col("event_id"), F.floor("value")
    kind = F.element_at(F.array(*[F.lit(k) for k in _GAME_KINDS]), (n % 13 + 1).cast("int"))
    rows = rows.withColumns({"kind": kind, "side": F.when(F.floor(n / 13) % 2 == 0, "home").otherwise("away"), "made": v % 2 == 0, "distance": (v % 30).cast("double"), "period": (v % 4 + 1).cast("int"), "clock": (v % 720).cast("double")})
    sub = F.when(kind == "rebound", F.when(v % 3 == 0, "offensive").otherwise("defensive")).when(kind == "violation", F.when(v % 3 == 0, "goaltending").otherwise("kicked ball"))
    sub = sub.when(kind == "period", F.when(v % 2 == 0, "start").otherwise("end")).when(kind == "foul", F.when(v % 2 == 0, "shooting").otherwise("personal"))
    return rows.withColumns({"sub": sub, "text": F.when(n % 13 == 4, "Free Throw 1 of 2").when(n % 13 == 5, "Free Throw 2 of 2"), "area": F.lit(None).cast("string")})


_LIST = "[" + ", ".join(f"'{k}'" for k in _GAME_KINDS) + "]"
_O = "PARTITION BY user_id ORDER BY ts, event_id"
_PRE = f"{_O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
#: Windows say the grammar where every side is known: marks of a missed shot in the air, of the series
#: of free throws, and of who gets the ball (a side, or a flip of whoever had it).
_GRAMMAR = f"""WITH a AS (SELECT *, CAST(floor(value) AS BIGINT) AS v, {_LIST}[event_id % 13 + 1] AS kind, CASE WHEN (event_id // 13) % 2 = 0 THEN 'home' ELSE 'away' END AS side FROM events),
b AS (SELECT *, v % 2 = 0 AS made, CASE kind WHEN 'rebound' THEN v % 3 = 0 WHEN 'violation' THEN v % 3 = 0 WHEN 'period' THEN v % 2 = 1 END AS yes, CASE side WHEN 'home' THEN 'away' ELSE 'home' END AS other, event_id % 13 AS k, sum(CAST(event_id % 13 = 4 AS INT)) OVER ({_O}) AS series FROM a),
c AS (SELECT *, CASE WHEN kind IN ('2pt', '3pt') AND NOT made THEN side WHEN kind IN ('2pt', '3pt', 'rebound', 'turnover', 'violation', 'period') OR k = 5 THEN '' END AS mark, CASE WHEN series > 0 THEN first_value(side) OVER (PARTITION BY user_id, series ORDER BY ts, event_id) ELSE '' END AS fts, sum(CAST(kind = 'freethrow' AND made AS INT)) OVER (PARTITION BY user_id, series ORDER BY ts, event_id) AS ftm FROM b),
d AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER ({_PRE}), '') AS missed, last_value(CASE WHEN mark <> '' THEN CAST(kind[1:1] AS INT) END IGNORE NULLS) OVER ({_PRE}) AS mv FROM c),
e AS (SELECT *, CASE WHEN kind IN ('2pt', '3pt') THEN made WHEN kind = 'freethrow' THEN k = 5 WHEN kind = 'rebound' THEN missed <> '' AND NOT yes WHEN kind = 'period' THEN missed <> '' AND yes ELSE kind IN ('turnover', 'violation') END AS fin,
CASE WHEN kind = 'jumpball' THEN side WHEN kind IN ('2pt', '3pt') THEN CASE WHEN made THEN other ELSE side END WHEN k = 5 THEN CASE fts WHEN 'home' THEN 'away' ELSE 'home' END WHEN kind = 'rebound' AND missed <> '' AND NOT yes THEN side WHEN kind = 'turnover' OR kind = 'violation' AND NOT yes THEN other
WHEN kind = 'violation' THEN CASE missed WHEN 'home' THEN 'away' WHEN 'away' THEN 'home' ELSE 'flip' END END AS has FROM d),
f AS (SELECT *, count(CASE WHEN has <> 'flip' THEN 1 END) OVER ({_O}) AS island FROM e),
g AS (SELECT *, coalesce(first_value(CASE WHEN has <> 'flip' THEN has END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id), '') AS base, count(CASE WHEN has = 'flip' THEN 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS flips FROM f),
h AS (SELECT *, CASE WHEN flips = 0 THEN base WHEN (flips % 2 = 1) = (base = 'home') THEN 'away' ELSE 'home' END AS after FROM g),
i AS (SELECT *, coalesce(lag(after) OVER ({_O}), '') AS possessing, coalesce(sum(CAST(fin AS INT)) OVER ({_PRE}), 0) AS possession FROM h),
j AS (SELECT *, bool_or(kind = 'foul') OVER q AS had_foul, bool_or(kind = 'substitution') OVER q AS had_sub, CASE WHEN kind IN ('2pt', '3pt') THEN side WHEN kind = 'freethrow' AND ftm > 0 THEN fts WHEN kind = 'violation' AND yes THEN CASE WHEN missed <> '' THEN missed ELSE possessing END ELSE '' END AS team_scored,
CASE kind WHEN '2pt' THEN 2 WHEN '3pt' THEN 3 WHEN 'freethrow' THEN ftm WHEN 'violation' THEN CASE WHEN yes THEN 2 ELSE 0 END ELSE 0 END AS points, CASE kind WHEN '2pt' THEN 2 WHEN '3pt' THEN 3 WHEN 'freethrow' THEN 1 WHEN 'violation' THEN CASE WHEN yes THEN 2 ELSE 0 END WHEN 'turnover' THEN 0 ELSE mv END AS shot_value FROM i WINDOW q AS (PARTITION BY user_id, possession ORDER BY ts, event_id)),
r AS (SELECT user_id, event_id, ts, CAST(possession AS BIGINT) AS possession, possessing AS side, team_scored, CAST(points AS INT) AS points, CAST(shot_value AS INT) AS shot_value, had_foul, had_sub FROM j WHERE fin)"""


@query(_GRAMMAR + " SELECT user_id, event_id, possession, side, team_scored, points, shot_value, had_foul, had_sub FROM r")
def e01_possession_grammar(t):
    """Every possession of each user's game: free-throw series, jump balls, violations and period ends."""
    out = possessions.possession_rows(_game(events(t)), ["user_id"], ["us", "event_id"])
    return out.select("user_id", "event_id", "possession", "side", "team_scored", "points", "shot_value", "had_foul", "had_sub")


@query(_GRAMMAR + """ SELECT r.user_id, r.possession, any_value(r.points) AS points, count(CASE WHEN j.kind = 'foul' THEN 1 END) AS fouls, count(CASE WHEN j.kind = 'substitution' AND j.side = 'home' THEN 1 END) AS home_subs, coalesce(bool_or(j.kind = 'foul' AND j.v % 2 = 0), false) AS had_shooting_foul
FROM r JOIN j USING (user_id, possession) GROUP BY ALL""")
def e07_corrected_rows(t):
    """Possessions built again from the events, with what their fouls and substitutions sum up to."""
    game = _game(events(t))
    rows = possessions.possession_rows(game, ["user_id"], ["us", "event_id"]).select("user_id", "event_id", "possession", "points")
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = game.join(rows.select("event_id", F.lit(1).alias("ends")), "event_id", "left")
    feed_ = ends.withColumn("possession", F.coalesce(F.sum("ends").over(w), F.lit(0)))
    fouls = (feed_.where("kind = 'foul'"), {"fouls": F.count("*"), "had_shooting_foul": F.max(F.col("sub") == "shooting")}, {"fouls": 0, "had_shooting_foul": False})
    subs = (feed_.where("kind = 'substitution'"), {"home_subs": F.count_if(F.col("side") == "home")}, {"home_subs": 0})
    out = feed.corrected_rows(rows, [fouls, subs], ["user_id", "possession"])
    return out.select("user_id", "possession", "points", "fouls", "home_subs", "had_shooting_foul")


@query(_GRAMMAR + f""" SELECT e.event_id, last_value(r.possession IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS possession, last_value(r.points IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS points FROM events e LEFT JOIN r ON r.event_id = e.event_id""")
def e08_write_back(t):
    """The feed with the last possession's columns on every event."""
    game = _game(events(t))
    rows = possessions.possession_rows(game, ["user_id"], ["us", "event_id"])
    return feed.write_back(game, rows, ["user_id", "event_id"], ["user_id"], ["us", "event_id"], ["possession", "points"]).select("event_id", "possession", "points")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fouls' WHEN 1 THEN 'substitutions' ELSE 'timeouts' END AS tab, CASE event_id % 3 WHEN 2 THEN CASE event_id % 2 WHEN 0 THEN 'PHX' ELSE 'LAL' END ELSE 'T' || user_id % 2 END AS team,
CASE WHEN event_id % 3 < 2 THEN user_id END AS player, CASE event_id % 3 WHEN 0 THEN event_type WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN 'Regular' ELSE 'Short' END END AS what, CASE WHEN event_id % 3 = 1 AND event_id % 4 > 0 THEN 'Bo ' || event_id % 7 END AS came, CASE WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 4 = 0 THEN -1 ELSE CAST(event_id % 6 AS INT) END END AS full_left FROM events""")
def e04_event_tables(t):
    """Fouls, substitutions and timeouts taken out of one feed."""
    i, said = F.col("event_id"), lambda c: c.cast("string")
    kind = F.when(i % 3 == 0, "Foul").when(i % 3 == 1, "Substitution").otherwise("Timeout")
    call = F.concat(F.when(i % 2 == 0, "SUNS").otherwise("Lakers"), F.lit(" Timeout: Regular"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit(" (Full "), said(i % 6), F.lit(" Short 0)"))))
    text = F.when(i % 3 == 1, F.when(i % 4 > 0, F.concat(F.lit("SUB: Bo "), said(i % 7), F.lit(" FOR Al"))).otherwise("no names")).otherwise(call)
    rows = t.events.select("event_id", kind.alias("kind"), F.when(i % 3 == 0, F.col("event_type")).when(i % 5 == 0, "").otherwise("Short").alias("sub"), text.alias("text"), F.concat(F.lit("T"), said(F.col("user_id") % 2)).alias("team"), F.col("user_id").alias("player"), F.lit("PHX").alias("home"), F.lit("LAL").alias("away"))
    tables = feed.event_tables(rows, ["event_id"], [("suns", "PHX"), ("lakers", "LAL")])
    none = lambda kind: F.lit(None).cast(kind)
    fouls = tables["fouls"].select("event_id", F.lit("fouls").alias("tab"), "team", "player", F.col("foul_type").alias("what"), none("string").alias("came"), none("int").alias("full_left"))
    subs = tables["substitutions"].select("event_id", F.lit("substitutions").alias("tab"), "team", F.col("player_out").alias("player"), none("string").alias("what"), "came", none("int").alias("full_left"))
    calls = tables["timeouts"].select("event_id", F.lit("timeouts").alias("tab"), "team", none("bigint").alias("player"), F.col("timeout_type").alias("what"), none("string").alias("came"), "full_left")
    return fouls.unionByName(subs).unionByName(calls)


@query(_GRAMMAR + f""", s AS (SELECT *, last_value(CASE WHEN points > 0 THEN team_scored END IGNORE NULLS) OVER ({_PRE}) AS prior FROM r),
t AS (SELECT *, sum(CASE WHEN points > 0 AND (prior IS NULL OR prior <> team_scored) THEN 1 ELSE 0 END) OVER ({_O}) AS run FROM s),
u AS (SELECT *, count(CASE WHEN points > 0 THEN 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS len, sum(points) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS pts, sum(CASE WHEN points > 0 AND shot_value = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS threes FROM t)
SELECT event_id, possession, points, coalesce(prior, '') AS run_side, CAST(coalesce(lag(len) OVER w, 0) AS BIGINT) AS run_length, CAST(coalesce(lag(CASE WHEN run > 0 THEN pts ELSE 0 END) OVER w, 0) AS BIGINT) AS run_points, CAST(coalesce(lag(threes) OVER w, 0) AS BIGINT) AS run_threes,
CAST(coalesce(sum(CASE WHEN team_scored = 'home' THEN points END) OVER f, 0) AS BIGINT) AS home_5, CAST(coalesce(sum(CASE WHEN team_scored = 'away' THEN points END) OVER f, 0) AS BIGINT) AS away_5 FROM u WINDOW w AS ({_O}), f AS ({_O} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def st04_live_possessions(t):
    """Possessions and the features before them from the stream of raw events, by the same machine as the table's."""
    out = ", ".join((possessions.ROW, possessions.FEATURES))
    rows = _keyed(t, possessions.grammar(features=True), list(possessions.TAKES), out, shape=_game)
    return rows.select("event_id", "possession", "points", "run_side", "run_length", "run_points", "run_threes", "home_5", "away_5")


@query("""WITH f AS (SELECT user_id, min((ts, event_id)) AS first_sub FROM events WHERE event_type = 'error' GROUP BY 1),
s AS (SELECT e.user_id, e.event_id % 2 AS side, e.event_id % 11 AS player, min((e.ts, e.event_id)) AS seen FROM events e LEFT JOIN f USING (user_id) WHERE first_sub IS NULL OR (e.ts, e.event_id) < first_sub GROUP BY ALL)
SELECT user_id, side, player FROM s QUALIFY row_number() OVER (PARTITION BY user_id, side ORDER BY seen) <= 5""")
def e02_starters(t):
    rows = events(t).select("user_id", "us", "event_id", (F.col("event_id") % 2).alias("side"), (F.col("event_id") % 11).alias("player"), (F.col("event_type") == "error").alias("sub"))
    return sequences.starters(rows, ["user_id"], "side", "player", ["us", "event_id"], "sub", 5)


@query()
def e03_lineups(t):
    """Lineup after each substitution of a side, by a fold over its substitutions."""
    rows = events(t).where("event_type in ('click', 'view')").select("user_id", "us", "event_id", (F.col("event_id") % 11).alias("out"), (F.col("event_id") % 13).alias("in"))
    return sequences.lineups(rows, ["user_id"], ["us", "event_id"], "in", "out", [0, 1, 2, 3, 4])


_W = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""WITH a AS (SELECT *, epoch_us(ts) AS us, CASE WHEN event_type = 'purchase' THEN value END AS anchor FROM events),
b AS (SELECT *, last_value(anchor IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a0, last_value(CASE WHEN anchor IS NOT NULL THEN us END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
first_value(anchor IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a1, first_value(CASE WHEN anchor IS NOT NULL THEN us END IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM a)
SELECT event_id, round(CASE WHEN t1 > t0 THEN a0 + (a1 - a0) * (CAST(us - t0 AS DOUBLE) / (t1 - t0)) ELSE coalesce(a0, a1) END, 6) AS level FROM b""")
def d04_interpolation(t):
    """Linear between anchors; the nearest anchor outside."""
    return sequences.interpolated(events(t), ["user_id"], ["us", "event_id"], "us", F.when(F.col("event_type") == "purchase", F.col("value")), "level").select("event_id", F.round("level", 6).alias("level"))


@query(f"""SELECT event_id, round(0.5 + 0.02 * value - 0.3 * CAST(event_type = 'error' AS INT) + 0.001 * user_id, 6) AS score FROM events""")
def u01_batch_scoring(t):
    from ..operators.scoring import score

    rows = t.events.select("event_id", "value", (F.col("event_type") == "error").cast("double").alias("err"), F.col("user_id").cast("double").alias("user"))
    model = lambda x: 0.5 + x @ [0.02, -0.3, 0.001]
    return score(rows, ["value", "err", "user"], model, "score").select("event_id", F.round("score", 6).alias("score"))


@query()
def u07_permutation_importance(t):
    """Loss of a linear score in squared error when one feature is shuffled."""
    from ..operators.scoring import permutation_importance

    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"))
    return permutation_importance(rows, ["l_quantity", "l_discount", "l_tax"], lambda x: x @ [1.5, 0.0, 0.0], "y", ["l_orderkey", "l_linenumber"])


@query("""WITH RECURSIVE o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey, day, n, greatest(0.05, 2.0 / 3) * o_totalprice + (1 - greatest(0.05, 2.0 / 3)) * 100000.0 AS level FROM o WHERE n = 1
UNION ALL SELECT o.o_custkey, o.day, o.n, greatest(0.05, 2.0 / (o.n + 2)) * o.o_totalprice + (1 - greatest(0.05, 2.0 / (o.n + 2))) * f.level FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1)
SELECT o_custkey, CAST(day AS VARCHAR) AS day, round(arg_max(level, n), 6) AS level, CAST(max(n) AS BIGINT) AS n FROM f GROUP BY o_custkey, day""")
def e10_nightly_ratings(t):
    """Customers' ratings after each day, updated in four nights of which the third is run twice."""
    import uuid

    path = f"{stream.scratch(t.spark)}/ratings-{uuid.uuid4().hex}"
    rows = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    low, high = rows.agg(F.min(F.unix_date("day")), F.max(F.unix_date("day"))).first()
    width = (high - low) // 4 + 1
    for night in (0, 1, 2, 2, 3):
        tonight = rows.where(F.floor((F.unix_date("day") - low) / width) == night)
        out = ratings.nightly(tonight, path, "o_custkey", "day", ["o_orderkey"], "o_totalprice", 100000.0)
    return out.select("o_custkey", F.col("day").cast("string").alias("day"), F.round("level", 6).alias("level"), "n")


@query("""WITH w AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent,
count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS games, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last FROM orders)
SELECT o_orderkey, c_mktsegment, round(coalesce(recent, 0), 6) AS recent, games, round(coalesce(recent - last, 0), 6) AS form, c_acctbal > 0 AS solvent FROM w LEFT JOIN customer ON o_custkey = c_custkey""")
def e06_e09_features(t):
    """One row per order with strictly prior features of its customer, in one plan."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    recent = F.avg(p).over(w.rowsBetween(-3, -1))
    rows = t.orders.withColumns({"recent": recent, "games": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1)), "last": F.lag(p).over(w)})
    rows = rows.join(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", "c_mktsegment", F.round(F.coalesce("recent", F.lit(0.0)), 6).alias("recent"), "games", F.round(F.coalesce(F.col("recent") - F.col("last"), F.lit(0.0)), 6).alias("form"), (F.col("c_acctbal") > 0).alias("solvent"))
