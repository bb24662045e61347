"""Game state, clocks and texts: raw rows are made from the event log and the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import game as G
from ..functions import text as T
from ..operators import aggs, clocks, joins, labels, replay, windows
from .q_joins import HOUR, events
from .registry import query

#: Raw columns of a game row: name -> expression that Spark and DuckDB read alike.
RAW = {
    "game_id": "user_id",
    "possession_id": "event_id",
    "period": "1 + event_id % 6",
    "game_clock_secs": "CASE WHEN event_id % 6 < 4 THEN value * 7 ELSE value * 3 END",
    "score_diff": "event_id % 61 - 30",
    "current_run_team": "CASE event_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'away' ELSE '' END",
    "current_run_points": "event_id % 17",
    "current_run_length": "event_id % 7",
    "current_run_3pt_pct": "(event_id % 11) / 10.0",
    "current_run_paint_pct": "(event_id % 13) / 12.0",
    "home_points_last_5_poss": "event_id % 12",
    "away_points_last_5_poss": "event_id % 14",
    "home_points_last_10_poss": "event_id % 23",
    "away_points_last_10_poss": "event_id % 27",
    "pace_game_to_date": "10 + value / 10",
    "pace_last_10_possessions": "8 + value / 7",
    "expected_pace": "14.5",
    "home_xPPP_last_5": "value / 80",
    "away_xPPP_last_5": "value / 90",
    "home_xppp": "value / 70",
    "away_xppp": "value / 60",
    "home_actual_vs_expected_PPP": "value / 50 - 1",
    "away_actual_vs_expected_PPP": "value / 40 - 1",
    "home_team_fouls_q": "CASE WHEN event_id % 9 < 8 THEN event_id % 9 END",
    "away_team_fouls_q": "event_id % 8",
    "home_trouble_star_tier": "event_id % 3",
    "away_trouble_star_tier": "event_id % 2",
    "home_star_on_court": "event_id % 4 = 0",
    "away_star_on_court": "event_id % 5 = 0",
    "home_sub_count": "event_id % 5",
    "away_sub_count": "event_id % 6",
    "possessions_since_last_timeout": "CASE WHEN event_id % 10 < 8 THEN event_id % 44 WHEN event_id % 10 = 8 THEN 999 END",
    "home_called_timeout_in_last_3_poss": "event_id % 7 = 0",
    "away_called_timeout_in_last_3_poss": "event_id % 8 = 0",
    "home_timeouts_used": "event_id % 6",
    "away_timeouts_used": "event_id % 5",
    "home_lineup_sample_size": "event_id % 300",
    "away_lineup_sample_size": "event_id % 200",
    "home_lineup_just_changed": "event_id % 3 = 0",
    "away_lineup_just_changed": "event_id % 4 = 1",
}
_RAW_SQL = "r AS (SELECT ts, " + ", ".join(f"{sql} AS {name}" for name, sql in RAW.items()) + " FROM events)"


def _raw(t):
    return events(t).select("us", *[F.expr(sql).alias(name) for name, sql in RAW.items()])


_LEFT = "(greatest(4 - period, 0) * 12 + game_clock_secs / 60)"
#: Derived column -> its SQL.
BLOCK = {
    "lead_z": f"score_diff / sqrt(greatest({_LEFT}, 0.5))",
    "time_leverage": f"1 - sqrt(greatest(0, least(1, {_LEFT} / 48)))",
    "garbage_time_risk": f"1 / (1 + exp(-greatest(-20, least(20, (abs(score_diff) - 15) / 5.0)))) * (1 - greatest(0, least(1, {_LEFT} / 48)))",
    "current_run_team_encoded": "sgn",
    "run_signed_points": "sgn * current_run_points",
    "run_efficiency": "current_run_points / greatest(current_run_length, 1.0)",
    "run_fragility": "current_run_3pt_pct - current_run_paint_pct",
    "swing_5": "home_points_last_5_poss - away_points_last_5_poss",
    "swing_accel": "2 * (home_points_last_5_poss - away_points_last_5_poss) - (home_points_last_10_poss - away_points_last_10_poss)",
    "pace_ref": "w * pace_game_to_date + (1 - w) * expected_pace",
    "pace_surprise": "pace_last_10_possessions - (w * pace_game_to_date + (1 - w) * expected_pace)",
    "xppp_edge": "home_xPPP_last_5 - away_xPPP_last_5",
    "luck_edge": "home_actual_vs_expected_PPP - away_actual_vs_expected_PPP",
    "quality_trend_edge": "(h1 - h2) - (a1 - a2)",
    "team_foul_edge": "coalesce(home_team_fouls_q, 0) - away_team_fouls_q",
    "home_fouls_until_bonus": "greatest(0, least(5, 5 - coalesce(home_team_fouls_q, 0)))",
    "away_fouls_until_bonus": "greatest(0, least(5, 5 - away_team_fouls_q))",
    "star_trouble_edge": "CAST(home_trouble_star_tier > 0 AS INT) - CAST(away_trouble_star_tier > 0 AS INT)",
    "star_on_court_edge": "CAST(home_star_on_court AS INT) - CAST(away_star_on_court AS INT)",
    "sub_count_edge": "home_sub_count - away_sub_count",
    "poss_since_timeout": "least(coalesce(possessions_since_last_timeout, 999), 30)",
    "no_timeout_yet": "CAST(coalesce(possessions_since_last_timeout, 999) >= 999 AS INT)",
    "timeout_called_edge": "CAST(home_called_timeout_in_last_3_poss AS INT) - CAST(away_called_timeout_in_last_3_poss AS INT)",
    "timeouts_remaining_edge": "greatest(0, 4 - home_timeouts_used) - greatest(0, 4 - away_timeouts_used)",
    "lineup_confidence": "ln(1 + least(home_lineup_sample_size, away_lineup_sample_size))",
    "lineup_changed_edge": "CAST(home_lineup_just_changed AS INT) - CAST(away_lineup_just_changed AS INT)",
    "lineup_changed_any": "CAST(home_lineup_just_changed OR away_lineup_just_changed AS INT)",
}
_TREND = ", ".join(f"coalesce(avg({side}_xppp) OVER (PARTITION BY game_id ORDER BY possession_id ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING), 1) AS {name}" for side, a, b, name in (("home", 5, 1, "h1"), ("home", 10, 6, "h2"), ("away", 5, 1, "a1"), ("away", 10, 6, "a2")))


@query(f"""WITH {_RAW_SQL}, s AS (SELECT *, CASE current_run_team WHEN 'home' THEN 1.0 WHEN 'away' THEN -1.0 ELSE 0.0 END AS sgn, row_number() OVER (PARTITION BY game_id ORDER BY possession_id) - 1 AS elapsed, {_TREND} FROM r),
v AS (SELECT *, least(elapsed / (elapsed + 40.0), 0.85) AS w FROM s)
SELECT possession_id, {", ".join(f"round(CAST({sql} AS DOUBLE), 6) AS {name}" for name, sql in BLOCK.items())} FROM v""")
def m15_derived_block(t):
    """The derived block over raw rows."""
    return G.derived_block(_raw(t)).select("possession_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in BLOCK])


@query(f"""WITH {_RAW_SQL} SELECT possession_id, round(((period - 1) * 720 + (720 - least(game_clock_secs, 720))) / 60, 6) AS elapsed, round(greatest({_LEFT}, 1.0), 6) AS minutes_left,
abs(score_diff) > 20 AS is_blowout, abs(score_diff) > 20 AND period >= 4 AND game_clock_secs < 360 AS is_garbage_time, period = 4 AND abs(score_diff) <= 5 AS q4_close_game,
round(abs(score_diff) / greatest({_LEFT}, 1.0), 6) AS urgency, round(CAST(score_diff AS DOUBLE) * score_diff / greatest({_LEFT}, 1.0), 6) AS comeback FROM r""")
def m02_m14_clock_flags(t):
    """Minutes gone and left, extra periods included, and the flags of score and time."""
    p, c = F.col("period"), F.col("game_clock_secs")
    f = G.state_flags(F.col("score_diff"), p, c)
    return _raw(t).select("possession_id", F.round(X.minutes_elapsed(p, c), 6).alias("elapsed"), F.round(X.minutes_left(p, c, floor=1.0), 6).alias("minutes_left"), f["is_blowout"].alias("is_blowout"), f["is_garbage_time"].alias("is_garbage_time"), f["q4_close_game"].alias("q4_close_game"), F.round(f["trailing_team_urgency"], 6).alias("urgency"), F.round(f["comeback_probability_proxy"], 6).alias("comeback"))


_GATES = "value > 5, event_type <> 'error', user_id % 3 <> 0".split(", ")


@query(f"""SELECT event_id, CASE WHEN NOT {_GATES[0]} THEN 'price' WHEN NOT {_GATES[1]} THEN 'kind' WHEN NOT {_GATES[2]} THEN 'user' END AS blocked, {_GATES[0]} AS pass_price,
CASE WHEN {_GATES[0]} THEN {_GATES[1]} END AS pass_kind, CASE WHEN {_GATES[0]} AND {_GATES[1]} THEN {_GATES[2]} END AS pass_user FROM events""")
def f09_gate_columns(t):
    """The first gate that blocks, and which ones were reached and passed."""
    gates = [("price", F.col("value") > 5), ("kind", F.col("event_type") != "error"), ("user", F.col("user_id") % 3 != 0)]
    return t.events.select("event_id", *[c.alias(n) for n, c in X.gate_columns(gates).items()])


# --- texts


@query("""WITH b AS (SELECT o_orderkey AS k, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS day FROM orders)
SELECT k AS o_orderkey, CAST(day AS VARCHAR) AS day, 'AAA' AS away, 'BBB' AS home, CASE WHEN k % 12 > 9 THEN 'CCC' || CAST(k % 12 AS VARCHAR)[1] ELSE 'CCC' END AS team, CAST(k % 12 % 10 AS INT) AS points, 'CCC' AS spread_team, CAST(k % 12 AS INT) AS spread_points, CAST(day AS VARCHAR) AS event_day FROM b""")
def f02_f03_tickers(t):
    """Tickers read by places (two-digit points spoil the team there), and events' and markets' forms."""
    name = F.concat(F.lit("KXG-"), F.upper(F.date_format(F.add_months("o_orderdate", 240), "yyMMMdd")), F.lit("AAABBB-CCC"), (F.col("o_orderkey") % 12).cast("string"))
    rows = t.orders.select("o_orderkey", T.ticker_tail(name).alias("p"), T.market_spread(name).alias("m"), T.event_ticker(name).alias("e"))
    return rows.select("o_orderkey", F.col("p.day").cast("string").alias("day"), "p.away", "p.home", "p.team", "p.points", F.col("m.team").alias("spread_team"), F.col("m.points").alias("spread_points"), F.col("e.day").cast("string").alias("event_day"))


@query("""SELECT event_id, 'M' || user_id AS market_ticker, CAST(floor(value) AS INT) AS yes_bid, CAST(floor(value) + 2 AS INT) AS yes_ask, 0 AS yes_last, CAST(event_id % 50 AS INT) AS volume, 0 AS open_interest FROM events WHERE floor(value) <> 0 AND user_id % 10 <> 0""")
def f17_quote_messages(t):
    """Messages made of events and read as ticks in cents; those without a bid or market go."""
    cents = lambda x: F.format_string("%.2f", x / 100)
    message = F.to_json(F.struct(F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("M"), F.col("user_id").cast("string"))).alias("market_ticker"), cents(F.floor("value")).alias("yes_bid_dollars"), cents(F.floor("value") + 2).alias("yes_ask_dollars"), (F.col("event_id") % 50).cast("string").alias("volume_fp")))
    return T.quote_messages(t.events.select("event_id", message.alias("message")), "message")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT a.o_orderkey, count(*) AS around, count(*) FILTER (b.day < a.day) AS earlier FROM o a JOIN o b ON b.day BETWEEN a.day - 7 AND a.day + 30 GROUP BY 1""")
def f18_near_dates(t):
    """How many orders lie in the days around each, from seven before to thirty after."""
    o = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    # days are counted first, so an order meets days and not all their orders
    days = o.groupBy(F.col("day").alias("other")).agg(F.count("*").alias("n"))
    pairs = joins.near_dates(o, "day", days, "other", 7, 30)
    return pairs.groupBy("o_orderkey").agg(F.sum("n").alias("around"), F.coalesce(F.sum(F.when(F.col("other") < F.col("day"), F.col("n"))), F.lit(0)).alias("earlier"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Élan ' || user_id END AS came, CASE WHEN event_id % 2 = 0 THEN 'Bo ' || event_id % 7 END AS went, CASE WHEN event_id % 2 = 1 THEN CASE event_id % 3 WHEN 0 THEN 'PHX' WHEN 1 THEN 'LAL' ELSE '' END ELSE '' END AS team,
CASE WHEN event_id % 2 = 1 THEN CAST(event_id % 5 AS INT) ELSE -1 END AS full_left, CASE WHEN event_id % 7 = 0 THEN 1 ELSE CAST(1 + event_id % 3 AS INT) END AS n, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 3 END AS m FROM events""")
def x02_x04_texts(t):
    """Substitutions, timeouts and free throws written as texts and read back."""
    i = F.col("event_id")
    said = lambda c: c.cast("string")
    side = F.when(i % 3 == 0, "SUNS").when(i % 3 == 1, "Los Angeles Lakers").otherwise("Hawks")
    text = F.when(i % 2 == 0, F.concat(F.lit("sub: Élan "), said(F.col("user_id")), F.lit(" FOR Bo "), said(i % 7))).otherwise(F.concat(side, F.lit(" Timeout: Regular (Full "), said(i % 5), F.lit(" Short 0)")))
    throw = F.when(i % 7 == 0, "Free Throw Technical").otherwise(F.concat(F.lit("Free Throw "), said(1 + i % 3), F.lit(" of 3")))
    rows = t.events.select("event_id", text.alias("text"), throw.alias("throw"), F.lit("PHX").alias("home"), F.lit("LAL").alias("away"))
    rows = T.with_timeout_team(rows, [("suns", "PHX"), ("lakers", "LAL")], "text", "home", "away")
    return rows.select("event_id", T.substituted(F.col("text"))["came"].alias("came"), T.substituted(F.col("text"))["went"].alias("went"), "team", T.full_timeouts(F.col("text")).alias("full_left"), T.free_throw(F.col("throw"), F.col("throw"))["n"].alias("n"), T.free_throw(F.col("throw"), F.col("throw"))["m"].alias("m"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey WHEN n_nationkey % 3 = 1 THEN n_nationkey ELSE -1 END AS found FROM nation""")
def x01_name_lookup(t):
    """Names found by their whole accent-free form, by their last word, or not."""
    names = t.nation.select(F.concat(F.lit("Ré "), F.col("n_name")).alias("name"), F.col("n_nationkey").alias("id"))
    k = F.col("n_nationkey")
    asked = t.nation.select("n_nationkey", F.when(k % 3 == 0, F.concat(F.lit("RE "), F.col("n_name"))).when(k % 3 == 1, F.concat(F.lit("Zoë "), F.element_at(F.split("n_name", " "), -1))).otherwise("nobody").alias("name"))
    return T.with_name_lookup(asked, names, "name", "id", "found").select("n_nationkey", "found")


# --- clocks


def _starts(t):
    """Starts of four periods for each order: some roll past midnight, some are broken."""
    k = F.col("o_orderkey")
    secs = F.expr("(case when o_orderkey % 7 = 0 then 36000 else 79800 end) + 1800 * period + 60 * (o_orderkey % 9)") % 86400
    secs = F.when((k % 11 == 0) & (F.col("period") == 3), (secs + 50040) % 86400).otherwise(secs)
    rows = t.orders.select("o_orderkey", F.add_months("o_orderdate", 240).alias("day"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("period"))
    hour, minute = F.floor(secs / 3600), F.floor(secs / 60) % 60
    return rows.withColumn("clock", F.format_string("%d:%02d %s", (hour + 11) % 12 + 1, minute, F.when(hour < 12, "AM").otherwise("PM")))


_STARTS = """s AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS day, p AS period, (CASE WHEN o_orderkey % 7 = 0 THEN 36000 ELSE 79800 END + 1800 * p + 60 * (o_orderkey % 9)) % 86400 AS s0 FROM orders CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS p)),
s1 AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 AND period = 3 THEN (s0 + 50040) % 86400 ELSE s0 END AS secs FROM s),
s2 AS (SELECT *, CASE WHEN secs <= lag(secs) OVER (PARTITION BY o_orderkey ORDER BY period) THEN 1 ELSE 0 END AS roll FROM s1),
s3 AS (SELECT *, sum(roll) OVER (PARTITION BY o_orderkey ORDER BY period) AS shift FROM s2),
a AS (SELECT *, timezone('America/New_York', CAST(day AS TIMESTAMP) + to_seconds(secs + 86400 * shift)) AS utc FROM s3),
g AS (SELECT o_orderkey, any_value(day) AS day, min(secs) FILTER (period = 1) AS first_secs, max(epoch_us(utc)) - min(epoch_us(utc)) AS span FROM a GROUP BY 1)"""


@query(f"""WITH {_STARTS} SELECT a.o_orderkey, CAST(period AS INT) AS period, epoch_us(utc) AS us, CASE WHEN first_secs // 3600 NOT BETWEEN 12 AND 23 THEN 'hour' WHEN span > {6 * HOUR} THEN 'span' END AS fault FROM a JOIN g USING (o_orderkey)""")
def d03_d05_anchors(t):
    """Local starts of periods as UTC, rolled past midnight, and the first check that they fail."""
    found = clocks.anchor_faults(clocks.local_anchors(_starts(t), ["o_orderkey"], "day", "period", "clock"))
    return found.select("o_orderkey", "fault", F.explode("anchors").alias("a")).select("o_orderkey", "a.period", F.unix_micros("a.at").alias("us"), "fault")


@query(f"""WITH {_STARTS}, n AS (SELECT *, lead(utc) OVER (PARTITION BY o_orderkey ORDER BY period) AS nxt FROM a), q AS (SELECT *, (epoch_us(nxt) - epoch_us(utc)) / 1e6 / 720 AS ratio FROM n),
m AS (SELECT o_orderkey, avg(ratio) AS mean FROM q GROUP BY 1), e AS (SELECT *, o_orderkey % 720 AS clock FROM q JOIN m USING (o_orderkey))
SELECT o_orderkey, CAST(period AS INT) AS period, CAST(round((epoch_us(utc) + (720 - clock) / 720.0 * coalesce((epoch_us(nxt) - epoch_us(utc)) / 1e6, mean * 720) * 1e6) / 1000, 0) AS BIGINT) AS ms FROM e""")
def d04_event_times(t):
    """Times between the starts of periods; the last period lasts by the others' ratio."""
    anchors = clocks.local_anchors(_starts(t), ["o_orderkey"], "day", "period", "clock")
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 720).alias("clock"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("period"))
    return clocks.event_times(rows, anchors, ["o_orderkey"], "period", "clock").select("o_orderkey", "period", F.round(F.unix_micros("at") / 1000).cast("long").alias("ms"))


@query("""SELECT event_id, epoch_us(date_trunc('second', ts)) AS us, strftime(timezone('America/New_York', timezone('UTC', ts + INTERVAL 6 MONTH * (event_id % 2))), '%Y-%m-%d %H:%M') AS local,
epoch_us(timezone('America/New_York', timezone('UTC', ts + INTERVAL 6 MONTH * (event_id % 2)))) - epoch_us(ts + INTERVAL 6 MONTH * (event_id % 2)) = -14400000000 AS dst FROM events""")
def d02_d06_stamps(t):
    """ISO stamps as UTC without their fraction, a zone's clock, and whether it is on daylight saving."""
    ts = F.col("ts").cast("timestamp")
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    other = F.when(F.col("event_id") % 2 == 0, ts).otherwise(F.expr("cast(ts as timestamp) + interval 6 months"))
    return t.events.select("event_id", F.unix_micros(clocks.utc_stamp(text)).alias("us"), clocks.local_time(other, "America/New_York").alias("local"), clocks.daylight_saving(other, "America/New_York").alias("dst"))


@query(f"""WITH g AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, CAST(ts AS DATE))) / 60e6 - 10 AS gone FROM events)
SELECT event_id, round(CASE WHEN gone <= 0 THEN 0 WHEN gone <= 45 THEN gone WHEN gone <= 60 THEN 45 ELSE gone - 15 END, 6) AS minute FROM g""")
def d07_match_minute(t):
    """Match minutes from a kickoff ten minutes after each user's first event of a day."""
    from pyspark.sql.window import Window

    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    kickoff = F.timestamp_micros(F.unix_micros(F.min("ts").over(Window.partitionBy("user_id", F.to_date("ts")))) + 10 * 60_000_000)
    return rows.select("event_id", F.round(X.match_minute(F.col("ts"), kickoff), 6).alias("minute"))


# --- aggregates and replay


@query("""WITH e AS (SELECT l_orderkey AS game, l_suppkey % 10 AS team, l_quantity AS pace FROM lineitem UNION ALL SELECT l_orderkey, l_partkey % 10, l_quantity FROM lineitem WHERE l_suppkey % 10 <> l_partkey % 10),
s AS (SELECT team, game, sum(CASE WHEN pace > 5 THEN pace END) AS s, count(CASE WHEN pace > 5 THEN pace END) AS n FROM e GROUP BY ALL)
SELECT team, game, round(coalesce(sum(s) OVER w / nullif(sum(n) OVER w, 0), 15), 6) AS pace FROM s WINDOW w AS (PARTITION BY team ORDER BY game ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def a08_average_pace(t):
    rows = t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 10).alias("h"), (F.col("l_partkey") % 10).alias("a"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(0.0).alias("p"))
    return windows.average_pace(rows, "h", "a", "l_orderkey", "p").select("team", "game", F.round("pace", 6).alias("pace"))


@query("""WITH p AS (SELECT l_returnflag, l_orderkey, l_suppkey, sum(l_quantity) AS own FROM lineitem GROUP BY ALL), s AS (SELECT l_returnflag, l_orderkey, sum(own) AS total FROM p GROUP BY ALL),
a AS (SELECT l_returnflag, l_suppkey, avg(own / total) AS share FROM p JOIN s USING (l_returnflag, l_orderkey) GROUP BY ALL)
SELECT l_returnflag, round(sum(abs(share * (s_acctbal - 5000))), 4) AS impact FROM a JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def a11_share_impact(t):
    ratings = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") - 5000).alias("rating"))
    return aggs.share_weighted_impact(t.lineitem, ["l_returnflag"], "l_orderkey", "l_suppkey", "l_quantity", ratings, "rating").select("l_returnflag", F.round("impact", 4).alias("impact"))


@query("""SELECT event_id, CASE WHEN (CASE WHEN user_id % 2 = 0 THEN value - 50 ELSE event_id % 3 - 1 END) >= 0 THEN 1 ELSE -1 END AS entry_side FROM events
WHERE event_type <> 'error' AND event_id % 5 >= 2 AND value / 100 >= 0.15 AND value BETWEEN 30 AND 70 AND abs(value - 50) >= 8""")
def l10_gates(t):
    """Signals that pass the replay's gates, with their side by trajectory or by run."""
    v, i = F.col("value"), F.col("event_id")
    args = (F.col("event_type") != "error", i % 5, v / 100, v, v - 50, i % 3 - 1, 2, 0.15, (30.0, 70.0), 8.0)
    even, odd = t.events.where("user_id % 2 = 0"), t.events.where("user_id % 2 <> 0")
    return replay.gated(even, *args, by_trajectory=True).unionByName(replay.gated(odd, *args)).select("event_id", "entry_side")


@query("""WITH q AS (SELECT *, user_id AS trade, CASE WHEN user_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS dir, 50 AS entry, floor(value) AS bid, CASE WHEN event_id % 9 = 0 THEN 0 ELSE floor(value) + 2 END AS ask, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS held FROM events),
p AS (SELECT *, CAST(CASE WHEN dir = 'NO' THEN 100 - CASE WHEN ask = 0 THEN bid ELSE ask END ELSE bid END AS DOUBLE) AS price FROM q),
k AS (SELECT *, greatest(max(price) OVER (PARTITION BY trade ORDER BY ts, event_id), 50) AS peak FROM p),
r AS (SELECT *, CASE WHEN 50 - price >= 45 THEN 'STOP_LOSS' WHEN peak - 50 >= 20 AND peak - price >= 25 THEN 'TRAIL_STOP' WHEN held >= 12 THEN 'TIME_STOP' END AS reason FROM k)
SELECT trade, event_id, reason AS exit_reason, price AS exit_price, peak FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade ORDER BY ts, event_id) = 1""")
def l14_live_exits(t):
    """The quote that ends each user's trade by stop loss, trailing stop or time."""
    from pyspark.sql.window import Window

    rows = events(t).withColumns({"dir": F.when(F.col("user_id") % 2 == 0, "YES").otherwise("NO"), "entry": F.lit(50), "bid": F.floor("value"), "ask": F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.floor("value") + 2), "held": F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))})
    out = replay.live_exits(rows, "user_id", ["us", "event_id"], "dir", "entry", "bid", "ask", 5.0, 45.0, F.col("held"), 12, 20.0, 25.0)
    return out.select(F.col("user_id").alias("trade"), "event_id", "exit_reason", "exit_price", "peak")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN floor(value) + 3 ELSE 100 - floor(value) END AS cost, CASE WHEN user_id % 2 = 0 THEN floor(value) ELSE 97 - floor(value) END AS worth FROM events""")
def l19_paper_value(t):
    side, bid = F.when(F.col("user_id") % 2 == 0, "YES").otherwise("NO"), F.floor("value").cast("double")
    return t.events.select("event_id", replay.paper_value(side, bid, bid + 3, True).alias("cost"), replay.paper_value(side, bid, bid + 3, False).alias("worth"))


_NEAR = """SELECT DISTINCT ON (s.event_id) s.event_id, abs(epoch_us(v.ts) - s.us - {ahead}) AS off, v.value / 100 AS chance FROM s JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = s.user_id AND abs(epoch_us(v.ts) - s.us - {ahead}) <= {most} ORDER BY s.event_id, abs(epoch_us(v.ts) - s.us - {ahead}), epoch_us(v.ts), {tie}"""


@query(f"""WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
a AS ({_NEAR.format(ahead=0, most=24 * HOUR, tie="v.event_id DESC")}), b AS ({_NEAR.format(ahead=10 * HOUR, most=24 * HOUR, tie="v.event_id DESC")}),
m AS (SELECT a.event_id, a.chance AS x, b.chance AS y FROM a JOIN b USING (event_id))
SELECT event_id, round((y - x) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * 10, 6) AS gross, round((y - x) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * 10 - 0.00175 * (round_even(x * 100, 0) + round_even(y * 100, 0)), 6) AS net FROM m""")
def l20_line_moves(t):
    """Purchases valued on the nearest views, now and ten hours later."""
    views = events(t).where("event_type = 'view'").select("user_id", F.col("us").alias("at"), (F.col("value") / 100).alias("chance"), F.col("event_id").alias("vid"))
    bought = events(t).where("event_type = 'purchase'").select("event_id", "user_id", "us", F.when(F.col("event_id") % 2 == 0, "YES").otherwise("NO").alias("side"))
    out = replay.line_moves(bought, views, ["user_id"], "us", "at", "chance", "vid", "side", 10 * HOUR, 24 * HOUR)
    return out.select("event_id", F.round("gross", 6).alias("gross"), F.round("net", 6).alias("net"))


@query()
def l06_trajectory_labels(t):
    """Exits and trajectories of signups, known with their states an hour after they happened."""
    e = events(t)
    entries = e.where("event_type = 'signup'").select("user_id", "event_id", "us", F.col("value").alias("entry"), F.lit(1).alias("side"), F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("entry_team"))
    ticks = e.select("user_id", F.col("us").alias("at"), "value", F.col("event_id").alias("tick_id"))
    states = e.where("event_type = 'error'").select("user_id", "us", F.when(F.col("event_id") % 2 == 0, "home").otherwise("away").alias("run_side"), (F.col("event_id") % 7 == 0).alias("off"))
    out = labels.trajectory_labels(entries, ticks, states, ["user_id"], "event_id", "us", "side", "entry", "at", "value", "tick_id", 48 * HOUR, 5.0, 3.0, delay=HOUR)
    return out.select("event_id", "exit_reason", (F.col("exit_time") - F.col("us")).alias("held_us"), "exit_price", "trajectory")
