"""Forward labels, exits and the trade ledger, with the event log as tick path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import labels, replay
from .q_joins import HOUR, events
from .registry import query

BY, ORDER = ["user_id"], ["us", "event_id"]
_W = "PARTITION BY user_id ORDER BY ts, event_id"
HOLD = 48 * HOUR


@query(f"""WITH s AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'error' THEN -value END AS net FROM events),
k AS (SELECT *, count(CASE WHEN net <> 0 THEN 1 END) OVER ({_W}) AS k FROM s),
r AS (SELECT user_id, k, net, sum(net) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, max(k) OVER (PARTITION BY user_id) AS last FROM k WHERE net <> 0)
SELECT k.event_id, round(coalesce(b.c, 0) - coalesce(a.c, 0), 6) AS next_5, coalesce(b.c, 0) - coalesce(a.c, 0) >= 100 AS big FROM k
LEFT JOIN (SELECT DISTINCT user_id, last FROM r) m ON m.user_id = k.user_id
LEFT JOIN r a ON a.user_id = k.user_id AND a.k = k.k LEFT JOIN r b ON b.user_id = k.user_id AND b.k = least(k.k + 5, m.last)""")
def l01_next_margin(t):
    net = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "error", -F.col("value"))
    out = labels.with_next_margin(events(t), BY, ORDER, net, (5,))
    return out.select("event_id", F.round("next_5", 6).alias("next_5"), (F.col("next_5") >= 100).alias("big"))


@query(f"""WITH s AS (SELECT *, event_type IN ('purchase', 'signup') AS sc FROM events),
p AS (SELECT *, coalesce(last_value(CASE WHEN sc THEN event_type END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS run, count(CASE WHEN sc THEN 1 END) OVER ({_W}) AS k FROM s),
f AS (SELECT user_id, k, run AS side FROM p WHERE sc)
SELECT event_id, CAST(run = '' OR count(f.k) < 1 OR coalesce(bool_or(f.k = p.k + 1 AND side <> run), false) AS INT) AS haz_0,
CAST(run = '' OR count(f.k) < 3 OR coalesce(bool_or(f.k <= p.k + 3 AND side <> run), false) AS INT) AS haz_2
FROM p LEFT JOIN f ON f.user_id = p.user_id AND f.k BETWEEN p.k + 1 AND p.k + 3 GROUP BY event_id, run, p.k""")
def l02_hazards(t):
    """Has the run's side changed by the first and third future scoring row."""
    return _hazards(t, 3).select("event_id", F.col("hazards")[0].alias("haz_0"), F.col("hazards")[2].alias("haz_2"))


def _hazards(t, steps):
    from pyspark.sql.window import Window

    scoring = F.col("event_type").isin("purchase", "signup")
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events(t).withColumn("run", F.coalesce(F.last(F.when(scoring, F.col("event_type")), ignorenulls=True).over(w), F.lit("")))
    return labels.with_hazards(rows, BY, ORDER, "run", scoring, steps)


@query(f"""WITH s AS (SELECT *, event_type IN ('purchase', 'signup') AS sc FROM events),
p AS (SELECT *, coalesce(last_value(CASE WHEN sc THEN event_type END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS run, count(CASE WHEN sc THEN 1 END) OVER ({_W}) AS k FROM s),
f AS (SELECT user_id, k, run AS side FROM p WHERE sc)
SELECT event_id, {", ".join(f"CAST(run = '' OR count(f.k) < {j} OR coalesce(bool_or(f.k <= p.k + {j} AND side <> run), false) AS INT) AS haz_{j - 1}" for j in range(1, 11))}
FROM p LEFT JOIN f ON f.user_id = p.user_id AND f.k BETWEEN p.k + 1 AND p.k + 10 GROUP BY event_id, run, p.k""")
def l02_hazards_10(t):
    """All ten steps of the hazards."""
    return _hazards(t, 10).select("event_id", *[F.col("hazards")[k].alias(f"haz_{k}") for k in range(10)])


def _exits(t):
    entries = events(t).where("event_type = 'signup'").select("user_id", "event_id", F.col("us").alias("start"), F.col("value").alias("entry"), F.lit(1).alias("side"))
    ticks = events(t).select("user_id", "us", "value", F.col("event_id").alias("tick_id"))
    return entries, ticks, labels.first_breach(entries, ticks, BY, "event_id", "start", "side", "entry", "us", "value", "tick_id", HOLD, 5.0, 3.0)


@query(f"""WITH s AS (SELECT user_id, ts, event_id, value - 50 AS score, sign(value - 50) AS sg FROM events WHERE event_type = 'purchase'),
n AS (SELECT *, CASE WHEN lag(sg) OVER (PARTITION BY user_id ORDER BY ts, event_id) = sg THEN 0 ELSE 1 END AS nw FROM s),
i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS streak FROM i),
t AS (SELECT e.user_id, e.ts, e.event_id AS tid, e.value AS price, k.score, k.streak FROM events e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.ts >= k.ts),
e AS (SELECT user_id, event_id, epoch_us(ts) AS s, value AS entry FROM events WHERE event_type = 'signup'),
p AS (SELECT e.*, epoch_us(t.ts) AS us, tid, price, coalesce(score, 0) AS sc, 5 + CASE WHEN coalesce(score, 0) > 0 THEN least(streak, 3) * 1.5 ELSE 0 END AS tp FROM e JOIN t ON t.user_id = e.user_id AND epoch_us(t.ts) > e.s AND epoch_us(t.ts) <= e.s + {HOLD}),
r AS (SELECT *, CASE WHEN sc <= -30 THEN 'reversal' WHEN price - entry >= tp THEN 'tp' WHEN price - entry <= -3 THEN 'sl' END AS reason FROM p),
h AS (SELECT * FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY us, tid) = 1)
SELECT e.event_id, coalesce(h.reason, 'time') AS exit_reason, coalesce(h.us, e.s + {HOLD}) - e.s AS held_us, round(CASE WHEN h.reason = 'tp' THEN e.entry + tp WHEN h.reason IS NULL THEN e.entry ELSE price END, 6) AS exit_price FROM e LEFT JOIN h USING (event_id)""")
def l07_dynamic_exit(t):
    """Exits along a path that purchases re-score."""
    entries, ticks, _ = _exits(t)
    scores = events(t).where("event_type = 'purchase'").select("user_id", F.col("us").alias("known"), (F.col("value") - 50).alias("score"), F.col("event_id").alias("sid"))
    out = labels.dynamic_exit(entries, ticks, scores, BY, "event_id", "start", "side", "entry", "us", "value", "tick_id", HOLD, 5.0, 3.0, "known", "score", "sid", 30.0, 1.5, 3)
    return out.select("event_id", "exit_reason", (F.col("exit_time") - F.col("start")).alias("held_us"), F.round("exit_price", 6).alias("exit_price"))


_EXITS = f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS s, value AS entry FROM events WHERE event_type = 'signup'),
h AS (SELECT e.event_id, e.user_id, e.s, e.entry, k.value AS price, epoch_us(k.ts) AS us, k.event_id AS kid FROM e JOIN events k ON k.user_id = e.user_id
AND epoch_us(k.ts) > e.s AND epoch_us(k.ts) <= e.s + {HOLD} WHERE abs(k.value - e.entry) >= 3 AND (k.value - e.entry >= 5 OR k.value - e.entry <= -3)
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY k.ts, k.event_id) = 1),
x AS (SELECT e.event_id, e.user_id, e.s, e.entry, CASE WHEN h.event_id IS NULL THEN 'time' WHEN price > e.entry THEN 'tp' ELSE 'sl' END AS reason,
coalesce(h.us, e.s + {HOLD}) AS fin, CASE WHEN h.event_id IS NULL THEN e.entry WHEN price > e.entry THEN e.entry + 5 ELSE price END AS price FROM e LEFT JOIN h USING (event_id))"""


@query(_EXITS + " SELECT event_id, reason AS exit_reason, fin - s AS held_us, round(price, 6) AS exit_price FROM x")
def l03_first_breach(t):
    out = _exits(t)[2]
    return out.select("event_id", "exit_reason", (F.col("exit_time") - F.col("start")).alias("held_us"), F.round("exit_price", 6).alias("exit_price"))


@query(_EXITS + f""", c AS (SELECT x.*, k, CAST(round_even({HOLD} / 4 * k, 0) AS BIGINT) + s AS cp, user_id AS u FROM x CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)),
p AS (SELECT c.*, v.value AS seen FROM c ASOF LEFT JOIN (SELECT user_id, epoch_us(ts) AS us, value FROM events) v ON c.u = v.user_id AND c.cp <= v.us),
q AS (SELECT *, CASE WHEN cp >= fin THEN price ELSE least(coalesce(seen, entry), entry + 5) END AS pp FROM p),
d AS (SELECT event_id, k, greatest(0.01, least(0.99, pp / 100)) AS b, greatest(0.01, least(0.99, entry / 100)) AS a FROM q)
SELECT event_id, round(max(CASE WHEN k = 1 THEN ln(b / (1 - b)) - ln(a / (1 - a)) END), 6) AS traj_1,
round(max(CASE WHEN k = 4 THEN ln(b / (1 - b)) - ln(a / (1 - a)) END), 6) AS traj_4, round(avg(ln(b / (1 - b)) - ln(a / (1 - a))), 6) AS traj_mean FROM d GROUP BY event_id""")
def l04_l08_trajectory(t):
    """Checkpoint log-odds changes, capped before and frozen after the exit, and their aggregates."""
    _, ticks, out = _exits(t)
    out = labels.with_trajectory(out, ticks, BY, "event_id", "start", "entry", "us", "value", "tick_id", HOLD, 4, cap=5.0)
    v = F.col("trajectory")
    return out.select("event_id", F.round(v[0], 6).alias("traj_1"), F.round(replay.AGGREGATORS["final"](v), 6).alias("traj_4"), F.round(replay.AGGREGATORS["mean"](v), 6).alias("traj_mean"))


_CHECKPOINTS = ", ".join(f"round(max(CASE WHEN k = {k} THEN x END), 6) AS traj_{k}" for k in range(1, 11))


@query(_EXITS + f""", c AS (SELECT x.*, k, CAST(round_even({HOLD} / 10 * k, 0) AS BIGINT) + s AS cp, user_id AS u FROM x CROSS JOIN (SELECT unnest(range(1, 11)) AS k)),
p AS (SELECT c.*, v.value AS seen FROM c ASOF LEFT JOIN (SELECT user_id, epoch_us(ts) AS us, value FROM events) v ON c.u = v.user_id AND c.cp <= v.us),
q AS (SELECT *, CASE WHEN cp >= fin THEN price ELSE least(coalesce(seen, entry), entry + 5) END AS pp FROM p),
d AS (SELECT event_id, k, greatest(0.01, least(0.99, pp / 100)) AS b, greatest(0.01, least(0.99, entry / 100)) AS a FROM q),
y AS (SELECT event_id, k, ln(b / (1 - b)) - ln(a / (1 - a)) AS x FROM d)
SELECT event_id, {_CHECKPOINTS}, round(max(CASE WHEN k = 10 THEN x END), 6) AS final, round(avg(x), 6) AS mean, round(sum(CASE WHEN k BETWEEN 3 AND 9 THEN x END) / 7, 6) AS mean_3_to_9, round(arg_max(x, (round(abs(x), 9), -k)), 6) AS max_abs FROM y GROUP BY event_id""")
def l04_l08_trajectory_10(t):
    """All ten checkpoints of the trajectory, and every aggregate of them."""
    _, ticks, out = _exits(t)
    out = labels.with_trajectory(out, ticks, BY, "event_id", "start", "entry", "us", "value", "tick_id", HOLD, 10, cap=5.0)
    v = F.col("trajectory")
    return out.select("event_id", *[F.round(v[k], 6).alias(f"traj_{k + 1}") for k in range(10)], *[F.round(f(v), 6).alias(name) for name, f in replay.AGGREGATORS.items()])


def _ledger(t):
    out = _exits(t)[2].select("user_id", "event_id", "start", "exit_time", "entry", "exit_price", "exit_reason")
    return replay.non_overlapping(out, BY, "start", "exit_time", "event_id")


_LEDGER = _EXITS.replace("WITH e", "WITH RECURSIVE e") + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS n FROM x),
f AS (SELECT user_id, n, fin, true AS ok FROM n WHERE n = 1 UNION ALL
SELECT n.user_id, n.n, CASE WHEN n.s >= f.fin THEN n.fin ELSE f.fin END, n.s >= f.fin FROM f JOIN n ON n.user_id = f.user_id AND n.n = f.n + 1),
a AS (SELECT n.* FROM n JOIN f USING (user_id, n) WHERE ok)"""


@query(_LEDGER + " SELECT event_id, reason AS exit_reason FROM a")
def l09_l10_non_overlap(t):
    return _ledger(t).select("event_id", "exit_reason")


@query(_LEDGER + """, g AS (SELECT *, CAST(greatest(1, least(99, round(entry))) AS DECIMAL(9,0)) AS c, CAST(greatest(1, least(99, round(price))) AS DECIMAL(9,0)) AS d FROM a)
SELECT event_id, round(CAST(ceil(0.0175 * 100 * c * (100 - c) / 100) / 100 + ceil(0.07 * 100 * d * (100 - d) / 100) / 100 AS DOUBLE), 2) AS fees, round(price - entry, 6) AS gross FROM g""")
def l12_l13_fees(t):
    """Exact fees of both legs of each accepted trade, and its gross gain."""
    cents = lambda c: X.clip(F.round(F.col(c)), 1, 99)
    hundred = F.lit(100)
    fees = X.fee("0.0175", hundred, cents("entry")) + X.fee("0.07", hundred, cents("exit_price"))
    return _ledger(t).select("event_id", fees.cast("double").alias("fees"), F.round(F.col("exit_price") - F.col("entry"), 6).alias("gross"))


@query(_LEDGER + """, b AS (SELECT user_id % 7 AS u, reason, CASE WHEN entry <= 20 THEN 'low' WHEN entry <= 60 THEN 'mid' ELSE 'high' END AS band, price - entry AS net FROM a)
SELECT 'reason' AS dimension, reason AS bucket, count(*) AS n, round(sum(net), 4) AS total_net, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate FROM b GROUP BY reason
UNION ALL SELECT 'band', band, count(*), round(sum(net), 4), round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) FROM b GROUP BY band
UNION ALL SELECT 'group', CAST(u AS VARCHAR), count(*), round(sum(net), 4), round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 6) FROM b GROUP BY u""")
def a12_f10_bucket_report(t):
    from ..operators.aggs import bucket_report

    rows = _ledger(t).withColumn("net", F.col("exit_price") - F.col("entry"))
    out = bucket_report(rows, {"reason": F.col("exit_reason"), "band": X.ladder(F.col("entry"), [20, 60], ["low", "mid", "high"]), "group": F.col("user_id") % 7}, "net")
    return out.select("dimension", "bucket", "n", F.round("total_net", 4).alias("total_net"), F.round("win_rate", 6).alias("win_rate"))


@query(_LEDGER + """ SELECT count(*) AS n, round(sum(price - entry), 4) AS net, round(avg(fin - s), 2) AS mean_hold, count(*) FILTER (reason = 'tp') AS tp, count(*) FILTER (reason = 'sl') AS sl,
round(median(price - entry), 6) AS median_net, round(quantile_cont(price - entry, 0.9), 6) AS p90_net FROM a""")
def a13_summary(t):
    net = F.col("exit_price") - F.col("entry")
    return _ledger(t).agg(F.count("*").alias("n"), F.round(F.sum(net), 4).alias("net"), F.round(F.avg(F.col("exit_time") - F.col("start")), 2).alias("mean_hold"), F.count_if(F.col("exit_reason") == "tp").alias("tp"), F.count_if(F.col("exit_reason") == "sl").alias("sl"), F.round(F.percentile(net, 0.5), 6).alias("median_net"), F.round(F.percentile(net, 0.9), 6).alias("p90_net"))


@query(_LEDGER + " SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM a GROUP BY reason")
def a13_exit_shares(t):
    """Why trades of the ledger ended, and the share of each reason."""
    return replay.exit_shares(_ledger(t), "exit_reason").withColumn("share", F.round("share", 6))


@query(_EXITS + " SELECT event_id FROM x WHERE fin < s OR (reason = 'time' AND fin <> s + " + str(HOLD) + ")")
def l11_invariants(t):
    """Rows that would break causality: none."""
    out = _exits(t)[2]
    return out.where((F.col("exit_time") < F.col("start")) | ((F.col("exit_reason") == "time") & (F.col("exit_time") != F.col("start") + HOLD))).select("event_id")


@query("""WITH p AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS peak FROM events)
SELECT user_id, event_id, peak FROM p WHERE value <= peak - 60 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def l14_trailing_stop(t):
    return replay.trailing_stop(events(t), "user_id", ["us", "event_id"], F.col("value"), 60.0).select("user_id", "event_id", "peak")


@query("""SELECT o_orderkey, CAST(greatest(1, least(20, trunc((abs(o_totalprice / 100000 - 1) - 0.05) * 40))) AS INT) AS size,
CAST(greatest(1, least(99, round(o_totalprice / 3000) + 5)) AS INT) AS resting FROM orders""")
def l15_l16_sizing(t):
    strength = F.col("o_totalprice") / 100000 - 1
    return t.orders.select("o_orderkey", X.position_size(strength, 0.05, 40, 1, 20).alias("size"), X.clip(F.round(F.col("o_totalprice") / 3000) + 5, 1.0, 99.0).cast("int").alias("resting"))


@query("""WITH f AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'error' THEN -value ELSE 0 END AS amount FROM events),
e AS (SELECT *, sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM f)
SELECT event_id, round(x, 6) AS exposure, max(CAST(x > 100 AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS killed FROM e""")
def l17_exposure(t):
    amount = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "error", -F.col("value")).otherwise(0.0)
    out = replay.exposure(events(t).withColumn("amount", amount), BY, ["us", "event_id"], "amount", 100.0)
    return out.select("event_id", F.round("exposure", 6).alias("exposure"), "killed")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN value WHEN 'signup' THEN value WHEN 'error' THEN -value ELSE 0 END AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT user_id, event_id, n, greatest(0, a) AS x FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(0, g.x + e.a) FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1),
s AS (SELECT *, sum(a) OVER (ORDER BY ts, event_id) AS s FROM e), t AS (SELECT *, s - least(0, min(s) OVER (ORDER BY ts, event_id)) AS total FROM s)
SELECT event_id, round(x, 6) AS game_exposure, round(total, 6) AS total_exposure, a > 0 AND (x > 300 OR total > 1000) AS refused FROM t JOIN g USING (event_id)""")
def l17_ledger(t):
    """Open exposure per user and in all, never below 0: purchases and signups fill, errors exit."""
    kind, v = F.col("event_type"), F.col("value").cast("decimal(18,6)")
    amount = F.when(kind.isin("purchase", "signup"), v).when(kind == "error", -v).otherwise(F.lit(0).cast("decimal(18,6)"))
    out = replay.ledger(events(t), "user_id", ["us", "event_id"], amount, F.floor(F.col("us") / (6 * 3_600_000_000)), 300.0, 1000.0)
    return out.select("event_id", F.col("game_exposure").cast("double").alias("game_exposure"), F.col("total_exposure").cast("double").alias("total_exposure"), "refused")


@query("""WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0 END AS a, CASE event_type WHEN 'error' THEN value - 60 ELSE 0 END AS g FROM events),
s AS (SELECT *, sum(a) OVER w AS exposure, sum(g) OVER w AS realized FROM e WINDOW w AS (PARTITION BY day ORDER BY ts, event_id))
SELECT event_id, round(exposure, 6) AS exposure, round(realized, 6) AS realized, max(CAST(exposure > 400 OR realized < -200 AS INT)) OVER (PARTITION BY day ORDER BY ts, event_id) = 1 AS killed FROM s""")
def l17_daily_limits(t):
    """Each day's exposure and realized gain after every event, and whether a limit has stopped the day."""
    kind, v = F.col("event_type"), F.col("value").cast("decimal(18,6)")
    zero = F.lit(0).cast("decimal(18,6)")
    rows = events(t).withColumns({"day": F.to_date(F.timestamp_micros("us")), "a": F.when(kind == "purchase", v).when(kind == "error", -v).otherwise(zero), "g": F.when(kind == "error", v - 60).otherwise(zero)})
    out = replay.exposure_ledger(rows, "day", ["us", "event_id"], "a", "g", 400.0, 200.0)
    return out.select("event_id", F.col("exposure").cast("double").alias("exposure"), F.col("realized").cast("double").alias("realized"), "killed")


@query(_EXITS.replace("WITH e", "WITH RECURSIVE e") + """, n AS (SELECT *, config, row_number() OVER (PARTITION BY config, user_id ORDER BY s, event_id) AS n FROM x CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS config) WHERE entry >= config * 20),
f AS (SELECT config, user_id, n, fin, true AS ok FROM n WHERE n = 1 UNION ALL
SELECT n.config, n.user_id, n.n, CASE WHEN n.s >= f.fin THEN n.fin ELSE f.fin END, n.s >= f.fin FROM f JOIN n ON n.config = f.config AND n.user_id = f.user_id AND n.n = f.n + 1)
SELECT config, n, win_rate, total_net, exits_tp, exits_sl, exits_time, median_move, ok AND row_number() OVER (ORDER BY ok DESC, total_net DESC, config) = 1 AS winner FROM (SELECT config, count(*) AS n, round(avg(CAST(price > entry AS INT)), 6) AS win_rate, round(sum(price - entry), 4) AS total_net, count(*) FILTER (reason = 'tp') AS exits_tp, count(*) FILTER (reason = 'sl') AS exits_sl, count(*) FILTER (reason = 'time') AS exits_time,
round(median(abs(price - entry)), 6) AS median_move, count(*) >= 50 AND avg(CAST(price > entry AS INT)) >= 0.45 AS ok FROM n JOIN f USING (config, user_id, n) WHERE ok GROUP BY config)""")
def a14_sweep_winner(t):
    """Four settings, what each earned, why its trades ended, and which one wins."""
    out = _exits(t)[2].select("user_id", "event_id", "start", "exit_time", "entry", "exit_price", "exit_reason")
    grid = t.spark.range(4).select(F.col("id").cast("int").alias("config"))
    rows = replay.sweep(out, grid, F.col("entry") >= F.col("config") * 20, BY, "start", "exit_time", "event_id")
    net = F.col("exit_price") - F.col("entry")
    best = replay.sweep_summary(rows, "config", net, net, "exit_reason", ["tp", "sl", "time"])
    return best.withColumns({"win_rate": F.round("win_rate", 6), "total_net": F.round("total_net", 4), "median_move": F.round("median_move", 6)})


@query(_EXITS.replace("WITH e", "WITH RECURSIVE e") + """, n AS (SELECT *, config, row_number() OVER (PARTITION BY config, user_id ORDER BY s, event_id) AS n FROM x CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS config) WHERE entry >= config * 20),
f AS (SELECT config, user_id, n, fin, true AS ok FROM n WHERE n = 1 UNION ALL
SELECT n.config, n.user_id, n.n, CASE WHEN n.s >= f.fin THEN n.fin ELSE f.fin END, n.s >= f.fin FROM f JOIN n ON n.config = f.config AND n.user_id = f.user_id AND n.n = f.n + 1)
SELECT config, count(*) AS n, round(sum(price - entry), 4) AS net FROM n JOIN f USING (config, user_id, n) WHERE ok GROUP BY config""")
def l22_a14_sweep(t):
    """Four settings replayed in one job."""
    out = _exits(t)[2].select("user_id", "event_id", "start", "exit_time", "entry", "exit_price")
    grid = t.spark.range(4).select(F.col("id").cast("int").alias("config"))
    rows = replay.sweep(out, grid, F.col("entry") >= F.col("config") * 20, BY, "start", "exit_time", "event_id")
    return rows.groupBy("config").agg(F.count("*").alias("n"), F.round(F.sum(F.col("exit_price") - F.col("entry")), 4).alias("net"))
