"""Point-in-time window features over the event log and the orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import windows as W
from .q_joins import HOUR, events
from .registry import query

BY, ORDER = ["user_id"], ["us", "event_id"]
_W = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""SELECT event_id, round(coalesce(sum(value) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 9) AS sum_5,
round(coalesce(avg(value) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 15), 9) AS avg_10,
round(coalesce(avg(value) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING), 1), 9) AS avg_prev_5,
round(coalesce(avg(value) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 15), 9) AS avg_to_date,
row_number() OVER ({_W}) - 1 AS elapsed FROM events""")
def w01_w05_rolling(t):
    w, v = W.sequence_of(BY, ORDER), F.col("value")
    return events(t).select("event_id", F.round(W.rolling("sum", v, w, -5), 9).alias("sum_5"), F.round(W.rolling("avg", v, w, -10, -1, 15.0), 9).alias("avg_10"), F.round(W.rolling("avg", v, w, -10, -6, 1.0), 9).alias("avg_prev_5"), F.round(W.before("avg", v, w, 15.0), 9).alias("avg_to_date"), (F.row_number().over(w) - 1).cast("long").alias("elapsed"))


@query(f"""WITH s AS (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') AND value > 0 THEN event_type END AS side FROM events),
p AS (SELECT *, last_value(side IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM s),
i AS (SELECT *, sum(CASE WHEN side IS NOT NULL AND (prior IS NULL OR prior <> side) THEN 1 ELSE 0 END) OVER ({_W}) AS island FROM p),
c AS (SELECT *, count(side) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS len,
sum(CASE WHEN side IS NOT NULL THEN value END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS pts FROM i)
SELECT event_id, coalesce(prior, '') AS streak_side,
coalesce(last_value(CASE WHEN side IS NOT NULL THEN len END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak_length,
round(coalesce(last_value(CASE WHEN side IS NOT NULL THEN pts END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS streak_points FROM c""")
def w02_streak(t):
    """The run of purchases or of signups before each event: side, length, points."""
    scoring = F.when(F.col("event_type").isin("purchase", "signup"), F.col("value"))
    out = W.with_streak(events(t), BY, ORDER, "event_type", scoring)
    return out.select("event_id", "streak_side", "streak_length", F.round("streak_points", 6).alias("streak_points"))


@query(f"""SELECT event_id, CASE WHEN g > 0 AND g < 21600000000 THEN g END AS gap_us,
round(coalesce(avg(CASE WHEN g > 0 AND g < 21600000000 THEN g END) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 15), 3) AS pace
FROM (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER ({_W})) AS g FROM events)""")
def w03_w04_durations(t):
    w = W.sequence_of(BY, ORDER)
    gap = F.col("us") - F.lag("us").over(w)
    rows = events(t).withColumn("gap_us", F.when((gap > 0) & (gap < 6 * HOUR), gap))
    return rows.select("event_id", "gap_us", F.round(W.rolling("avg", F.col("gap_us"), w, -10, -1, 15.0), 3).alias("pace"))


@query(f"""SELECT event_id, coalesce(avg(CASE WHEN event_type = 'view' THEN value END) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.5) >= 0.5 AS lasting,
round(coalesce(avg(CASE WHEN event_type = 'view' THEN value END) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 1)
- coalesce(avg(CASE WHEN event_type = 'view' THEN value END) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING), 1), 6) AS trend FROM events""")
def w06_w07_masked_trend(t):
    w, x = W.sequence_of(BY, ORDER), F.when(F.col("event_type") == "view", F.col("value"))
    return events(t).select("event_id", (W.rolling("avg", x, w, -5, -1, 0.5) >= 0.5).alias("lasting"), F.round(W.rolling("avg", x, w, -5, -1, 1.0) - W.rolling("avg", x, w, -10, -6, 1.0), 6).alias("trend"))


@query(f"SELECT event_id, coalesce(lag(event_type) OVER ({_W}) <> event_type, false) AS just_changed FROM events")
def w08_changed(t):
    return events(t).select("event_id", W.changed(F.col("event_type"), W.sequence_of(BY, ORDER)).alias("just_changed"))


@query("""WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY o_custkey ORDER BY day), day) AS gap FROM d)
SELECT o_custkey, CAST(day AS VARCHAR) AS day, CAST(coalesce(least(gap - 1, 7), 3) AS INT) AS rest, coalesce(gap = 1, false) AS back_to_back FROM g""")
def w09_w31_rest(t):
    days = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    return W.rest_days(days, "o_custkey", "day").select("o_custkey", F.col("day").cast("string").alias("day"), F.col("rest").cast("int").alias("rest"), "back_to_back")


@query(f"""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), value DESC, event_id) AS seq,
last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def w10_w11_sequence_fill(t):
    rows = events(t).withColumn("day", F.to_date("ts"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("day", F.desc("value"), "event_id"))
    fill = W.forward_fill(F.when(F.col("event_type") == "purchase", F.col("value")), W.sequence_of(BY, ORDER))
    return rows.select("event_id", seq.cast("long").alias("seq"), fill.alias("last_purchase"))


@query(f"""SELECT event_id, count(*) FILTER (event_type = 'error') OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS errors,
count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS errors_today,
greatest(0, 5 - count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS until_limit FROM events""")
def w12_w13_running_counts(t):
    rows = events(t).withColumn("day", F.to_date("ts"))
    one = (F.col("event_type") == "error").cast("long")
    total = W.before("sum", one, W.sequence_of(BY, ORDER))
    today = W.before("sum", one, W.sequence_of([*BY, "day"], ORDER))
    return rows.select("event_id", total.alias("errors"), today.alias("errors_today"), F.greatest(F.lit(0), 5 - today).alias("until_limit"))


@query(f"""WITH n AS (SELECT *, row_number() OVER ({_W}) AS pos FROM events)
SELECT event_id, coalesce(pos - max(CASE WHEN event_type = 'error' THEN pos END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS since_error,
coalesce(bool_or(event_type = 'error') OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS error_in_3 FROM n""")
def w15_rows_since(t):
    w, e = W.sequence_of(BY, ORDER), F.col("event_type") == "error"
    rows = W.with_rows_since(events(t), "since_error", e, BY, ORDER)
    return rows.select("event_id", F.col("since_error").cast("long").alias("since_error"), F.coalesce(F.bool_or(e).over(w.rowsBetween(-3, -1)), F.lit(False)).alias("error_in_3"))


@query(f"""WITH c AS (SELECT user_id, event_type, event_id, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, max(n) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most_by_any FROM c""")
def w14_w16_worst_state(t):
    """Largest running count that any kind has reached before each row."""
    each = F.count("*").over(Window.partitionBy("user_id", "event_type").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = events(t).withColumn("n", each)
    return rows.select("event_id", F.max("n").over(W.sequence_of(BY, ORDER).rowsBetween(Window.unboundedPreceding, -1)).alias("most_by_any"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey, o_orderkey, n, CAST(100000.0 AS DOUBLE) AS before, greatest(0.05, 2.0 / 3) * o_totalprice + (1 - greatest(0.05, 2.0 / 3)) * 100000.0 AS level FROM o WHERE n = 1
UNION ALL SELECT o.o_custkey, o.o_orderkey, o.n, f.level, greatest(0.05, 2.0 / (o.n + 2)) * o.o_totalprice + (1 - greatest(0.05, 2.0 / (o.n + 2))) * f.level FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1)
SELECT o_orderkey, round(before, 4) AS ewma FROM f""")
def w17_a25_adaptive_average(t):
    """The customer's adaptive average of order prices before each order."""
    out = W.with_ewma(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "ewma", 100000.0)
    return out.select("o_orderkey", F.round("ewma", 4).alias("ewma"))


@query("""WITH g AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY ALL),
c AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_custkey, CAST(day AS VARCHAR) AS day, round(coalesce(cn, 0) / (coalesce(cn, 0) + 50.0) * coalesce(cs / cn, 0) + (1 - coalesce(cn, 0) / (coalesce(cn, 0) + 50.0)) * 100000, 8) AS rating FROM c""")
def w18_w19_blended_rating(t):
    from ..functions.exprs import blend

    g = t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    w = W.sequence_of(["o_custkey"], ["day"])
    cs, cn = W.before("sum", F.col("s"), w, 0.0), W.before("sum", F.col("n"), w)
    return g.withColumn("cs", cs).withColumn("cn", cn).select("o_custkey", F.col("day").cast("string").alias("day"), F.round(blend(F.col("cn"), F.coalesce(F.try_divide("cs", "cn"), F.lit(0.0)), F.lit(100000.0)), 8).alias("rating"))


@query(f"""WITH c AS (SELECT *, sum(value) OVER ({_W}) - 2 * CASE WHEN event_type = 'error' THEN value ELSE 0 END AS counter FROM events)
SELECT event_id, round(greatest(counter - coalesce(lag(counter) OVER ({_W}), counter), 0), 6) AS increment, round(coalesce(value - lag(value) OVER ({_W}), 0), 6) AS diff FROM c""")
def w21_w27_increments(t):
    w = W.sequence_of(BY, ORDER)
    rows = events(t).withColumn("counter", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 2 * F.when(F.col("event_type") == "error", F.col("value")).otherwise(0))
    return rows.select("event_id", F.round(W.increments(F.col("counter"), w), 6).alias("increment"), F.round(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)), 6).alias("diff"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us, max(event_id) AS event_id, sum(value) AS value FROM events GROUP BY ALL),
v AS (SELECT *, sum(value) OVER w AS sum_6h, value - first_value(value) OVER w AS velocity FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW))
SELECT event_id, round(sum_6h, 6) AS sum_6h, round(velocity, 6) AS velocity,
round(velocity - first_value(velocity) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW), 6) AS acceleration FROM v""")
def w22_w24_time_windows(t):
    """Left-open time frames: sum, change since the window's first value, and that change's change."""
    rows = events(t).groupBy("user_id", "us").agg(F.max("event_id").alias("event_id"), F.sum("value").alias("value"))
    us = F.col("us")
    rows = rows.withColumn("velocity", F.col("value") - W.trailing("first", F.col("value"), BY, us, 6 * HOUR))
    rows = rows.withColumn("sum_6h", W.trailing("sum", F.col("value"), BY, us, 6 * HOUR))
    return rows.select("event_id", F.round("sum_6h", 6).alias("sum_6h"), F.round("velocity", 6).alias("velocity"), F.round(F.col("velocity") - W.trailing("first", F.col("velocity"), BY, us, 6 * HOUR), 6).alias("acceleration"))


@query(f"""SELECT event_id, epoch_us(ts) - epoch_us(coalesce(last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(ts) OVER (PARTITION BY user_id))) AS since_us,
round(value - last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS off_last,
coalesce(last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 50) AS carried FROM events""")
def w25_w28_since_and_carry(t):
    w, bought = W.sequence_of(BY, ORDER), F.col("event_type") == "purchase"
    carried = F.last(F.when(F.col("value") > 50, F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events(t).select("event_id", W.since_last(bought, F.col("us"), w).alias("since_us"), F.round(F.col("value") - W.forward_fill(F.when(bought, F.col("value")), w), 6).alias("off_last"), F.coalesce(carried, F.lit(50.0)).alias("carried"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5")
def w30_top_per_group(t):
    from ..operators.joins import best_per_group

    return best_per_group(t.events, ["user_id"], [F.desc("value"), F.asc("event_id")], 5).select("user_id", "event_id", "value")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey, o_orderkey, n, CAST(100000.0 AS DOUBLE) AS before, greatest(0.05, 2.0 / 3) * o_totalprice + (1 - greatest(0.05, 2.0 / 3)) * 100000.0 AS level FROM o WHERE n = 1
UNION ALL SELECT o.o_custkey, o.o_orderkey, o.n, f.level, greatest(0.05, 2.0 / (o.n + 2)) * o.o_totalprice + (1 - greatest(0.05, 2.0 / (o.n + 2))) * f.level FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1),
a AS (SELECT o_orderkey, avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5 FROM o)
SELECT o_orderkey, round(coalesce(a5 - before, 0), 4) AS form FROM f JOIN a USING (o_orderkey)""")
def w32_form(t):
    """Mean of the customer's last five prices less the adaptive average, both before the order."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    w = W.sequence_of(["o_custkey"], ["o_orderdate", "o_orderkey"])
    rows = rows.withColumn("recent", F.avg("o_totalprice").over(w.rowsBetween(-5, -1)))
    out = W.with_ewma(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "ewma", 100000.0)
    return out.select("o_orderkey", F.round(F.coalesce(F.col("recent") - F.col("ewma"), F.lit(0.0)), 4).alias("form"))
