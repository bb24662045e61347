"""Aggregates, distributions, drift, metrics, candles, checks; scalar functions and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import aggs, ridge
from .q_joins import events
from .registry import query


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_discount) AS hi,
count(DISTINCT l_orderkey) AS orders, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_partkey END) AS big_parts, count(*) FILTER (l_tax > 0.05) AS taxed FROM lineitem GROUP BY 1""")
def a01_a02_aggregates(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("p"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("big_parts"), F.count_if(F.col("l_tax") > 0.05).alias("taxed"))


@query("""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, bool_or(event_type ILIKE '%ERR%') AS had_error, count(*) FILTER (event_type = 'view') AS views,
count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY ALL""")
def a03_a04_flags(t):
    return t.events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.bool_or(F.col("event_type").ilike("%ERR%")).alias("had_error"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("""WITH g AS (SELECT l_orderkey, l_returnflag AS side, sum(l_quantity) AS pts, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL)
SELECT a.l_orderkey, a.side, round(100 * a.pts / a.n, 4) AS off_rating, round(100 * b.pts / b.n, 4) AS def_rating FROM g a LEFT JOIN g b ON a.l_orderkey = b.l_orderkey AND a.side <> b.side""")
def a05_a06_two_sided_ratings(t):
    """Rate of each side per hundred, and the other side's, without a self-join."""
    g = t.lineitem.where("l_returnflag in ('A', 'R')").groupBy("l_orderkey", F.col("l_returnflag").alias("side")).agg(F.sum("l_quantity").alias("pts"), F.count("*").alias("n"))
    rate = 100 * F.col("pts") / F.col("n")
    other = F.coalesce(F.lag(rate).over(Window.partitionBy("l_orderkey").orderBy("side")), F.lead(rate).over(Window.partitionBy("l_orderkey").orderBy("side")))
    return g.select("l_orderkey", "side", F.round(rate, 4).alias("off_rating"), F.round(other, 4).alias("def_rating"))


@query("""SELECT round(coalesce(avg(r), 1), 4) AS league FROM (SELECT l_orderkey, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS r FROM lineitem GROUP BY 1)""")
def a07_league_average(t):
    per = t.lineitem.groupBy("l_orderkey").agg((F.sum("l_extendedprice") / F.nullif(F.sum("l_quantity"), F.lit(0.0))).alias("r"))
    return per.agg(F.round(F.coalesce(F.avg("r"), F.lit(1.0)), 4).alias("league"))


@query("""SELECT event_id, round(coalesce(sum(value) FILTER (event_type = 'purchase') OVER w, 0), 6) AS spent, count(*) FILTER (event_type IN ('purchase', 'error')) OVER w AS tries,
round(coalesce(count(*) FILTER (event_type = 'purchase') OVER w / nullif(count(*) FILTER (event_type IN ('purchase', 'error')) OVER w, 0), 0), 3) AS rate FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def a09_cumulative_box(t):
    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("event_type")
    made, tries = F.count_if(kind == "purchase").over(w), F.count_if(kind.isin("purchase", "error")).over(w)
    return events(t).select("event_id", F.round(F.coalesce(F.sum(F.when(kind == "purchase", F.col("value"))).over(w), F.lit(0.0)), 6).alias("spent"), tries.alias("tries"), F.round(F.coalesce(made / F.nullif(tries, F.lit(0)), F.lit(0.0)), 3).alias("rate"))


@query("""WITH d AS (SELECT DISTINCT o_orderpriority, o_orderstatus, o_custkey FROM orders), r AS (SELECT o_orderpriority, o_orderstatus, avg(c_acctbal) AS m FROM d JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT o_orderpriority, round(max(CASE WHEN o_orderstatus = 'F' THEN m END) - max(CASE WHEN o_orderstatus = 'O' THEN m END), 4) AS edge FROM r GROUP BY 1""")
def a10_roster_edge(t):
    d = t.orders.select("o_orderpriority", "o_orderstatus", "o_custkey").distinct().join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    m = d.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("c_acctbal"))
    return m.select("o_orderpriority", F.round(F.col("F") - F.col("O"), 4).alias("edge"))


_DIST = """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std, round(quantile_cont({c}, 0.1), 4) AS p10, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.9), 4) AS p90 FROM lineitem"""


@query(" UNION ALL ".join(_DIST.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def a15_distribution(t):
    out = aggs.distribution(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("column", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "p10", "p50", "p90")])


@query("""WITH r AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem WHERE l_returnflag = 'N'),
c AS (SELECT avg(l_quantity) AS m, avg(l_extendedprice) AS m2 FROM lineitem WHERE l_returnflag = 'R'),
z AS (SELECT 'l_quantity' AS "column", (c.m - r.m) / r.s AS z FROM r, c UNION ALL SELECT 'l_extendedprice', (c.m2 - r.m2) / r.s2 FROM r, c)
SELECT "column", round(z, 6) AS sigmas, CASE WHEN abs(z) < 0.5 THEN 'ok' WHEN abs(z) < 1 THEN 'watch' WHEN abs(z) < 2 THEN 'warn' ELSE 'alert' END AS level FROM z""")
def a27_a28_drift(t):
    part = lambda flag: aggs.distribution(t.lineitem.where(F.col("l_returnflag") == flag), ["l_quantity", "l_extendedprice"])
    return aggs.drift(part("N"), part("R")).select("column", F.round("sigmas", 6).alias("sigmas"), "level")


@query("""WITH s AS (SELECT round(o_totalprice, -3) AS score, sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS tp, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS pr FROM s)
SELECT round(sum(pr * tp) / sum(tp), 6) AS average_precision FROM p""")
def a22_average_precision(t):
    rows = t.orders.select(F.round("o_totalprice", -3).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return aggs.average_precision(rows, "score", "y").select(F.round("average_precision", 6).alias("average_precision"))


@query("""WITH s AS (SELECT quality, least(0.99, greatest(0.01, n_chars / 5000.0)) AS p FROM labels JOIN documents USING (doc_id))
SELECT round(avg((p - quality) * (p - quality)), 6) AS brier, round(sqrt(avg((p - quality) * (p - quality))), 6) AS rmse, round(avg(CASE WHEN (p >= 0.5) = (quality = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM s""")
def a22_l21_brier(t):
    p = X.clip(F.col("n_chars") / 5000.0, 0.01, 0.99)
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("quality", p.alias("p"))
    sq = (F.col("p") - F.col("quality")) * (F.col("p") - F.col("quality"))
    return rows.agg(F.round(F.avg(sq), 6).alias("brier"), F.round(F.sqrt(F.avg(sq)), 6).alias("rmse"), F.round(F.avg(((F.col("p") >= 0.5) == (F.col("quality") == 1)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END, 6) AS scale FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax")))
def a23_scaler(t):
    return aggs.scaler(t.lineitem, ["l_quantity", "l_discount", "l_tax"]).select("column", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("""SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY ALL""")
def a24_candles(t):
    out = aggs.candles(t.events, ["user_id"], "ts", "value", "event_id", "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, min(epoch_us(ts)) AS s, max(epoch_us(ts)) AS f FROM events WHERE event_type = 'view' GROUP BY 1), g AS (SELECT user_id, min(epoch_us(ts)) AS s, max(epoch_us(ts)) AS f FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, e.s - g.s AS lead, round(CASE WHEN e.f > e.s THEN greatest(least(e.f, g.f) - greatest(e.s, g.s), 0) / (e.f - e.s) ELSE 1 END, 6) AS coverage FROM e JOIN g USING (user_id)""")
def a19_overlap(t):
    e = events(t)
    out = aggs.overlap(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "us", "us")
    return out.select("user_id", "lead", F.round("coverage", 6).alias("coverage"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} = 0) AS zeros, round(count(*) FILTER ({c} = 0) / count(*), 6) AS share_zero FROM lineitem""" for c in ("l_quantity", "l_discount", "l_tax")))
def a20_null_report(t):
    return aggs.null_report(t.lineitem, ["l_quantity", "l_discount", "l_tax"]).withColumn("share_zero", F.round("share_zero", 6))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def o09_fan_out(t):
    return aggs.fan_out(t.lineitem, ["l_orderkey"])


@query("""WITH p AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
c AS (SELECT event_type, k, count(*) AS n FROM p GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM c""")
def a16_a17_histogram(t):
    """Share of each blocker (a field of nested JSON) within its kind."""
    k = F.get_json_object("props", "$.k").cast("int")
    n = t.events.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'error') AS skip,
count(*) FILTER (event_type = 'view') = count(*) FILTER (event_type IN ('click', 'error')) AS reconciles FROM events GROUP BY 1""")
def a18_reconciliation(t):
    c = lambda *k: F.count_if(F.col("event_type").isin(*k))
    return t.events.groupBy("user_id").agg(c("view").alias("a"), c("click").alias("b"), c("error").alias("skip"), (c("view") == c("click", "error")).alias("reconciles"))


@query("""SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1""")
def a29_one_per_key(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1""")
def a30_nested_values(t):
    k = F.from_json("props", "k int")["k"]
    return t.events.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query()
def a21_bootstrap(t):
    """Mean order price with a 95 percent interval over customers as clusters."""
    return aggs.cluster_bootstrap(t.orders, "o_custkey", "o_totalprice", 10_000)


@query()
def a26_sparse_ridge(t):
    """Ratings of all suppliers from the orders that they filled together: for orders that were
    returned in part suppliers count -1, else 1; refitted every fifth month on all months before."""
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    crews = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("k"), sign.alias("v"))).alias("crew"))
    date = F.to_date("o_orderdate")
    rows = t.orders.join(crews, F.col("o_orderkey") == F.col("l_orderkey")).select((F.year(date) * 12 + F.month(date)).alias("month"), "crew", (F.col("o_totalprice") / 1000).alias("y"))
    out = ridge.sparse_rolling_ridge(rows, "month", F.col("crew"), "y", alpha=100.0, half_life=24.0, every=5)
    return out.select("as_of", "feature", F.round("coefficient", 6).alias("coefficient"), "n")


@query()
def a26_rolling_ridge(t):
    """Price on quantity, discount and tax, refitted along the ship dates within each return flag."""
    rows = t.lineitem.withColumn("day", F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01")))
    return ridge.rolling_ridge(rows, "day", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", every=5, by="l_returnflag")


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 1.08 WHEN event_type = 'purchase' THEN 1.26 END AS xp,
round(1 - sqrt(greatest(0, least(1, value / 48))), 6) AS leverage, round((value - 50) / sqrt(greatest(value / 10, 0.5)), 6) AS z,
round(1 / (1 + exp(-greatest(-20, least(20, (abs(value - 50) - 15) / 5)))) * (1 - greatest(0, least(1, value / 48))), 6) AS risk,
round(least(user_id / (user_id + 40.0), 0.85), 6) AS weight, round(ln(1 + greatest(least(user_id, event_id), 0)), 6) AS confidence,
CASE event_type WHEN 'click' THEN value WHEN 'view' THEN -value ELSE 0 END AS signed FROM events""")
def m01_m03_m05_m09_m11_scalars(t):
    v = F.col("value")
    shot = F.when(F.col("event_type") == "purchase", F.when(v > 50, 3).otherwise(2))
    return t.events.select("event_id", X.expected_points(shot, F.lit(0.0)).alias("xp"), F.round(X.time_leverage(v), 6).alias("leverage"), F.round(X.lead_z(v - 50, v / 10), 6).alias("z"), F.round(X.decided_risk(v - 50, v), 6).alias("risk"), F.round(X.shrink_weight(F.col("user_id")), 6).alias("weight"), F.round(X.confidence(F.col("user_id"), F.col("event_id")), 6).alias("confidence"), X.signed(F.col("event_type"), v, "click", "view").cast("double").alias("signed"))


@query("""WITH m AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS k, list(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, substr(md5(array_to_string(k, ',')), 1, 12) AS lineup_id, list_max(q) AS best, list_min(q) AS worst, round(list_sum(q), 4) AS total,
len(list_filter(k, lambda x: x <= 5)) > 0 AS star, len(k) AS members FROM m""")
def m16_m17_x05_sets(t):
    """Ids and statistics of the members of an array."""
    m = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("k"), F.collect_list("l_quantity").alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    return m.select("l_orderkey", X.set_id(F.col("k")).alias("lineup_id"), F.array_max("q").alias("best"), F.array_min("q").alias("worst"), F.round(total, 4).alias("total"), F.exists("k", lambda x: x <= 5).alias("star"), F.size("k").cast("long").alias("members"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS VARCHAR) AS day, 'BBB' AS home, CASE WHEN o_orderkey % 2 = 0 THEN 'AAA' ELSE 'BBB' END AS team, CAST(o_orderkey % 9 AS INT) AS points, o_orderkey % 9 <= 3 AS near_even FROM orders")
def f01_f05_f19_tickers(t):
    """Tickers built from each order's day and key, and parsed again."""
    team = F.when(F.col("o_orderkey") % 2 == 0, "AAA").otherwise("BBB")
    ticker = F.concat(F.lit("KXG-"), F.upper(F.date_format(F.add_months("o_orderdate", 240), "yyMMMdd")), F.lit("AAABBB-"), team, (F.col("o_orderkey") % 9).cast("string"))
    p = X.parse_ticker(ticker)
    return t.orders.select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p.day").cast("string").alias("day"), "p.home", "p.team", "p.points", (F.col("p.points") <= 3).alias("near_even"))


@query("""SELECT event_id, CASE WHEN NOT value > 5 THEN 'price' WHEN event_type = 'error' THEN 'kind' WHEN user_id % 3 = 0 THEN 'user' END AS blocked FROM events""")
def f09_gate_chain(t):
    gates = [("price", F.col("value") > 5), ("kind", F.col("event_type") != "error"), ("user", F.col("user_id") % 3 != 0)]
    return t.events.select("event_id", X.first_blocking(gates).alias("blocked"))


@query("""SELECT event_id, abs(value - 50) > 20 AS blowout, abs(value - 50) > 20 AND user_id % 4 = 3 AND value < 30 AS garbage FROM events WHERE event_type <> 'error' AND value BETWEEN 5 AND 95""")
def f06_f08_f11_regime(t):
    d = F.abs(F.col("value") - 50)
    rows = t.events.where((F.col("event_type") != "error") & F.col("value").between(5, 95))
    return rows.select("event_id", (d > 20).alias("blowout"), ((d > 20) & (F.col("user_id") % 4 == 3) & (F.col("value") < 30)).alias("garbage"))


@query("""SELECT o_orderkey, coalesce(CAST(o_orderkey % 2 = 0 AS DOUBLE), 0) AS flag, coalesce(o_totalprice, 0) AS o_totalprice, CAST(0 AS DOUBLE) AS gone,
CASE WHEN o_orderdate < DATE '1995-01-01' THEN 'train' WHEN o_orderdate < DATE '1997-01-01' THEN 'val' ELSE 'test' END AS split,
CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS season FROM orders""")
def f12_f15_matrix(t):
    day = F.col("o_orderdate")
    split = F.when(day < "1995-01-01", "train").when(day < "1997-01-01", "val").otherwise("test")
    season = F.when(F.month(day) >= 10, F.year(day)).otherwise(F.year(day) - 1)
    return t.orders.select("o_orderkey", F.coalesce((F.col("o_orderkey") % 2 == 0).cast("double"), F.lit(0.0)).alias("flag"), F.coalesce("o_totalprice", F.lit(0.0)).alias("o_totalprice"), F.lit(0.0).alias("gone"), split.alias("split"), season.cast("long").alias("season"))


@query("SELECT user_id, arg_min(event_id, (abs(value - 50), event_id)) AS best FROM events WHERE value BETWEEN 40 AND 60 GROUP BY 1")
def f16_best_quote(t):
    return t.events.where("value between 40 and 60").groupBy("user_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("value") - 50), "event_id")).alias("best"))


@query("""SELECT event_id, CAST(floor(value / 60) AS INT) * 60 + round(value - floor(value / 60) * 60, 2) AS secs, CAST(90 + user_id % 15 AS DOUBLE) AS minute FROM events""")
def d01_d08_clocks(t):
    """Clock texts written from values and read back."""
    v = F.col("value")
    iso = F.concat(F.lit("PT"), F.lpad(F.floor(v / 60).cast("string"), 2, "0"), F.lit("M"), F.format_string("%05.2f", v - F.floor(v / 60) * 60), F.lit("S"))
    shown = F.concat(F.lit("90'+"), (F.col("user_id") % 15).cast("string"), F.lit("'"))
    return t.events.select("event_id", X.clock_seconds(iso).alias("secs"), X.display_minutes(shown).alias("minute"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, lower(substr(url, 1, 4)) AS scheme, length(html) AS n, CAST(regexp_extract(url, '([0-9]+)', 1) AS VARCHAR) AS first_number FROM pages""")
def x02_x06_text(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.lower(F.substring("url", 1, 4)).alias("scheme"), F.length("html").cast("long").alias("n"), F.regexp_extract("url", "([0-9]+)", 1).alias("first_number"))


@query("""SELECT 'rows' AS check, count(*) AS n FROM lineitem UNION ALL SELECT 'nulls_l_shipdate', count(*) FILTER (l_shipdate IS NULL) FROM lineitem UNION ALL SELECT 'broken_quantity', count(*) FILTER (l_quantity < 25) FROM lineitem
UNION ALL SELECT 'broken_price', count(*) FILTER (l_extendedprice < 100 * l_quantity) FROM lineitem UNION ALL SELECT 'least_l_linenumber', min(l_linenumber) FROM lineitem UNION ALL SELECT 'greatest_l_linenumber', max(l_linenumber) FROM lineitem""")
def a20_quality_suite(t):
    """Nulls, identities and bounds of lineitem, counted in passing while it is read once."""
    rows, seen = aggs.quality_suite(t.lineitem, ["l_shipdate"], {"quantity": F.col("l_quantity") >= 25, "price": F.col("l_extendedprice") >= 100 * F.col("l_quantity")}, ["l_linenumber"])
    rows.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([(k, int(v)) for k, v in seen.get.items() if not k.startswith("p")], "check string, n long")


@query("""WITH w AS (SELECT CASE WHEN NOT coalesce(l_returnflag = 'N', false) THEN 'flag' WHEN NOT coalesce(l_quantity > 10, false) THEN 'small' WHEN NOT coalesce(l_discount < 0.05, false) THEN 'discount' END AS why FROM lineitem)
SELECT coalesce('dropped_' || why, 'kept') AS what, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT 'rows', count(*) FROM w""")
def f06_regime_filter(t):
    """How many rows a chain of conditions keeps, and which condition drops the others."""
    rows, seen = aggs.counted_filter(t.lineitem, {"flag": F.col("l_returnflag") == "N", "small": F.col("l_quantity") > 10, "discount": F.col("l_discount") < 0.05})
    rows.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([(k, int(v)) for k, v in seen.get.items()], "what string, n long")


_OHLC = ", ".join(f"arg_min({c}, (ts, event_id)) AS {n}_open, max({c}) AS {n}_high, min({c}) AS {n}_low, arg_max({c}, (ts, event_id)) AS {n}_close" for n, c in (("bid", "bid"), ("ask", "ask"), ("price", "price")))


@query(f"""WITH q AS (SELECT *, CAST(floor(value) AS INT) AS bid, CAST(floor(value) + event_id % 4 AS INT) AS ask, CASE WHEN event_type = 'purchase' THEN CAST(round(value) AS INT) END AS price FROM events)
SELECT user_id, epoch_us(time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY) AS end_us, {_OHLC}, CAST(sum(event_id % 7) AS BIGINT) AS volume, CAST(arg_max(event_id % 100, (ts, event_id)) AS BIGINT) AS open_interest FROM q GROUP BY user_id, time_bucket(INTERVAL '1 day', ts)""")
def a24_market_candles(t):
    """Daily candles of bid, ask and traded price, with volume and the last open interest."""
    v, i = F.col("value"), F.col("event_id")
    price = F.when(F.col("event_type") == "purchase", F.round(v).cast("int"))
    rows = t.events.withColumns({"bid": F.floor(v).cast("int"), "ask": (F.floor(v) + i % 4).cast("int"), "price": price, "size": i % 7, "interest": i % 100})
    out = aggs.market_candles(rows, ["user_id"], "ts", {"bid": "bid", "ask": "ask", "price": "price"}, "size", "interest", "event_id", "1 day")
    return out.withColumn("end_us", F.unix_micros(F.col("end").cast("timestamp"))).drop("end")
