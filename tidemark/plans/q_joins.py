"""Point-in-time joins over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import micros
from ..operators import joins
from .registry import Tables, query

HOUR = 3_600_000_000


def events(t: Tables):
    return t.events.withColumn("us", micros(F.col("ts")))


def of(t: Tables, kind: str):
    return events(t).where(F.col("event_type") == kind).select("event_id", "user_id", "us", "value")


_BACK = """WITH l AS (SELECT * FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, ts AS rts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view')
SELECT l.event_id, l.user_id, CASE WHEN epoch_us(l.ts) - epoch_us(rts) <= 7200000000 THEN view_id END AS view_id,
CASE WHEN epoch_us(l.ts) - epoch_us(rts) <= 7200000000 THEN view_value END AS view_value
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.rts"""


@query(_BACK)
def j05_asof_backward(t):
    """Each click with the same user's latest view, no older than two hours."""
    out = joins.asof_join(of(t, "click"), of(t, "view"), ["user_id"], "us", "us", {"event_id": "view_id", "value": "view_value"}, "event_id", tolerance=2 * HOUR)
    return out.select("event_id", "user_id", "view_id", "view_value")


@query(_BACK)
def j05_asof_chunked(t):
    """The same, with each user's rows dealt over days: how a hot key is spread."""
    out = joins.asof_join(of(t, "click"), of(t, "view"), ["user_id"], "us", "us", {"event_id": "view_id", "value": "view_value"}, "event_id", tolerance=2 * HOUR, chunk=24 * HOUR)
    return out.select("event_id", "user_id", "view_id", "view_value")


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, ts AS rts, event_id AS purchase_id FROM events WHERE event_type = 'purchase')
SELECT l.event_id, purchase_id, epoch_us(rts) - epoch_us(l.ts) AS wait_us
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.rts""")
def j06_asof_forward(t):
    out = joins.asof_join(of(t, "click"), of(t, "purchase"), ["user_id"], "us", "us", {"event_id": "purchase_id", "us": "at"}, "event_id", "forward")
    return out.select("event_id", "purchase_id", (F.col("at") - F.col("us")).alias("wait_us"))


@query("""WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS us, ts FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, ts AS rts, epoch_us(ts) AS rus, event_id AS rid FROM events WHERE event_type = 'view'),
b AS (SELECT l.*, rid AS bid, rus AS bus FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.rts),
n AS (SELECT b.*, rid AS fid, rus AS fus FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.ts <= r.rts),
c AS (SELECT *, (fus IS NULL OR us - bus <= fus - us) AS back FROM n)
SELECT event_id, CASE WHEN (CASE WHEN back THEN us - bus ELSE fus - us END) <= 14400000000
THEN (CASE WHEN back THEN bid ELSE fid END) END AS near_id FROM c""")
def j07_asof_nearest(t):
    out = joins.asof_nearest(of(t, "error"), of(t, "view"), ["user_id"], "us", "us", {"event_id": "near_id"}, "event_id", most=4 * HOUR)
    return out.select("event_id", "near_id")


@query("""WITH days AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'signup'),
snap AS (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS as_of, sum(value) AS rating FROM events WHERE event_type = 'signup' GROUP BY ALL),
l AS (SELECT event_id, user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'purchase'),
f AS (SELECT l.*, days.d AS as_of FROM l ASOF LEFT JOIN days ON l.d >= days.d)
SELECT event_id, CAST(f.as_of AS INT) AS as_of, round(rating, 6) AS rating FROM f LEFT JOIN snap ON f.as_of = snap.as_of AND f.user_id = snap.user_id""")
def j08_asof_snapshot(t):
    """Purchases with the user's row of the latest snapshot day at or before."""
    day = F.unix_date(F.to_date("ts"))
    snap = t.events.where("event_type = 'signup'").groupBy("user_id", day.alias("as_of")).agg(F.sum("value").alias("rating"))
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", day.alias("d"))
    return joins.asof_snapshot(left, snap, "user_id", "d", "as_of", 30).select("event_id", F.col("as_of").cast("int"), F.round("rating", 6).alias("rating"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders)
SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS any_before,
(SELECT max_by(p.o_totalprice, (p.o_orderdate, p.o_orderkey)) FROM o p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS price_before FROM o""")
def j11_latest_before(t):
    """The price of the customer's latest order on an earlier day; and of the order before."""
    from pyspark.sql.window import Window

    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", micros(F.col("o_orderdate")).alias("us"))
    out = joins.latest_before(o, o, ["o_custkey"], "us", "us", {"o_totalprice": "price_before"}, "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("us", "o_orderkey")
    return out.select("o_orderkey", F.lag("o_totalprice").over(w).alias("any_before"), "price_before")


@query("SELECT c_custkey, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def j12_latest_per_entity(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joins.best_per_group(rows, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT a.event_id, b.event_id AS view_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view'
AND b.ts > a.ts AND epoch_us(b.ts) <= epoch_us(a.ts) + 86400000000 WHERE a.event_type = 'signup'""")
def j22_range_join(t):
    """Views within a day after each signup of the same user."""
    views = of(t, "view").select("user_id", F.col("us").alias("view_us"), F.col("event_id").alias("view_id"))
    return joins.range_join(of(t, "signup"), views, ["user_id"], "us", "view_us", 24 * HOUR).select("event_id", "view_id")


@query("""SELECT o_orderkey, coalesce(c_name, 'nobody') AS c_name, coalesce(c_acctbal, 0.0) AS c_acctbal, c_custkey IS NOT NULL AS known
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def j01_j04_lookup_defaults(t):
    found = t.customer.where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return joins.lookup(t.orders, found, ["o_custkey"], {"c_name": "nobody", "c_acctbal": 0.0}, "known").select("o_orderkey", "c_name", "c_acctbal", "known")


@query("""WITH p AS (SELECT c_nationkey, c_custkey, c_acctbal FROM customer)
SELECT n_name, c_custkey, c_acctbal FROM nation JOIN p ON n_nationkey = c_nationkey
QUALIFY c_acctbal = min(c_acctbal) OVER (PARTITION BY n_name)""")
def j09_minimum_per_group(t):
    """All rows that reach the least value of their group."""
    from pyspark.sql.window import Window

    rows = t.nation.join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.withColumn("least", F.min("c_acctbal").over(Window.partitionBy("n_name")))
    return rows.where("c_acctbal = least").select("n_name", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, c_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON o_custkey = c_custkey")
def j10_unresolved_kept(t):
    some = t.customer.where("c_acctbal < 0").select("c_custkey")
    return t.orders.join(some, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j13_j14_anti(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j15_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ts < a.ts) AS errors_before
FROM events a WHERE a.event_type = 'purchase'""")
def j16_j17_strictly_before(t):
    """Errors of the user strictly before each purchase, by one running count instead of a theta join."""
    from pyspark.sql.window import Window

    rows = events(t).where("event_type in ('purchase', 'error')")
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("errors_before", F.count_if(F.col("event_type") == "error").over(w)).where("event_type = 'purchase'").select("event_id", "errors_before")


@query("""SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS keys, (SELECT count(DISTINCT c_custkey) FROM customer JOIN orders ON o_custkey = c_custkey) AS covered""")
def j18_coverage(t):
    keys = t.orders.select("o_custkey").distinct()
    hit = keys.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return hit.agg(F.count("*").alias("keys"), F.count("c_custkey").alias("covered"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON round(s_acctbal, 0) = round(c_acctbal, 0)")
def j20_rounded_key(t):
    return joins.rounded_join(t.supplier, t.customer, "s_acctbal", "c_acctbal", 0).select("s_suppkey", "c_custkey")


@query("""WITH a AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, max(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, q, d FROM a JOIN b USING (l_orderkey)""")
def j19_j21_paired(t):
    a = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    b = t.lineitem.groupBy("l_orderkey").agg(F.max("l_discount").alias("d"))
    return joins.paired(a, b, ["l_orderkey"]).select("l_orderkey", "q", "d")


@query("""SELECT threshold, n_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey
CROSS JOIN (SELECT unnest([0.0, 2000.0, 5000.0]) AS threshold) WHERE s_acctbal >= threshold GROUP BY ALL""")
def j23_parameter_grid(t):
    grid = t.spark.createDataFrame([(0.0,), (2000.0,), (5000.0,)], "threshold double")
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).crossJoin(F.broadcast(grid))
    return rows.where("s_acctbal >= threshold").groupBy("threshold", "n_regionkey").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS members FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(avg(s_acctbal), 6) AS predicted FROM (SELECT l_orderkey, unnest(members) AS k FROM m) JOIN supplier ON s_suppkey = k GROUP BY 1""")
def j24_membership_average(t):
    """Average rating of an array's members: explode, join, average."""
    m = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("members"))
    rows = m.select("l_orderkey", F.explode("members").alias("s_suppkey")).join(t.supplier, "s_suppkey")
    return rows.groupBy("l_orderkey").agg(F.round(F.avg("s_acctbal"), 6).alias("predicted"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS spread, CASE l_returnflag WHEN 'R' THEN 'home' ELSE 'away' END AS team FROM lineitem)
SELECT o_orderkey, l_linenumber, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY spread, l_linenumber) AS n FROM c JOIN orders ON l_orderkey = o_orderkey WHERE team = 'home') WHERE n = 1""")
def j09_best_contract(t):
    """Of each order's returned lines, its contracts on the home side, the one with the least spread."""
    contracts = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("spread"), F.when(F.col("l_returnflag") == "R", "home").otherwise("away").alias("team"))
    games = t.orders.select("o_orderkey", "o_totalprice", F.lit("home").alias("side"))
    return joins.best_contract(contracts, games, ["o_orderkey"], "spread", "team", "side", "l_linenumber").select("o_orderkey", "l_linenumber", "o_totalprice")


@query("""SELECT 'rows' AS what, count(*) AS n FROM events UNION ALL SELECT 'unresolved', count(*) FILTER (c_name IS NULL) FROM events LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 > 0) ON user_id = c_custkey
UNION ALL SELECT 'names', count(DISTINCT c_name) FROM events JOIN customer ON user_id = c_custkey WHERE c_custkey % 3 > 0""")
def j10_resolved(t):
    """Events with their customer's name: how many there are, how many found none, and how many names."""
    names = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    rows, counts = joins.resolved(t.events.select("event_id", "user_id"), names, ["user_id"], "c_name")
    one = counts.select(F.explode(F.array(F.struct(F.lit("rows").alias("what"), F.col("rows").alias("n")), F.struct(F.lit("unresolved").alias("what"), F.col("unresolved").alias("n")))).alias("x")).select("x.*")
    return one.unionByName(rows.agg(F.count_distinct("c_name").alias("n")).select(F.lit("names").alias("what"), "n"))


@query("""SELECT l_orderkey AS game, max(CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey END) AS home, max(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END) AS away FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 1) > 0 AND count(*) FILTER (l_linenumber = 2) > 0""")
def s21_home_away(t):
    """The suppliers of an order's first two lines as its two sides; orders of one line have no game."""
    from ..sources import io

    sides = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("game"), F.when(F.col("l_linenumber") == 1, "home").otherwise("away").alias("side"), "l_suppkey")
    return io.home_away(sides, "game", "side", "l_suppkey")
