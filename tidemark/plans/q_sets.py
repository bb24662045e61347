"""Sources and sinks as table states: upserts, merges, patches, unions; sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from .q_joins import events
from .registry import query


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_quantity > 0")
def s01_s03_scan(t):
    """Projection and filter that reach the scan."""
    return t.lineitem.where((F.col("l_shipdate") >= "1996-01-01") & (F.col("l_quantity") > 0)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""WITH m AS (SELECT user_id, max(ts) AS hw FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT event_id FROM events e LEFT JOIN m USING (user_id) WHERE hw IS NULL OR ts > hw""")
def s04_incremental(t):
    """Rows newer than what the target holds per key; event_id % 3 = 0 plays the target."""
    e = events(t)
    return io.newer_than(e, e.where("event_id % 3 = 0"), ["user_id"], "us").select("event_id")


@query("SELECT c_custkey, c_name FROM customer")
def s05_insert_new(t):
    """Insert-or-ignore into the table of odd keys."""
    c = t.customer.select("c_custkey", "c_name")
    return io.insert_new(c.where("c_custkey % 2 = 1"), c, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer")
def s06_upsert(t):
    c = t.customer.select("c_custkey", "c_name")
    return io.upsert(c, c.where("c_custkey % 5 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END AS c_acctbal FROM customer")
def s07_additive_merge(t):
    """Two stores with different columns become one by natural key."""
    a = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    b = t.customer.select("c_custkey", "c_acctbal")
    return io.additive_merge(a, b, ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def s09_replace_groups(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    staging = o.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.lit(0.0))
    return io.replace_groups(o, staging, ["o_orderpriority"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice * 2, 4) ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def s10_patch(t):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    fix = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.round(F.col("o_totalprice") * 2, 4).alias("o_totalprice"))
    return io.patch(o, fix, ["o_orderkey"], ["o_totalprice"])


@query("""SELECT id, max_by(name, src) AS name FROM (SELECT c_nationkey AS id, c_name AS name, '0' || c_name AS src FROM customer UNION ALL SELECT s_nationkey, s_name, '1' || s_name FROM supplier) WHERE id > 0 GROUP BY 1""")
def s20_dimension_from_sources(t):
    parts = [t.customer.select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("name"))]
    return io.dimension(parts, "id", "name")


@query("""SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS "F", max(CASE WHEN o_orderstatus = 'O' THEN n END) AS "O" FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1""")
def s21_o07_pivot(t):
    return t.orders.groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)))


@query("SELECT o_orderkey, 'price' AS side, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, 'ship', CAST(o_custkey AS DOUBLE) FROM orders")
def o07_unpivot(t):
    wide = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("ship"))
    return wide.unpivot("o_orderkey", ["price", "ship"], "side", "v")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o01_o02_top(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS price, NULL AS status FROM orders UNION ALL SELECT 'customer', c_custkey, NULL, c_mktsegment FROM customer""")
def o03_tagged_union(t):
    a = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    b = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    return a.unionByName(b, allowMissingColumns=True).select("kind", "id", "price", "status")


@query("SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
def o04_o06_union_distinct(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""SELECT 'only_customer' AS part, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def o05_except_intersect(t):
    a, b = t.customer.select(F.col("c_custkey").alias("k")), t.orders.select("o_custkey")
    return a.subtract(b).select(F.lit("only_customer").alias("part"), "k").union(a.intersect(b).select(F.lit("both").alias("part"), "k"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 60 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)""")
def o08_o10_unprocessed(t):
    """Recent keys that a fact table lacks."""
    last = t.orders.agg(F.max("o_orderdate").alias("last"))
    recent = t.orders.join(F.broadcast(last)).where(F.col("o_orderdate") >= F.col("last") - F.expr("interval 60 days"))
    return recent.join(t.lineitem.where("l_linenumber = 3"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")
