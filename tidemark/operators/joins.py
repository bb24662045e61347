"""Point-in-time joins, composed of unions and windows: Spark SQL has no as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .names import fresh


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: dict[str, str], tie: str | None = None, direction: str = "backward", tolerance: int | None = None, chunk: int | None = None) -> DataFrame:
    """left with, for each row, columns of right's row with the latest time not after its own
    (direction "forward": the earliest not before), equal times included, per key `by`.

    take: right column -> output name. Times are numeric, tie orders right rows of equal time
    (the last counts backward, the first forward). Beyond `tolerance` the columns are null.
    One shuffle by key. With `chunk` (a width of time), a key's rows are dealt by key and chunk
    and the chunks' edges are carried over, so that one hot key is spread over many tasks.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    back = direction == "backward"
    got = F.struct(F.col(right_time).alias("_time"), *[F.col(c).alias(n) for c, n in take.items()])
    r = right.select(*by, F.col(right_time).alias("_t"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), got.alias("_got"), F.lit(0 if back else 2).alias("_side"), F.lit(None).cast(left.schema).alias("_row"))
    l = left.select(*by, F.col(left_time).alias("_t"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_got"].dataType).alias("_got"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rows = l.unionByName(r)
    dealt = [F.col(c) for c in by]
    if chunk:
        rows = rows.withColumn("_chunk", F.floor(F.col("_t") / F.lit(chunk)))
        dealt.append(F.col("_chunk"))
    order = Window.partitionBy(*dealt).orderBy(F.col("_t"), F.col("_side"), F.col("_tie"))
    seen = F.last("_got", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("_got", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_seen", seen)
    if chunk:
        edge = F.max_by if back else F.min_by
        edges = rows.groupBy(*by, "_chunk").agg(edge("_got", F.when(F.col("_got").isNotNull(), F.struct("_t", "_tie"))).alias("_edge"))
        over = Window.partitionBy(*by).orderBy("_chunk")
        carried = F.last("_edge", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)) if back else F.first("_edge", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
        edges = edges.select(*by, "_chunk", carried.alias("_carried"))
        rows = rows.where("_side = 1").alias("a").join(edges.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_chunk"]]).select("a.*", "_carried").withColumn("_seen", F.coalesce("_seen", "_carried"))
    rows = rows.where("_side = 1")
    if tolerance is not None:
        rows = rows.withColumn("_seen", F.when(F.abs(F.col("_t") - F.col("_seen._time")) <= tolerance, F.col("_seen")))
    return rows.select("_row.*", *[F.col(f"_seen.{n}").alias(n) for n in take.values()])


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: dict[str, str], tie: str | None = None, most: int | None = None) -> DataFrame:
    """As asof_join, with the row nearest in time; of two equally near the earlier. Beyond
    `most` the columns are null."""
    both = {right_time: "_bt", **{c: f"_b_{n}" for c, n in take.items()}}
    fore = {right_time: "_ft", **{c: f"_f_{n}" for c, n in take.items()}}
    rows = asof_join(asof_join(left, right, by, left_time, right_time, both, tie), right, by, left_time, right_time, fore, tie, "forward")
    gap_b, gap_f = F.col(left_time) - F.col("_bt"), F.col("_ft") - F.col(left_time)
    back = gap_f.isNull() | (gap_b <= gap_f)
    near = F.when(back, gap_b).otherwise(gap_f)
    fine = near.isNotNull() if most is None else near <= most
    return rows.select(*left.columns, *[F.when(fine, F.when(back, F.col(f"_b_{n}")).otherwise(F.col(f"_f_{n}"))).alias(n) for n in take.values()])


def asof_snapshot(left: DataFrame, snapshots: DataFrame, key: str, left_order: str, as_of: str, chunk: int) -> DataFrame:
    """Each left row with the whole row set of the latest snapshot (key, as_of) at or before it:
    the distinct as_of values are as-of joined, then equi-joined. All left rows share one order of
    time, so they are dealt by spans of `chunk`."""
    days = snapshots.select(F.col(as_of).alias("_as_of")).distinct().withColumn("_all", F.lit(1))
    rows = asof_join(left.withColumn("_all", F.lit(1)), days, ["_all"], left_order, "_as_of", {"_as_of": "_found"}, chunk=chunk).drop("_all")
    s = snapshots.withColumnRenamed(as_of, "_found")
    return rows.join(s, ["_found", key], "left").withColumnRenamed("_found", as_of)


def latest_before(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: dict[str, str], tie: str | None = None) -> DataFrame:
    """As asof_join backward, strictly before."""
    moved = right.withColumn("_moved", F.col(right_time) + 1)
    return asof_join(left, moved, by, left_time, "_moved", take, tie)


def range_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, width: int) -> DataFrame:
    """Pairs with left_time < right_time <= left_time + width, per key. Time is cut into buckets
    of that width: a left row meets its own bucket and the next, so the join is an equi-join."""
    own, bucket = F.floor(F.col(left_time) / F.lit(width)), fresh("_bucket", left, right)
    l = left.withColumn(bucket, F.explode(F.array(own, own + 1)))
    r = right.withColumn(bucket, F.floor(F.col(right_time) / F.lit(width)))
    pairs = l.join(r, [*by, bucket]).where((F.col(right_time) > F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + width))
    return pairs.drop(bucket)


def lookup(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, object], flag: str | None = None) -> DataFrame:
    """Left join on unique keys, with defaults for columns not found and a presence flag."""
    there = fresh("_found", left, right)
    found = right.select(*on, *defaults, F.lit(True).alias(there)).dropDuplicates(on)
    rows = left.join(found, on, "left")
    out = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return (out.withColumn(flag, F.coalesce(there, F.lit(False))) if flag else out).drop(there)


def rounded_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, digits: int = 2, more: list[str] | None = None) -> DataFrame:
    """Join of floats as doubles rounded to digits: float32 keys don't compare equal otherwise."""
    key = lambda c: F.round(F.col(c).cast("double"), digits)
    own = fresh("_key", left, right)
    return left.withColumn(own, key(left_on)).join(right.withColumn(own, key(right_on)), [own, *(more or [])]).drop(own)


def paired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails, when it runs, on a key that one side lacks or holds twice."""
    w = Window.partitionBy(*on)
    a, b, ok = (fresh(n, left, right) for n in ("_l", "_r", "_ok"))
    l = left.withColumn(a, F.count("*").over(w))
    r = right.withColumn(b, F.count("*").over(w))
    fine = (F.col(a) == 1) & (F.col(b) == 1)
    rows = l.join(r, on, "full").withColumn(ok, F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.lit("the two sides don't have the same keys")).cast("boolean")))
    return rows.where(F.col(ok)).drop(a, b, ok)


def best_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in an order that ties don't leave open."""
    w, rank = Window.partitionBy(*by).orderBy(*order), fresh("_rank", rows)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop(rank)


def best_contract(contracts: DataFrame, games: DataFrame, on: list[str], spread: str, team: str, home: str, tie: str) -> DataFrame:
    """Of each game's contracts on its home side the one with the least spread, with the game's columns."""
    rows = contracts.join(games, on).where(F.col(team) == F.col(home))
    return best_per_group(rows, on, [F.asc(spread), F.asc(tie)])


def near_dates(rows: DataFrame, day: str, games: DataFrame, game_day: str, before: int, after: int) -> DataFrame:
    """rows with the games of the days around theirs (before and after, the ends included), through
    buckets of days as wide as the range, so that the join is on equal keys."""
    width, n = before + after + 1, F.unix_date(F.col(game_day).cast("date"))
    first = F.unix_date(F.col(day).cast("date")) - before
    low, at, bucket = (fresh(c, rows, games) for c in ("_first", "_n", "_bucket"))
    l = rows.withColumn(low, first).withColumn(bucket, F.explode(F.array_distinct(F.array(F.floor(F.col(low) / width), F.floor((F.col(low) + width - 1) / width)))))
    pairs = l.join(games.withColumn(at, n).withColumn(bucket, F.floor(F.col(at) / width)), bucket)
    return pairs.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(low) + width)).drop(bucket, low, at)


def resolved(rows: DataFrame, dimension: DataFrame, on: list[str], take: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the dimension's value, null where it has none; their number and that of the unresolved)."""
    one = dimension.groupBy(*on).agg(F.min(take).alias(take))
    out = rows.join(one, on, "left")
    return out, out.agg(F.count("*").alias("rows"), F.count_if(F.col(take).isNull()).alias("unresolved"))
