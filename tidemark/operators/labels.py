"""Forward-looking labels: next-N margins, survival hazards, first-breach exits, trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import logit_delta
from .joins import asof_join, range_join


def with_next_margin(df: DataFrame, by: list[str], order: list[str], net: Column, ns: tuple[int, ...], prefix: str = "next_") -> DataFrame:
    """Adds the sum of `net` over the next n scoring rows strictly after each row (net not null
    and not 0 scores); fewer if the sequence ends. Scoring rows are numbered, and each row needs
    the running sum at its own number and n further: two window reads of one shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    scores = F.coalesce(net != 0, F.lit(False))
    rows = df.withColumn("_net", F.when(scores, net)).withColumn("_k", F.count("_net").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_sum", F.coalesce(F.sum("_net").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    # by number of scoring rows so far, a RANGE frame reaches the sum after exactly n more
    number = Window.partitionBy(*by).orderBy("_k")
    for n in ns:
        # the last row within the next n scoring rows has the largest number up to _k + n
        ahead = F.max_by("_sum", F.when(F.col("_net").isNotNull(), F.col("_k"))).over(number.rangeBetween(1, n))
        rows = rows.withColumn(f"{prefix}{n}", F.coalesce(ahead - F.col("_sum"), F.lit(0.0)))
    return rows.drop("_net", "_k", "_sum")


def with_hazards(df: DataFrame, by: list[str], order: list[str], run: str, scoring: Column, steps: int = 10, name: str = "hazards") -> DataFrame:
    """Adds array<int> of `steps`: whether by the (k+1)-th future scoring row the run side (column
    `run`, the state before each row) has changed; monotone. No run ('' or null) gives all 1, and
    so does a sequence that ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_k", F.count(F.when(scoring, 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    number = Window.partitionBy(*by).orderBy("_k").rangeBetween(1, steps)
    ahead = F.collect_list(F.when(scoring, F.struct("_k", F.col(run).alias("side")))).over(number)
    rows = rows.withColumn("_ahead", F.array_sort(ahead))
    gone = lambda k: (F.size("_ahead") <= k) | F.exists(F.slice("_ahead", 1, k + 1), lambda x: ~x["side"].eqNullSafe(F.col(run)))
    none = F.col(run).isNull() | (F.col(run) == "")
    return rows.withColumn(name, F.array(*[(none | gone(k)).cast("int") for k in range(steps)])).drop("_k", "_ahead")


def first_breach(entries: DataFrame, ticks: DataFrame, by: list[str], entry_id: str, start: str, side: str, entry_price: str, time: str, price: str, tie: str, hold: int, take_profit: float, stop_loss: float, flips: DataFrame | None = None, flip_time: str = "known_at", flip_side: str = "run_side", entry_side: str = "entry_team", off: str = "off") -> DataFrame:
    """One row for each entry: exit_reason, exit_time, exit_price.

    Ticks in (start, start + hold] are walked in (time, tie) order; the first that breaches ends
    it. In one tick the order is: state off, side flipped, take profit, stop loss. A take profit
    fills at entry +/- take_profit exactly. Without a breach the entry leaves at start + hold for
    its entry price ("time"). side: 1 long, -1 short. flips: states that are known from
    flip_time on (event time plus delay), as-of joined to the ticks.
    """
    if flips is not None:
        ticks = asof_join(ticks, flips, by, time, flip_time, {flip_side: "_run", off: "_off"})
    else:
        ticks = ticks.withColumn("_run", F.lit(None).cast("string")).withColumn("_off", F.lit(None).cast("boolean"))
    ticks = ticks.select(*by, F.col(time).alias("_time"), F.col(price).alias("_price"), F.col(tie).alias("_tie"), "_run", "_off")
    pairs = range_join(entries, ticks, by, start, "_time", hold)
    move = (F.col("_price") - F.col(entry_price)) * F.col(side)
    has = F.col(entry_side).isNotNull() if flips is not None else F.lit(False)
    flipped = has & F.col("_run").isNotNull() & (F.col("_run") != (F.col(entry_side) if flips is not None else F.lit("")))
    reason = F.when(F.coalesce("_off", F.lit(False)), "off").when(flipped, "flip").when(move >= take_profit, "tp").when(move <= -stop_loss, "sl")
    fill = F.when(reason == "tp", F.col(entry_price) + F.col(side) * take_profit).otherwise(F.col("_price"))
    hits = pairs.withColumn("_reason", reason).where("_reason is not null")
    first = hits.groupBy(entry_id).agg(F.min_by(F.struct(F.col("_reason").alias("reason"), F.col("_time").alias("time"), fill.cast("double").alias("price")), F.struct("_time", "_tie")).alias("_exit"))
    rows = entries.join(first, entry_id, "left")
    return rows.withColumns({"exit_reason": F.coalesce("_exit.reason", F.lit("time")), "exit_time": F.coalesce("_exit.time", F.col(start) + hold), "exit_price": F.coalesce("_exit.price", F.col(entry_price).cast("double"))}).drop("_exit")


def dynamic_exit(entries: DataFrame, ticks: DataFrame, scores: DataFrame, by: list[str], entry_id: str, start: str, side: str, entry_price: str, time: str, price: str, tie: str, hold: int, take_profit: float, stop_loss: float, score_time: str, score: str, score_tie: str, reversal: float, widen: float, most: int) -> DataFrame:
    """One row for each entry: exit_reason, exit_time, exit_price, with a path that is re-scored.

    Each tick sees the latest score known to it and how many scores in a row have had its sign.
    A score against the entry's side of at least `reversal` ends it, before the take profit,
    which widens by `widen` for each score of such a row on the entry's side (at most `most`),
    and the stop loss. Without any, the entry leaves at start + hold for its entry price."""
    w = Window.partitionBy(*by).orderBy(score_time, score_tie)
    sign = F.signum(F.col(score))
    rows = scores.withColumn("_sign", sign).withColumn("_new", F.coalesce((F.lag(sign).over(w) != sign).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_streak", F.row_number().over(Window.partitionBy(*by, "_island").orderBy(score_time, score_tie)))
    seen = asof_join(ticks, rows, by, time, score_time, {score: "_score", "_streak": "_streak"}, score_tie)
    seen = seen.select(*by, F.col(time).alias("_time"), F.col(price).alias("_price"), F.col(tie).alias("_tie"), "_score", "_streak")
    pairs = range_join(entries, seen, by, start, "_time", hold)
    along = F.coalesce(F.col("_score") * F.col(side), F.lit(0.0))
    tp = F.lit(take_profit) + F.when(along > 0, F.least(F.col("_streak"), F.lit(most)) * widen).otherwise(0.0)
    move = (F.col("_price") - F.col(entry_price)) * F.col(side)
    reason = F.when(along <= -reversal, "reversal").when(move >= tp, "tp").when(move <= -stop_loss, "sl")
    fill = F.when(reason == "tp", F.col(entry_price) + F.col(side) * tp).otherwise(F.col("_price"))
    first = pairs.withColumn("_reason", reason).where("_reason is not null").groupBy(entry_id).agg(F.min_by(F.struct(F.col("_reason").alias("reason"), F.col("_time").alias("time"), fill.cast("double").alias("price")), F.struct("_time", "_tie")).alias("_exit"))
    out = entries.join(first, entry_id, "left")
    return out.withColumns({"exit_reason": F.coalesce("_exit.reason", F.lit("time")), "exit_time": F.coalesce("_exit.time", F.col(start) + hold), "exit_price": F.coalesce("_exit.price", F.col(entry_price).cast("double"))}).drop("_exit")


def checkpoint_offsets(hold: int, n: int) -> Column:
    """n even offsets up to hold, rounded half to even."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.bround(k * F.lit(hold / n)).cast("long"))


def with_trajectory(exits: DataFrame, ticks: DataFrame, by: list[str], entry_id: str, start: str, entry_price: str, time: str, price: str, tie: str, hold: int, n: int = 10, cap: float | None = None, side: str = "side") -> DataFrame:
    """Adds trajectory: log-odds change from entry at each checkpoint: the first price at or after
    it (entry price if none), frozen at the exit price from the exit on, and before that held to
    at most entry + cap in the entry's direction."""
    grid = exits.select("*", F.posexplode(checkpoint_offsets(hold, n)).alias("_k", "_off"))
    grid = grid.withColumn("_at", F.col(start) + F.col("_off"))
    seen = asof_join(grid, ticks.select(*by, F.col(time).alias("_tt"), F.col(price).alias("_pp"), F.col(tie).alias("_ti")), by, "_at", "_tt", {"_pp": "_seen"}, "_ti", "forward")
    p = F.coalesce(F.col("_seen").cast("double"), F.col(entry_price).cast("double"))
    if cap is not None:
        p = F.when(F.col(side) > 0, F.least(p, F.col(entry_price) + cap)).otherwise(F.greatest(p, F.col(entry_price) - cap))
    p = F.when(F.col("_at") >= F.col("exit_time"), F.col("exit_price")).otherwise(p)
    # the entry's columns come along, so that the exits are planned once
    kept = [F.first(c).alias(c) for c in exits.columns if c != entry_id]
    out = seen.withColumn("_d", logit_delta(F.col(entry_price).cast("double"), p)).groupBy(entry_id).agg(F.array_sort(F.collect_list(F.struct("_k", "_d"))).alias("_t"), *kept)
    return out.select(*exits.columns, F.transform("_t", lambda x: x["_d"]).alias("trajectory"))


def trajectory_labels(entries: DataFrame, ticks: DataFrame, states: DataFrame, by: list[str], entry_id: str, happened: str, side: str, entry_price: str, time: str, price: str, tie: str, hold: int, take_profit: float, stop_loss: float, *, delay: int, flip_side: str = "run_side", entry_side: str = "entry_team", off: str = "off", n: int = 10) -> DataFrame:
    """Exit and trajectory of all entries, anchored at what could be known: entries and states
    count from `delay` after they happened (states' time is `happened` too). The delay has no
    default: a label without one looks into the future."""
    if delay < 0:
        raise ValueError("delay must not be negative")
    known = entries.withColumn("known_at", F.col(happened) + delay)
    flips = states.withColumn("known_at", F.col(happened) + delay)
    out = first_breach(known, ticks, by, entry_id, "known_at", side, entry_price, time, price, tie, hold, take_profit, stop_loss, flips, "known_at", flip_side, entry_side, off)
    return with_trajectory(out, ticks, by, entry_id, "known_at", entry_price, time, price, tie, hold, n, take_profit, side)
