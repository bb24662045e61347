"""Replay of signals into a trade ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import with_fold
from .joins import asof_nearest
from .windows import reflected

#: How a trajectory becomes one number; ties of max_abs go to the first.
AGGREGATORS = {
    "final": lambda t: F.element_at(t, -1),
    "mean": lambda t: F.aggregate(t, F.lit(0.0), lambda a, x: a + x) / F.size(t),
    "mean_3_to_9": lambda t: F.aggregate(F.slice(t, 3, 7), F.lit(0.0), lambda a, x: a + x) / F.lit(7.0),
    "max_abs": lambda t: F.aggregate(t, F.lit(0.0), lambda a, x: F.when(F.abs(x) > F.abs(a), x).otherwise(a)),
}


def non_overlapping(signals: DataFrame, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Accepts a signal only if it doesn't start before the last accepted one's end. The one
    truly sequential step: a fold over each group's sorted signals that holds that end alone."""

    def step(free, s, e):
        ok = free[0] is None or (s is not None and not s < free[0])
        return ((e,) if ok else free), ok

    rows = signals.withColumns({"_s": F.col(start), "_e": F.col(end).cast("long")})
    kept = with_fold(rows, by, [start, tie, end, *signals.columns], ["_s", "_e"], lambda: (None,), step, "_ok", "boolean")
    return kept.where("_ok").select(*signals.columns)


def exposure(fills: DataFrame, by: list[str], order: list[str], amount: str, limit: float) -> DataFrame:
    """Adds open exposure after each row (+ fill, - exit), per group, and whether the limit was
    ever exceeded up to here (a latch). Rows that are equal in `order` are booked together."""
    w = Window.partitionBy(*by).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = fills.withColumn("exposure", F.sum(amount).over(w))
    return rows.withColumn("killed", F.max((F.col("exposure") > limit).cast("int")).over(w) == 1)


def ledger(fills: DataFrame, game: str, order: list[str], amount: Column, block: Column, per_game: float, total: float) -> DataFrame:
    """Adds game_exposure and total_exposure after each row (+ fill, - exit, never below 0), and `refused`:
    whether a fill would have taken its game's or the total exposure beyond its limit. game_exposure
    runs per game, total_exposure over all rows by `order` in blocks that follow it (see reflected).
    Like a ledger, it books every row that is there, refused or not."""
    rows = reflected(fills, [game], order, amount, "game_exposure")
    rows = reflected(rows, [], order, amount, "total_exposure", block)
    over = (F.col("game_exposure") > per_game) | (F.col("total_exposure") > total)
    return rows.withColumn("refused", F.coalesce((amount > 0) & over, F.lit(False)))


def trailing_stop(ticks: DataFrame, trade: str, order: list[str], gain: Column, trail: float) -> DataFrame:
    """The first tick of each trade whose gain is `trail` below the best so far."""
    w = Window.partitionBy(trade).orderBy(*order)
    rows = ticks.withColumn("_gain", gain).withColumn("peak", F.max("_gain").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hits = rows.where(F.col("_gain") <= F.col("peak") - trail).withColumn("_n", F.row_number().over(w))
    return hits.where("_n = 1").drop("_n", "_gain")


def sweep(signals: DataFrame, configs: DataFrame, accept: Column, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Replays every row of a small parameter grid in one job: signals cross the grid (which
    the caller states, a row for each setting), are gated, and overlap only within (config, group)."""
    return non_overlapping(signals.crossJoin(configs).where(accept), ["config", *by], start, end, tie)


def gated(signals: DataFrame, has_data: Column, run_length: Column, run_probability: Column, bid: Column, trajectory: Column, run_sign: Column, least_run: int, least_probability: float, band: tuple[float, float], least_move: float, by_trajectory: bool = False) -> DataFrame:
    """The signals that pass the replay's gates, with entry_side: the sign of the trajectory or of the run
    (0 counts as 1). Gates don't depend on earlier trades, so all candidates are judged at once."""
    fine = has_data & (run_length >= least_run) & (run_probability >= least_probability) & bid.between(*band) & (F.abs(trajectory) >= least_move)
    lead = trajectory if by_trajectory else run_sign
    return signals.where(fine).withColumn("entry_side", F.when(lead >= 0, 1).otherwise(-1))


def live_exits(quotes: DataFrame, trade: str, order: list[str], direction: str, entry: str, bid: str, ask: str, take_profit: float, stop_loss: float, held: Column, most_held: int, activate: float = 0.0, giveback: float = 0.0) -> DataFrame:
    """The first quote of each trade that ends it, with exit_reason and exit_price, checked in the order
    TAKE_PROFIT (a resting limit, filled at its price; off with a trailing stop), STOP_LOSS, TRAIL_STOP
    (once `activate` above entry, `giveback` below the peak), TIME_STOP (`held` rows or more).
    A NO position is worth 100 less the ask, or less the bid where there is no ask."""
    no = F.lit(100) - F.when(F.col(ask) == 0, F.col(bid)).otherwise(F.col(ask))
    price = F.when(F.col(direction) == "NO", no).otherwise(F.col(bid)).cast("double")
    w = Window.partitionBy(trade).orderBy(*order)
    rows = quotes.withColumn("_price", price).withColumn("peak", F.greatest(F.max("_price").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col(entry).cast("double")))
    gain = F.col("_price") - F.col(entry)
    reason = F.when((gain >= take_profit) & F.lit(giveback <= 0), "TAKE_PROFIT").when(-gain >= stop_loss, "STOP_LOSS")
    if giveback > 0:
        reason = reason.when((F.col("peak") - F.col(entry) >= activate) & (F.col("peak") - F.col("_price") >= giveback), "TRAIL_STOP")
    reason = reason.when(held >= most_held, "TIME_STOP")
    hits = rows.withColumn("exit_reason", reason).where("exit_reason is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return hits.withColumn("exit_price", F.when(F.col("exit_reason") == "TAKE_PROFIT", F.col(entry) + take_profit).otherwise(F.col("_price"))).drop("_n", "_price")


def paper_value(side: Column, bid: Column, ask: Column, entry: bool) -> Column:
    """Cents that a side pays to enter or gets to leave, across the spread."""
    yes, no = (ask, F.lit(100) - bid) if entry else (bid, F.lit(100) - ask)
    return F.when(side == "YES", yes).otherwise(no)


def line_moves(signals: DataFrame, snapshots: DataFrame, by: list[str], time: str, snapshot_time: str, chance: str, tie: str, direction: str, ahead: int, most: int, size: int = 10, rate: float = 0.0175) -> DataFrame:
    """signals with the line nearest to them and the one nearest to `ahead` later (each at most `most`
    off, else the signal goes), entry_cents, exit_cents, gross and net of a flat-rate fee."""
    rows = asof_nearest(signals.withColumn("_later", F.col(time) + ahead), snapshots, by, time, snapshot_time, {chance: "chance_entry"}, tie, most)
    rows = asof_nearest(rows, snapshots, by, "_later", snapshot_time, {chance: "chance_exit"}, tie, most)
    rows = rows.where("chance_entry is not null and chance_exit is not null").drop("_later")
    move = (F.col("chance_exit") - F.col("chance_entry")) * F.when(F.col(direction) == "YES", 1).otherwise(-1)
    cents = lambda c: F.bround(F.col(c) * 100).cast("int")
    fees = F.lit(rate * size / 100) * (F.col("entry_cents") + F.col("exit_cents"))
    return rows.withColumns({"entry_cents": cents("chance_entry"), "exit_cents": cents("chance_exit"), "gross": move * size}).withColumn("net", F.col("gross") - fees)


def exposure_ledger(fills: DataFrame, day: str, order: list[str], amount: str, gain: str, limit: float, loss_limit: float) -> DataFrame:
    """Per day: exposure and realized gain after each fill, and whether a limit was passed up to here.
    A day's fills are one sequence, so a day is a task; those that are equal in `order` are booked together."""
    w = Window.partitionBy(day).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = fills.withColumn("exposure", F.sum(amount).over(w)).withColumn("realized", F.sum(gain).over(w))
    passed = ((F.col("exposure") > limit) | (F.col("realized") < -loss_limit)).cast("int")
    return rows.withColumn("killed", F.max(passed).over(w) == 1)


def exit_shares(trades: DataFrame, reason: str, by: list[str] | None = None) -> DataFrame:
    """by..., reason, n, share: how often trades ended for each reason, and of all in the group."""
    by = by or []
    each = trades.groupBy(*by, F.col(reason).alias("reason")).agg(F.count("*").alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def sweep_summary(trades: DataFrame, config: str, net: Column, move: Column, reason: str, reasons: list[str], least: int = 50, rate: float = 0.45) -> DataFrame:
    """config, n, win_rate, total_net, exits_<reason>..., median_move, winner of every setting of a sweep.
    The winner has the largest net among those with at least `least` trades and win rate `rate` (of
    equal ones the least config); where none has, none wins. median_move: of move's absolute value.
    One row a setting is compared, however many trades there are."""
    agg = trades.groupBy(config).agg(
        F.count("*").alias("n"), F.avg((net > 0).cast("double")).alias("win_rate"), F.sum(net).alias("total_net"),
        *[F.count_if(F.col(reason) == r).alias(f"exits_{r}") for r in reasons], F.percentile(F.abs(move), 0.5).alias("median_move"),
    )
    fit = (F.col("n") >= least) & (F.col("win_rate") >= rate)
    first = F.row_number().over(Window.orderBy(F.desc(fit), F.desc("total_net"), config))
    return agg.withColumn("winner", fit & (first == 1))
