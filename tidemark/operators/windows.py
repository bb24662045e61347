"""Point-in-time window features. Frames exclude the current row unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .folds import with_fold
from .names import fresh


def sequence_of(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def rolling(kind: str, x: Column, w: WindowSpec, first: int, last: int = -1, default=0) -> Column:
    """sum, avg, min, max or count of rows first..last relative to the current one."""
    return F.coalesce(getattr(F, kind)(x).over(w.rowsBetween(first, last)), F.lit(default))


def before(kind: str, x: Column, w: WindowSpec, default=0) -> Column:
    """The same over all rows before the current one."""
    return F.coalesce(getattr(F, kind)(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(default))


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def changed(x: Column, w: WindowSpec) -> Column:
    """Whether x differs from the row before; the first row doesn't."""
    return F.coalesce(F.lag(x).over(w) != x, F.lit(False))


def increments(x: Column, w: WindowSpec) -> Column:
    """Growth of a cumulative counter since the row before, never below 0."""
    return F.greatest(x - F.coalesce(F.lag(x).over(w), x), F.lit(0))


def trailing(kind: str, x: Column, by: list[str], time: Column, width: int) -> Column:
    """Over rows with time in (t - width, t], the current one included. time: a long."""
    w = Window.partitionBy(*by).orderBy(time).rangeBetween(-width + 1, 0)
    return getattr(F, {"first": "first_value", "last": "last_value"}.get(kind, kind))(x).over(w)


def since_last(event: Column, time: Column, w: WindowSpec) -> Column:
    """Time since the last row with event, the current included; before the first, since the start."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return time - F.coalesce(F.last(F.when(event, time), ignorenulls=True).over(upto), F.min(time).over(upto))


def with_rows_since(df: DataFrame, name: str, event: Column, by: list[str], order: list[str], none: int = 999) -> DataFrame:
    """Adds how many rows ago the last event before this row was (1: the row before), or none."""
    w = sequence_of(by, order)
    out = df.withColumn("_at", F.row_number().over(w))
    last = F.max(F.when(event, F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, F.coalesce(F.col("_at") - last, F.lit(none))).drop("_at")


def with_streak(df: DataFrame, by: list[str], order: list[str], side: str, points: Column, prefix: str = "streak_") -> DataFrame:
    """Adds the scoring run before each row: side, length, points. A row scores if points > 0;
    rows that don't leave the run as it is. Gaps and islands over scoring rows, in one shuffle."""
    w = sequence_of(by, order)
    scores = F.coalesce(points > 0, F.lit(False))
    who, got, new, island, state, run = (fresh(c, df) for c in ("_s", "_p", "_new", "_island", "_state", "_run"))
    rows = df.withColumn(who, F.when(scores, F.col(side))).withColumn(got, F.when(scores, points))
    prior = F.last(who, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(new, (F.col(who).isNotNull() & (prior.isNull() | (prior != F.col(who)))).cast("int"))
    rows = rows.withColumn(island, F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, island).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(state, F.when(F.col(who).isNotNull(), F.struct(F.col(who).alias("side"), F.count(who).over(inside).alias("length"), F.sum(got).over(inside).alias("points"))))
    rows = rows.withColumn(run, F.last(state, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumns({f"{prefix}side": F.coalesce(F.col(run)["side"], F.lit("")), f"{prefix}length": F.coalesce(F.col(run)["length"], F.lit(0)), f"{prefix}points": F.coalesce(F.col(run)["points"], F.lit(0))}).drop(who, got, new, island, state, run)


def with_ewma(df: DataFrame, by: list[str], order: list[str], x: str, name: str, start: float, least_alpha: float = 0.05) -> DataFrame:
    """One row per input row with the adaptive average BEFORE it: alpha_n = max(least, 2 / (n + 2))
    for the n-th value, warm start. A fold over each entity's sorted values that holds (level, n)."""

    def step(state, value):
        level, n = state[0], state[1] + 1.0
        alpha = max(least_alpha, 2.0 / (n + 2.0))
        return (level if value is None else alpha * value + (1.0 - alpha) * level, n), level

    rows = df.withColumn("_x", F.col(x).cast("double"))
    return with_fold(rows, by, [*order, "_x", *df.columns], ["_x"], lambda: (float(start), 0.0), step, name, "double").drop("_x")


def reflected(rows: DataFrame, by: list[str], order: list[str], amount: Column, name: str, block: Column | None = None) -> DataFrame:
    """Adds the running sum of amount that never goes below 0: after each row max(0, before + amount).
    That is the running sum less its least value so far (0 at most). Null amounts are 0.

    With block, a value that never falls along the order (such as the day), a group is summed in
    blocks, each by itself; only a row for each block, with its sum and its lowest point, is ordered
    as a whole, and both are carried into the blocks after it. by may then be empty: one global order
    without one task for all rows."""
    names = iter(f"_{name}_{k}" for k in range(100))
    s, b, low, total, floor, start = (next(n for n in names if n not in rows.columns) for _ in range(6))
    df = rows.withColumn(b, block if block is not None else F.lit(0))
    inside = Window.partitionBy(*by, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(s, F.sum(F.coalesce(amount, F.lit(0))).over(inside)).withColumn(low, F.min(s).over(inside))
    if block is None:
        return df.withColumn(name, F.col(s) - F.least(F.lit(0), low)).drop(s, b, low)
    last = F.max_by(s, F.struct(*order))
    each = df.groupBy(*by, b).agg(last.alias(total), F.min(s).alias(low))
    ahead = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn(start, F.coalesce(F.sum(total).over(ahead), F.lit(0)))
    each = each.withColumn(floor, F.least(F.lit(0), F.min(F.col(start) + F.col(low)).over(ahead))).select(*[F.col(c).alias(f"{c}{b}") for c in (*by, b)], start, floor)
    same = [F.col(c).eqNullSafe(F.col(f"{c}{b}")) for c in (*by, b)]
    df = df.join(each, same, "left").withColumn(name, F.col(start) + F.col(s) - F.least(F.col(floor), F.col(start) + F.col(low)))
    return df.select(*[c for c in rows.columns if c != name], name)


def average_pace(rows: DataFrame, home: str, away: str, game: str, pace: str, default: float = 15.0) -> DataFrame:
    """team, game, pace: mean of the paces above 0 over all rows of the team's games up to this one,
    home or away, this one included; default where there is none. Rows are summed by game first."""
    each = rows.select(F.explode(F.array_distinct(F.array(home, away))).alias("team"), F.col(game).alias("game"), F.when(F.col(pace) > 0, F.col(pace)).alias("_p"))
    sums = each.groupBy("team", "game").agg(F.sum("_p").alias("_s"), F.count("_p").alias("_n"))
    w = sequence_of(["team"], ["game"]).rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("team", "game", F.coalesce(F.sum("_s").over(w) / F.nullif(F.sum("_n").over(w), F.lit(0)), F.lit(default)).alias("pace"))


def rest_days(games: DataFrame, team: str, day: str, cap: int = 7, default: int = 3) -> DataFrame:
    """Adds rest (days since the team's last game - 1, capped, default for the first) and back_to_back."""
    w = sequence_of([team], [day])
    gap = F.datediff(F.col(day), F.lag(day).over(w))
    return games.withColumn("rest", F.coalesce(F.least(gap - 1, F.lit(cap)), F.lit(default))).withColumn("back_to_back", F.coalesce(gap == 1, F.lit(False)))
