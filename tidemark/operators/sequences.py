"""Event parsing as sequence operators: windows and folds instead of state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import with_fold


def possessions(actions: DataFrame, by: list[str], order: list[str], kind: str = "kind", side: str = "side", points: str = "points") -> DataFrame:
    """by, possession, actions, outcome, points. A possession ends with a made shot, a turnover,
    or a rebound by the side that did not miss on the row before; what is left at the end of the
    sequence is one more."""
    w = Window.partitionBy(*by).orderBy(*order)
    missed = (F.lag(kind).over(w) == "miss") & (F.lag(side).over(w) != F.col(side))
    ends = F.col(kind).isin("made", "turnover") | ((F.col(kind) == "rebound") & F.coalesce(missed, F.lit(False)))
    rows = actions.withColumn("_ends", ends.cast("long"))
    rows = rows.withColumn("possession", F.coalesce(F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.groupBy(*by, "possession").agg(F.count("*").alias("actions"), F.max_by(kind, F.struct(*order)).alias("outcome"), F.sum(points).alias("points"))


def starters(rows: DataFrame, by: list[str], side: str, player: str, order: list[str], sub: str, n: int = 5) -> DataFrame:
    """The first n distinct players per side before the first substitution."""
    at = F.struct(*order)
    first = F.min(F.when(F.col(sub), at)).over(Window.partitionBy(*by))
    early = rows.withColumn("_first", first).where(F.col("_first").isNull() | (at < F.col("_first")))
    seen = early.groupBy(*by, side, player).agg(F.min(at).alias("_seen"))
    w = Window.partitionBy(*by, side).orderBy("_seen")
    return seen.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).select(*by, side, player)


def lineups(subs: DataFrame, by: list[str], order: list[str], into: str, out: str, start: list[int]) -> DataFrame:
    """by, order..., lineup (sorted) after each substitution; one that takes out a player who
    isn't there, or brings in one who is, changes nothing. A fold over a group's substitutions
    that holds the lineup."""

    def step(now, came, went):
        if came is not None and went in now and came not in now:
            now = sorted([*(x for x in now if x != went), came])
        return now, now

    rows = subs.select(*by, *order, F.col(into).cast("long").alias("_in"), F.col(out).cast("long").alias("_out"))
    return with_fold(rows, by, [*order, "_in", "_out"], ["_in", "_out"], lambda: list(start), step, "lineup", "array<bigint>").drop("_in", "_out")


def interpolated(df: DataFrame, by: list[str], order: list[str], time: str, anchor: Column, name: str) -> DataFrame:
    """Adds the value on the line between the anchors around each row; outside, the nearest one."""
    w = Window.partitionBy(*by).orderBy(*order)
    both = F.when(anchor.isNotNull(), F.struct(anchor.alias("v"), F.col(time).alias("t")))
    rows = df.withColumn("_a", F.last(both, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(both, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    share = (F.col(time) - F.col("_a.t")).cast("double") / (F.col("_b.t") - F.col("_a.t"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    return rows.withColumn(name, F.when(F.col("_b.t") > F.col("_a.t"), line).otherwise(F.coalesce("_a.v", "_b.v"))).drop("_a", "_b")
