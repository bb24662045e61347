"""Reports: buckets, distributions, drift, classification metrics, candles, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bucket_report(trades: DataFrame, keys: dict[str, Column], net: str) -> DataFrame:
    """dimension, bucket, n, total_net, win_rate over several keys in one pass (grouping sets)."""
    rows = trades.select(F.col(net).alias("_net"), F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("bucket")) for k, c in keys.items()])).alias("_b"))
    return rows.groupBy("_b.dimension", "_b.bucket").agg(F.count("*").alias("n"), F.sum("_net").alias("total_net"), F.avg((F.col("_net") > 0).cast("double")).alias("win_rate"))


def with_lower_sums(values: DataFrame, by: list[str], x: str, amounts: list[str], parts: int = 128) -> DataFrame:
    """Adds lower_<amount>: the sum over lower x of the group. One row for each (group, x).

    Values are dealt by `parts` of their own, those with the least hashes, so that a group with
    very many values is ordered in as many tasks; only a row for each part is ordered as a whole.
    A value's part is found by halving its bounds."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(x), x)
    bounds = values.select(*by, x).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= parts).groupBy(*by).agg(F.array_sort(F.collect_list(x)).alias("_bounds"))
    below = lambda k: F.coalesce(F.get("_bounds", k - 1) < F.col(x), F.lit(False))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])
    part = F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(below(at + step), step).otherwise(0))
    rows = values.join(bounds, by).withColumn("_part", part).drop("_bounds")
    inside = Window.partitionBy(*by, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_part").agg(*[F.sum(a).alias(a) for a in amounts])
    sums = sums.select(*by, "_part", *[F.coalesce(F.sum(a).over(ahead), F.lit(0)).alias(f"_ahead_{a}") for a in amounts])
    rows = rows.withColumns({f"lower_{a}": F.coalesce(F.sum(a).over(inside), F.lit(0)) for a in amounts}).join(sums, [*by, "_part"])
    return rows.withColumns({f"lower_{a}": F.col(f"lower_{a}") + F.col(f"_ahead_{a}") for a in amounts}).drop("_part", *[f"_ahead_{a}" for a in amounts])


def percentiles(values: DataFrame, by: list[str], x: str, n: str, shares: dict[str, float]) -> DataFrame:
    """by, <name>...: exact percentiles (linear between neighbours) from values and their counts."""
    rows = with_lower_sums(values, by, x, [n])
    total = values.groupBy(*by).agg(F.sum(n).alias("_of"))
    rows = rows.join(total, by)
    at = lambda k: F.max(F.when((F.col(f"lower_{n}") <= k) & (k < F.col(f"lower_{n}") + F.col(n)), F.col(x)))
    place = {name: (F.col("_of") - 1) * F.lit(p) for name, p in shares.items()}
    found = rows.groupBy(*by, "_of").agg(*[f(F.floor(k) if which == "lo" else F.ceil(k)).alias(f"_{which}_{name}") for name, k in place.items() for which, f in (("lo", at), ("hi", at))])
    return found.select(*by, *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (k - F.floor(k))).alias(name) for name, k in place.items()])


def distribution(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """column, n, mean, std (population), p10, p50, p90 (linear) of each column."""
    key = [*(by or []), "column"]
    rows = df.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_s")).select(*(by or []), "_s.*")
    agg = rows.groupBy(*key).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    values = rows.where("x is not null").groupBy(*key, "x").agg(F.count("*").alias("c"))
    return agg.join(percentiles(values, key, "x", "c", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), key, "left").select(*key, "n", "mean", "std", "p10", "p50", "p90")


def drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Shift of each column's mean in sigmas of the reference, with a flag in four levels."""
    r, c = reference.select("column", F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std")), current.select("column", "mean")
    z = F.when(F.col("ref_std") > 0, (F.col("mean") - F.col("ref_mean")) / F.col("ref_std"))
    level = F.when(F.abs(z) < 0.5, "ok").when(F.abs(z) < 1, "watch").when(F.abs(z) < 2, "warn").otherwise("alert")
    return r.join(c, "column").select("column", z.alias("sigmas"), F.when(z.isNull(), "undefined").otherwise(level).alias("level"))


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Average precision, ties in score taken as one step. Rows are first counted per distinct
    score, and distinct scores are ordered in parts."""
    by = by or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if by == ["_all"] else df
    steps = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("tp"), F.count("*").alias("n"))
    totals = steps.groupBy(*by).agg(F.sum("tp").alias("_tp"), F.sum("n").alias("_n"))
    steps = with_lower_sums(steps, by, score, ["tp", "n"]).join(totals, by)
    precision = (F.col("_tp") - F.col("lower_tp")) / (F.col("_n") - F.col("lower_n"))
    return steps.groupBy(*by).agg((F.sum(precision * F.col("tp")) / F.sum("tp")).alias("average_precision")).drop("_all")


def candles(ticks: DataFrame, by: list[str], time: str, price: str, tie: str, width: str = "1 minute") -> DataFrame:
    """Open, high, low, close and count per key and window of time."""
    start = F.window(F.col(time), width)["start"]
    order = F.struct(time, tie)
    return ticks.groupBy(*by, start.alias("start")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("n"))


def market_candles(ticks: DataFrame, by: list[str], time: str, prices: dict[str, str], volume: str, interest: str, tie: str, width: str = "1 minute") -> DataFrame:
    """by, end, <name>_open, _high, _low, _close of each of prices (name -> column, such as bid, ask and
    price), volume (the sum of a tick's) and open_interest (the last one) per key and window of time, which
    `end` closes. Nulls don't count: a window's open is its first known price."""
    order, agg = F.struct(time, tie), []
    for name, c in prices.items():
        known = F.when(F.col(c).isNotNull(), order)
        agg += [F.min_by(c, known).alias(f"{name}_open"), F.max(c).alias(f"{name}_high"), F.min(c).alias(f"{name}_low"), F.max_by(c, known).alias(f"{name}_close")]
    last = F.max_by(interest, F.when(F.col(interest).isNotNull(), order))
    w = F.window(F.col(time), width)
    return ticks.groupBy(*by, w.alias("_w")).agg(*agg, F.coalesce(F.sum(volume), F.lit(0)).alias("volume"), last.alias("open_interest")).select(*by, F.col("_w.end").alias("end"), *[f"{n}_{k}" for n in prices for k in ("open", "high", "low", "close")], "volume", "open_interest")


def _generator(*seed) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([int(x) & (2**64 - 1) for x in seed]))


#: Values are counted in units of 2^-BITS of the power of two above the greatest, so that sums are whole numbers in any order;
#: in draws as a high and a low part of LOW bits, of which floats add up exactly.
_BITS, _LOW = 36, 26


def cluster_bootstrap(trades: DataFrame, cluster: str, value: str, draws: int = 1000, seed: int = 7, leaf: int = 256) -> DataFrame:
    """mean, lo, hi (95 percent), p_nonneg of the mean by resampling whole clusters, with replacement and
    as many as there are: counts are exactly multinomial, and no partitioning or retry changes them.

    The clusters are the leaves of a binary tree over their hashes. A node's total is split
    binomially between its children by their numbers of clusters, with a generator seeded by the
    node; nodes of about `leaf` clusters deal theirs out at once. A task that has such a node
    repeats the splits on the way to it, so none needs the others' clusters. Sums over nodes are of whole
    numbers and meet per draw after a partial sum in each task."""
    value_ = F.col(value).cast("double")
    most = trades.agg(F.max(F.abs(value_))).first()[0] or 0.0
    unit = 2.0 ** (math.frexp(most)[1] - _BITS)
    whole = F.round(value_ / unit).cast("decimal(38,0)")
    h = F.xxhash64(F.col(cluster).cast("string"))
    sums = trades.groupBy(cluster).agg(F.coalesce(F.sum(whole), F.lit(0)).cast("bigint").alias("s"), F.count(value).alias("n")).select(F.col(cluster).cast("string").alias("c"), h.alias("h"), "s", "n")
    total = sums.count()
    depth = max(0, math.ceil(math.log2(max(total, 1) / leaf)))
    node = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("bigint")
    sums = sums.withColumn("node", node)
    # of each node on the way: clusters below its left child and below itself
    sizes = sums.groupBy("node").agg(F.count("*").alias("m"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))) if depth else F.explode(F.array().cast("array<int>"))
    way = sizes.select("node", "m", levels.alias("level"))
    above = way.withColumn("up", F.call_function("shiftright", "node", F.lit(depth) - F.col("level")))
    right = F.call_function("shiftright", "node", F.lit(depth - 1) - F.col("level")) % 2
    splits = above.groupBy("level", "up").agg(F.sum(F.when(right == 0, F.col("m")).otherwise(0)).alias("left"), F.sum("m").alias("of"))
    paths = above.join(splits, ["level", "up"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("level", "up", "left", "of"))).alias("path")).select(F.col("node").alias("leaf"), "path")

    def drawn(key, rows, way):
        counts = np.full(draws, total, np.int64)
        for step in way["path"][0].as_py() if way.num_rows else []:
            left = _generator(seed, step["level"], step["up"]).binomial(counts, step["left"] / step["of"])
            goes_right = key[0].as_py() >> (depth - 1 - step["level"]) & 1
            counts = counts - left if goes_right else left
        order = sorted(range(rows.num_rows), key=lambda k: (rows["h"][k].as_py(), rows["c"][k].as_py() or ""))
        s, n = (rows[x].to_numpy()[order] for x in ("s", "n"))
        generator, m, out = _generator(seed, depth, key[0].as_py(), 1), len(s), []
        parts = np.stack([s >> _LOW, s & ((1 << _LOW) - 1), n], 1).astype(float)
        for k in range(0, draws, 500):
            # so many clusters drawn with replacement in each draw
            some = counts[k : k + 500]
            at = np.repeat(np.arange(len(some)) * m, some) + generator.integers(0, m, some.sum())
            out.append(np.bincount(at, minlength=len(some) * m).reshape(-1, m) @ parts)
        high, low, seen = np.concatenate(out).astype(np.int64).T
        return pa.table({"draw": np.arange(draws), "high": high, "low": low, "n": seen})

    rows = sums.select("node", "c", "h", "s", "n").groupBy("node").cogroup(paths.groupBy("leaf")).applyInArrow(drawn, "draw long, high long, low long, n long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    mean = lambda s, n: s.cast("double") * F.lit(unit) / F.nullif(n, F.lit(0)).cast("double")
    means = rows.groupBy("draw").agg(mean(exact("high") * F.lit(2**_LOW) + exact("low"), F.sum("n")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    own = sums.agg(mean(exact("s"), F.sum("n")).alias("mean"))
    return means.agg(q.alias("q"), F.avg((F.col("m") >= 0).cast("double")).alias("p_nonneg")).crossJoin(own).select("mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "p_nonneg")


def scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, mean, scale (population std; 1 where it is 0)."""
    d = distribution(df, columns).select("column", "mean", "std")
    return d.select("column", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("scale"))


def overlap(a: DataFrame, b: DataFrame, key: str, a_time: str, b_time: str) -> DataFrame:
    """Per key: bounds of both streams, the lead of b's start, the share of a's span b covers, ok."""
    x = a.groupBy(key).agg(F.min(a_time).alias("a_start"), F.max(a_time).alias("a_end"))
    y = b.groupBy(key).agg(F.min(b_time).alias("b_start"), F.max(b_time).alias("b_end"))
    rows = x.join(y, key)
    common = F.greatest(F.least("a_end", "b_end") - F.greatest("a_start", "b_start"), F.lit(0))
    span = F.col("a_end") - F.col("a_start")
    return rows.withColumn("lead", F.col("a_start") - F.col("b_start")).withColumn("coverage", F.when(span > 0, common / span).otherwise(1.0)).withColumn("ok", F.col("coverage") >= 0.9)


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, nulls, zeros, share_zero in one pass."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns], *[F.count_if(F.col(c) == 0).alias(f"z_{c}") for c in columns])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"z_{c}").alias("zeros")) for c in columns])).alias("_r")).select("_r.column", "rows", "_r.nulls", "_r.zeros", (F.col("_r.zeros") / F.col("rows")).alias("share_zero"))


def counted_filter(df: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows for which all conditions hold, and counts made in passing: rows, kept, and for each
    condition the rows that fail it and none before it (null counts as failing). The counts are
    there once the frame has been written or collected; it is read once."""
    fails = {name: ~F.coalesce(c, F.lit(False)) for name, c in conditions.items()}
    first = F.coalesce(*[F.when(f, F.lit(name)) for name, f in fails.items()]) if fails else F.lit(None).cast("string")
    names, seen = set(df.columns), Observation()
    why = next(f"_why{k}" for k in range(len(names) + 1) if f"_why{k}" not in names)
    rows = df.withColumn(why, first).observe(seen, F.count("*").alias("rows"), F.count_if(F.col(why).isNull()).alias("kept"), *[F.count_if(F.col(why) == n).alias(f"dropped_{n}") for n in conditions])
    return rows.where(F.col(why).isNull()).drop(why), seen


def quality_suite(df: DataFrame, required: list[str], identities: dict[str, Column], spreads: list[str], accuracy: int = 10_000) -> tuple[DataFrame, Observation]:
    """df unchanged, and checks of it made in passing: rows, nulls_<column> of required columns,
    broken_<name> of identities (a condition that must hold; null isn't broken), and of each column of
    spreads its least and greatest value and p01_, p50_, p99_ (approximate, relative error
    1 / accuracy)."""
    seen = Observation()
    p = lambda c: F.percentile_approx(c, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)), accuracy)
    checks = [F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in required], *[F.count_if(~c).alias(f"broken_{n}") for n, c in identities.items()]]
    for c in spreads:
        checks += [F.min(c).alias(f"least_{c}"), F.max(c).alias(f"greatest_{c}"), *[p(c)[k].alias(f"p{s}_{c}") for k, s in enumerate(("01", "50", "99"))]]
    return df.observe(seen, *checks), seen


def fan_out(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once: a join on them would add rows."""
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def share_weighted_impact(rows: DataFrame, by: list[str], game: str, player: str, amount: str, ratings: DataFrame, rating: str) -> DataFrame:
    """by, impact: over players the mean share of their side's amount per game, times their rating,
    absolute, summed. ratings: player, rating, one row each."""
    per = rows.groupBy(*by, game, player).agg(F.sum(amount).alias("_own"))
    side = per.groupBy(*by, game).agg(F.sum("_own").alias("_all"))
    share = per.join(side, [*by, game]).groupBy(*by, player).agg(F.avg(F.col("_own") / F.nullif(F.col("_all"), F.lit(0))).alias("_share"))
    return share.join(ratings.select(player, rating), player).groupBy(*by).agg(F.sum(F.abs(F.col("_share") * F.col(rating))).alias("impact"))
