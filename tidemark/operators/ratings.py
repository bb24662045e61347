"""Ratings that are carried from night to night."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import io
from .folds import Machine, unfolded

STATE = "level double, n long"
#: An update's latest as_of names its folder.
FOLDER = "until_as_of"


def advanced(state: DataFrame, games: DataFrame, key: str, as_of: str, order: list[str], x: str, start: float, least_alpha: float = 0.05) -> DataFrame:
    """key, as_of, level, n: the rows that games add to the state, which has the same columns.

    The adaptive average of with_ewma after each key's last game of an as_of: alpha_n =
    max(least, 2 / (n + 2)) for its n-th game. The fold goes on from each key's latest level and n,
    so only new games are read. Games of an as_of that the state holds already are left out, so a
    repeated night adds nothing; a game before its key's latest as_of raises, as the rows after it
    would be wrong. A null x counts as a game and leaves the level. Games without a key or as_of go."""
    kind = games.schema[as_of].dataType.simpleString()
    new = games.where(F.col(key).isNotNull() & F.col(as_of).isNotNull()).join(state.select(as_of).distinct(), as_of, "left_anti")
    last = state.groupBy(key).agg(F.max(F.struct(F.col(as_of).alias("a"), F.col("n").alias("n"), F.col("level").alias("level"))).alias("s"))
    took = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    rows = new.select(F.col(key).alias("k"), F.lit(1).alias("kind"), F.col(as_of).alias("a"), *took, F.col(x).cast("double").alias("x"), F.lit(None).cast("long").alias("n"))
    held = last.join(new.select(key).distinct(), key, "left_semi").select(F.col(key).alias("k"), F.lit(0).alias("kind"), "s.a", *[F.lit(None).cast(new.schema[c].dataType).alias(f"o{i}") for i, c in enumerate(order)], F.col("s.level").alias("x"), "s.n")

    def step(at, row):
        first, day, value, n = row
        if first == 0:
            at["level"], at["n"], at["day"] = value, n, day
            return []
        if at["day"] is not None and day < at["day"]:
            raise ValueError(f"a game of {day} comes after the state of {at['day']}")
        at["n"] += 1
        alpha = max(least_alpha, 2.0 / (at["n"] + 2.0))
        if value == value:  # a null is NaN here
            at["level"] = alpha * value + (1.0 - alpha) * at["level"]
        at["day"] = day
        return [(day, at["level"], at["n"])]

    machine = Machine(step, lambda: {"level": float(start), "n": 0, "day": None})
    out = unfolded(rows.unionByName(held), ["k"], ["kind", "a", *[f"o{i}" for i in range(len(order))]], ["kind", "a", "x", "n"], machine, f"a {kind}, level double, n long")
    last = out.groupBy("k", "a").agg(F.max(F.struct("n", "level")).alias("s"))
    return last.select(F.col("k").alias(key), F.col("a").alias(as_of), "s.level", "s.n")


def nightly(games: DataFrame, path: str, key: str, as_of: str, order: list[str], x: str, start: float, least_alpha: float = 0.05) -> DataFrame:
    """The table at path (made if it isn't there) after the games, with a folder for each update. The
    folder is moved in when the update ends, so one that is killed leaves the table as it was, and
    one that is run again, or twice, changes nothing more."""
    spark = games.sparkSession
    kinds = {c: games.schema[c].dataType.simpleString() for c in (key, as_of)}
    schema = f"{key} {kinds[key]}, {as_of} {kinds[as_of]}, {STATE}"
    until = games.agg(F.max(F.col(as_of)).cast("string")).first()[0]
    added = advanced(io.table_at(spark, path, schema), games, key, as_of, order, x, start, least_alpha)
    io.write_groups(added.withColumn(FOLDER, F.lit(until).cast("string")), path, [FOLDER])
    return io.table_at(spark, path, schema)
