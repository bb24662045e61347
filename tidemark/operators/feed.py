"""The feed of a game's events: its tables, rows that are built again, and features written back to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def event_tables(events: DataFrame, keys: list[str], teams: list[tuple[str, str]], kind: str = "kind", sub: str = "sub", said: str = "text", team: str = "team", player: str = "player", home: str = "home", away: str = "away") -> dict[str, DataFrame]:
    """fouls, substitutions and timeouts of a feed, keys in front. Fouls: team, player, foul_type,
    text. Substitutions: team, player_out (the event's player), came and went (names from the
    text "SUB: X FOR Y", null in others). Timeouts: team (from the text's nickname, by teams), timeout_type
    (Regular if none is given), full_left (-1 if unknown). Kinds compare without case."""
    of = lambda name: events.where(F.lower(kind) == name)
    names = T.substituted(F.col(said))
    fouls = of("foul").select(*keys, F.col(team).alias("team"), F.col(player).alias("player"), F.col(sub).alias("foul_type"), F.col(said).alias("text"))
    subs = of("substitution").select(*keys, F.col(team).alias("team"), F.col(player).alias("player_out"), names["came"].alias("came"), names["went"].alias("went"))
    calls = T.with_timeout_team(of("timeout").select(*keys, F.col(sub).alias("timeout_type"), F.col(said).alias("said"), F.col(home).alias("home"), F.col(away).alias("away")), teams, "said", "home", "away", "team")
    kind_ = F.coalesce(F.nullif(F.col("timeout_type"), F.lit("")), F.lit("Regular"))
    calls = calls.select(*keys, "team", kind_.alias("timeout_type"), T.full_timeouts(F.col("said")).alias("full_left"))
    return {"fouls": fouls, "substitutions": subs, "timeouts": calls}


def corrected_rows(rows: DataFrame, parts: list[tuple[DataFrame, dict[str, Column], dict[str, object]]], on: list[str]) -> DataFrame:
    """rows (one for each `on`) with what parts hold of the same keys. A part: a table of events, its
    aggregates by name, and what each is where a row has no event. Each part is summed by key before it
    joins, so no row is multiplied and none is lost; null keys find nothing."""
    for events, sums, fills in parts:
        each = events.groupBy(*on).agg(*[c.alias(name) for name, c in sums.items()])
        rows = rows.join(each, on, "left").withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in fills.items()})
    return rows


def write_back(feed: DataFrame, features: DataFrame, on: list[str], by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The feed with columns: features' own where a feed row has their key, else those of the last row
    before it in its group that has a value, column by column. Columns of the same names that the
    feed has are replaced, so writing back twice gives the same. features has one row for each key."""
    taken = {c: f"_new_{k}" for k, c in enumerate(columns)}
    found = features.select(*on, *[F.col(c).alias(n) for c, n in taken.items()])
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = feed.drop(*columns).join(found, on, "left")
    return rows.withColumns({c: F.last(n, ignorenulls=True).over(w) for c, n in taken.items()}).drop(*taken.values())
