"""Texts of events, tickers and quotes as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _folded(names: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower().strip() for x in names], dtype=object)


def normalized(name: Column) -> Column:
    """Lower case without accents, by canonical decomposition, which Spark has no function for."""
    return _folded(name)


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def with_name_lookup(rows: DataFrame, names: DataFrame, name: str, id_: str, out: str, unknown: int = -1) -> DataFrame:
    """rows with the id of the name, by the whole normalized name, else by its last word, else unknown.
    names: name, id. Of several with one key the smallest id counts. Both joins are on equal keys."""
    keyed = names.select(normalized(F.col(name)).alias("_n"), F.col(id_).cast("long").alias("_id"))
    whole = keyed.groupBy("_n").agg(F.min("_id").alias("_whole"))
    last = keyed.groupBy(F.element_at(F.split("_n", r"\s+"), -1).alias("_l")).agg(F.min("_id").alias("_last"))
    rows = rows.withColumn("_n", normalized(F.col(name))).withColumn("_l", F.element_at(F.split("_n", r"\s+"), -1))
    found = rows.join(whole, "_n", "left").join(last, "_l", "left")
    return found.withColumn(out, F.coalesce("_whole", "_last", F.lit(unknown))).drop("_n", "_l", "_whole", "_last")


def substituted(text: Column) -> Column:
    """struct(came, went) of "SUB: X FOR Y"; null fields of other texts."""
    part = lambda k: F.trim(F.regexp_extract(text, r"(?i)^SUB:\s+(.+?)\s+FOR\s+(.+)$", k))
    return F.struct(_or_null(part(1)).alias("came"), _or_null(part(2)).alias("went"))


def timeout_name(text: Column) -> Column:
    """The side's name before "Timeout:", in lower case."""
    return _or_null(F.lower(F.trim(F.regexp_extract(text, r"^([A-Za-z\s\d]+?)\s+Timeout:", 1))))


def full_timeouts(text: Column) -> Column:
    """n of "Full n", else -1."""
    return F.coalesce(_or_null(F.regexp_extract(text, r"(?i)Full\s+(\d+)", 1)).cast("int"), F.lit(-1))


def with_timeout_team(rows: DataFrame, teams: list[tuple[str, str]], text: str, home: str, away: str, out: str = "team") -> DataFrame:
    """rows with the code of the side that called: its name exactly, else the first name in the list's
    order that the text's name holds, of the two sides of the game. teams: (nickname, code), a fixed list."""
    name = timeout_name(F.col(text))
    exact = F.lit(None).cast("string")
    for nick, code in reversed(teams):
        exact = F.when(name == nick, code).otherwise(exact)
    partly = F.coalesce(*[F.when(name.contains(nick) & ((F.col(home) == code) | (F.col(away) == code)), code) for nick, code in teams])
    return rows.withColumn(out, F.coalesce(exact, partly, F.lit("")))


def free_throw(text: Column, kind: Column) -> Column:
    """struct(n, m) of "n of m"; a technical one is 1 of 1; null fields of other texts."""
    technical = F.lower(kind).contains("technical")
    part = lambda k: F.when(technical, 1).otherwise(_or_null(F.regexp_extract(text, r"(?i)(\d+)\s+of\s+(\d+)", k)).cast("int"))
    return F.struct(part(1).alias("n"), part(2).alias("m"))


def ticker_tail(ticker: Column) -> Column:
    """struct(day, away, home, team, points), by places: the last character is the points, what is
    before it the team, so that two-digit points give another team than parse_ticker's."""
    parts = F.split(ticker, "-")
    middle, tail = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    fine = (F.size(parts) == 3) & (F.length(middle) >= 13) & tail.rlike(r"\d$")
    day = F.to_date(F.initcap(F.lower(F.regexp_replace(F.substring(middle, 1, 7), r"^(\d{2})([A-Z]{3})(\d{2})$", "$1-$2-$3"))), "yy-MMM-dd")
    text = lambda c: F.when(fine, c)
    return F.struct(text(day).alias("day"), text(F.substring(middle, 8, 3)).alias("away"), text(F.substring(middle, 11, 3)).alias("home"), text(F.regexp_extract(tail, r"^(.*)\d$", 1)).alias("team"), text(F.regexp_extract(tail, r"(\d)$", 1)).cast("int").alias("points"))


def event_ticker(ticker: Column) -> Column:
    """struct(day, away, home) of an event's ticker like KX-26MAR05AAABBB."""
    part = lambda k: _or_null(F.regexp_extract(ticker, r"-(\d{2})([A-Z]{3})(\d{2})([A-Z]{3})([A-Z]{3})(?:-|$)", k))
    day = F.to_date(F.concat_ws("-", part(1), F.initcap(F.lower(part(2))), part(3)), "yy-MMM-dd")
    return F.struct(F.when(part(1).isNotNull(), day).alias("day"), part(4).alias("away"), part(5).alias("home"))


def market_spread(ticker: Column) -> Column:
    """struct(team, points) of a market's ticker that ends in -AAA7; ('', 0) of others."""
    part = lambda k: F.regexp_extract(ticker, r"-([A-Z]{3})(\d+)$", k)
    return F.struct(part(1).alias("team"), F.coalesce(_or_null(part(2)).cast("int"), F.lit(0)).alias("points"))


def quote_messages(rows: DataFrame, message: str, ticker: str = "market_ticker") -> DataFrame:
    """Quote messages (JSON with dollars and contracts as texts or numbers) as ticks in cents; those
    without a ticker or a bid go."""
    m = F.from_json(message, f"{ticker} string, yes_bid_dollars string, yes_ask_dollars string, price_dollars string, volume_fp string, open_interest_fp string")
    number = lambda name, by: F.coalesce(F.bround(F.col(f"_m.{name}").try_cast("double") * by).cast("int"), F.lit(0))
    out = rows.withColumn("_m", m).withColumns({ticker: F.col(f"_m.{ticker}"), "yes_bid": number("yes_bid_dollars", 100), "yes_ask": number("yes_ask_dollars", 100), "yes_last": number("price_dollars", 100), "volume": number("volume_fp", 1), "open_interest": number("open_interest_fp", 1)})
    return out.where(F.col(ticker).isNotNull() & (F.col(ticker) != "") & (F.col("yes_bid") != 0)).drop("_m", message)
