"""Operators of the inventory that have no query, and what the README says is left out."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import windows
from tidemark.plans import registry


def test_match_minute_freezes_at_half_time(spark):
    kickoff = datetime(2026, 3, 1, 15)
    rows = [(kickoff + timedelta(minutes=m), kickoff) for m in (-5, 0, 30, 45, 50, 60, 61.5, 100)]
    df = spark.createDataFrame(rows, "now timestamp, kickoff timestamp")
    out = df.select("now", X.match_minute(F.col("now"), F.col("kickoff")).alias("m")).orderBy("now").collect()
    assert [r.m for r in out] == [0, 0, 30, 45, 45, 45, 46.5, 85]


def test_average_pace_counts_rows_up_to_the_game(spark):
    rows = [(1, "a", "b", 10.0), (1, "a", "b", 20.0), (1, "a", "b", 0.0), (2, "c", "a", 30.0), (3, "b", "c", None), (1, "d", "e", 0.0)]
    out = windows.average_pace(spark.createDataFrame(rows, "g long, home string, away string, p double"), "home", "away", "g", "p")
    assert {(r.team, r.game): r.pace for r in out.collect()} == {("a", 1): 15, ("b", 1): 15, ("a", 2): 20, ("c", 2): 30, ("b", 3): 15, ("c", 3): 30, ("d", 1): 15, ("e", 1): 15}


def test_names_claim_no_more_than_is_built():
    text = (Path(__file__).parent.parent / "README.md").read_text()
    ids = {part for q in registry.QUERIES for part in q.split("_")}
    for name in ("s17", "s19"):
        assert name not in ids, name
    left = text.split("- In part or without a query:")[1].split("\n\n")[0]
    for name in ("S8", "S17", "S19"):
        assert name in left


def test_corrected_rows_and_write_back_keep_every_row(spark):
    from tidemark.operators import feed

    rows = spark.createDataFrame([("g", 0), ("g", 1), ("h", 0), (None, 0)], "game string, p int")
    fouls = spark.createDataFrame([("g", 0, True), ("g", 0, False), (None, 0, True)], "game string, p int, hard boolean")
    out = feed.corrected_rows(rows, [(fouls, {"n": F.count("*"), "hard": F.max("hard")}, {"n": 0, "hard": False})], ["game", "p"])
    assert sorted(map(tuple, out.collect()), key=str) == [("g", 0, 2, True), ("g", 1, 0, False), ("h", 0, 0, False), (None, 0, 0, False)]
    log = spark.createDataFrame([("g", i, 9) for i in range(5)] + [("h", 7, 9)], "game string, i int, v int")
    new = spark.createDataFrame([("g", 1, 10, None), ("g", 3, None, "x")], "game string, i int, v int, w string")
    once = feed.write_back(log, new, ["game", "i"], ["game"], ["i"], ["v", "w"])
    want = [("g", 0, None, None), ("g", 1, 10, None), ("g", 2, 10, None), ("g", 3, 10, "x"), ("g", 4, 10, "x"), ("h", 7, None, None)]
    assert sorted(map(tuple, once.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, feed.write_back(once, new, ["game", "i"], ["game"], ["i"], ["v", "w"]).collect()), key=str) == sorted(want, key=str)
