"""Folds hold a key's state, not its rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replay, sequences, windows

HOT = 120_000


@pytest.fixture(scope="module")
def hot(spark):
    """Most rows in one key, more than an Arrow batch takes; few in another."""
    rows = spark.range(HOT).select(F.when(F.col("id") % 1000 == 0, 2).otherwise(1).alias("k"), "id", F.pmod(F.xxhash64("id"), F.lit(HOT * 10)).alias("s"))
    return rows.withColumns({"e": F.col("s") + 35, "went": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(11)), "came": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(13))}).cache()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def in_order(hot):
    out = {}
    for r in sorted(hot.collect(), key=lambda r: (r.k, r.s, r.id)):
        out.setdefault(r.k, []).append(r)
    return out.values()


def test_non_overlap_of_a_hot_key(hot):
    got = replay.non_overlapping(hot, ["k"], "s", "e", "id")
    assert "collect_list" not in plan(got)
    want = set()
    for rows in in_order(hot):
        free = -1
        for r in rows:
            if r.s >= free:
                want.add(r.id)
                free = r.e
    assert got.columns == hot.columns
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_adaptive_average_of_a_hot_key(hot):
    got = windows.with_ewma(hot, ["k"], ["s", "id"], "came", "level", 5.0)
    assert "collect_list" not in plan(got)
    want = {}
    for rows in in_order(hot):
        level = 5.0
        for n, r in enumerate(rows, 1):
            want[r.id] = level
            alpha = max(0.05, 2 / (n + 2))
            level = alpha * r.came + (1 - alpha) * level
    assert {r.id: r.level for r in got.collect()} == pytest.approx(want)


def test_lineups_of_a_hot_key(hot):
    got = sequences.lineups(hot, ["k"], ["s", "id"], "came", "went", [0, 1, 2, 3, 4])
    assert "collect_list" not in plan(got)
    want = {}
    for rows in in_order(hot):
        now = [0, 1, 2, 3, 4]
        for r in rows:
            if r.went in now and r.came not in now:
                now = sorted({*now, r.came} - {r.went})
            want[r.id] = now
    assert {r.id: r.lineup for r in got.collect()} == want


def test_nulls_in_folds(spark):
    rows = [(None, 1, 0, None), (None, 2, 5, 9), (None, 3, 6, 20), (1.0, 4, None, 5), (1.0, 5, 4, 9), (1.0, 6, 5, 9), (float("nan"), 7, 0, 9), (float("nan"), 8, 1, 9)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k double, id long, s long, e long")
    assert sorted(r.id for r in replay.non_overlapping(df, ["k"], "s", "e", "id").collect()) == [1, 2, 4, 6, 7]
    out = {r.id: r.a for r in windows.with_ewma(df, ["k"], ["id"], "e", "a", 3.0).collect()}
    assert out[2] == 3.0 and out[3] == pytest.approx(0.5 * 9 + 0.5 * 3)
