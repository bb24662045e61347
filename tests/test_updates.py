"""Updates that resume: nightly ratings, tables that are swapped in, ledgers, and counts in passing."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggs, ratings, replay, windows
from tidemark.sources import io
from tidemark.streaming import stream

GAMES = "team string, day int, no long, x double"


def games():
    rng = random.Random(2)
    return [(rng.choice(["a", "b", "c"]), d, 10 * d + k, rng.choice([None, float(rng.randrange(200))])) for d in range(12) for k in range(rng.randrange(1, 5))] + [(None, 3, 999, 1.0)]


def recounted(rows):
    out = {}
    for team in ("a", "b", "c"):
        level, n = 100.0, 0
        for _, d, _, x in sorted((r for r in rows if r[0] == team), key=lambda r: r[1:3]):
            n += 1
            alpha = max(0.05, 2 / (n + 2))
            level = level if x is None else alpha * x + (1 - alpha) * level
            out[team, d] = (round(level, 9), n)
    return out


def told(df):
    return {(r.team, r.day): (round(r.level, 9), r.n) for r in df.collect()}


def test_night_by_night_equals_all_at_once(spark, tmp_path):
    rows = games()
    df = spark.createDataFrame(rows, GAMES)
    want = recounted(rows)
    assert told(ratings.nightly(df, f"{tmp_path}/all", "team", "day", ["no"], "x", 100.0)) == want
    for nights in ([0, 1, 2], [3], [3], [4, 5, 6, 7], [1], [8, 9, 10, 11]):
        out = ratings.nightly(df.where(F.col("day").isin(nights)), f"{tmp_path}/each", "team", "day", ["no"], "x", 100.0)
    assert told(out) == want and out.count() == len(want)
    assert told(ratings.nightly(df.where("false"), f"{tmp_path}/each", "team", "day", ["no"], "x", 100.0)) == want


def test_a_game_behind_the_state_raises_and_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 5, 1, 10.0), ("a", 3, 2, 20.0)], GAMES)
    first = told(ratings.nightly(df.where("day = 5"), f"{tmp_path}/t", "team", "day", ["no"], "x", 100.0))
    with pytest.raises(Exception, match="comes after the state"):
        ratings.nightly(df, f"{tmp_path}/t", "team", "day", ["no"], "x", 100.0)
    assert told(io.table_at(spark, f"{tmp_path}/t", f"team string, day int, {ratings.STATE}")) == first


def test_a_failed_swap_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    old, new = spark.range(5), spark.range(3)
    assert io.swap_table(old, path) == 5
    for bad, how in ((new, {"least": 4}), (new, {"rows": 5}), (new.select(F.raise_error(F.lit("no")).cast("long").alias("id")), {})):
        with pytest.raises(Exception, match="rows were written|no"):
            io.swap_table(bad, path, **how)
        assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    assert io.swap_table(spark.read.parquet(path).where("id > 1"), path, least=1) == 3 and spark.read.parquet(path).count() == 3
    Path(path).rename(f"{path}__old")  # killed between its two moves
    assert io.table_at(spark, path, "id long").count() == 3


def test_groups_are_replaced_and_others_stay(spark, tmp_path):
    path = f"{tmp_path}/t"
    io.write_groups(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v int, g string"), path, ["g"])
    io.write_groups(spark.createDataFrame([(9, "a"), (7, "c")], "v int, g string"), path, ["g"])
    with pytest.raises(Exception, match="broken"):
        io.write_groups(spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken")).cast("int")).otherwise(1).alias("v"), F.lit("b").alias("g")), path, ["g"])
    assert sorted((r.v, r.g) for r in io.table_at(spark, path, "v int, g string").collect()) == [(3, "b"), (7, "c"), (9, "a")]


def test_patched_table_with_a_backup(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, v string, w int").write.parquet(path)
    fixes = spark.createDataFrame([(1, "A"), (2, "b"), (3, None), (9, "z")], "k int, v string")
    assert io.patch_table(path, spark, fixes, ["k"], ["v"], f"{tmp_path}/kept") == {"before": 3, "after": 3, "changed": 1}
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "A", 1), (2, "b", 2), (3, None, 3)]
    assert {r.k for r in spark.read.parquet(f"{tmp_path}/kept").collect()} == {1, 2}


@pytest.mark.parametrize("blocks", [None, 1, 7, 1000])
def test_reflected_sums_are_those_of_a_loop(spark, blocks):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), i, rng.choice([None, *range(-5, 6)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, a int")
    block = None if blocks is None else F.floor(F.col("i") / blocks)
    got = {r.i: r.e for r in windows.reflected(df, ["g"], ["i"], F.col("a"), "e", block).collect()}
    everyone = {r.i: r.e for r in windows.reflected(df, [], ["i"], F.col("a"), "e", F.lit(0) if block is None else block).collect()}
    at, total = {}, 0
    for g, i, a in rows:
        at[g] = max(0, at.get(g, 0) + (a or 0))
        total = max(0, total + (a or 0))
        assert (got[i], everyone[i]) == (at[g], total)


def test_ledger_refuses_beyond_either_limit(spark):
    rows = [(1, "x", 60), (2, "x", 60), (3, "y", 50), (4, "x", -200), (5, "y", 90), (6, "y", 20)]
    df = spark.createDataFrame(rows, "i int, game string, a int")
    out = replay.ledger(df, "game", ["i"], F.col("a"), F.col("i"), 100, 130).orderBy("i").collect()
    assert [(r.game_exposure, r.total_exposure, r.refused) for r in out] == [(60, 60, False), (120, 120, True), (50, 170, True), (0, 0, False), (140, 90, True), (160, 110, True)]


def test_counts_in_passing_read_the_table_once(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, None), (3, 50), (None, 9), (4, 6)], "a int, _why0 int").write.parquet(f"{tmp_path}/t")
    rows, seen = aggs.counted_filter(spark.read.parquet(f"{tmp_path}/t"), {"small": F.col("_why0") < 10, "known": F.col("a").isNotNull()})
    assert rows.columns == ["a", "_why0"] and sorted(map(tuple, rows.collect())) == [(1, 5), (4, 6)]
    assert seen.get == {"rows": 5, "kept": 2, "dropped_small": 2, "dropped_known": 1}
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        aggs.counted_filter(rows, {"x": F.col("missing") > 1})
    whole, checks = aggs.quality_suite(spark.read.parquet(f"{tmp_path}/t"), ["a"], {"order": F.col("a") < F.col("_why0")}, ["a"])
    assert whole.count() == 5
    assert checks.get == {"rows": 5, "nulls_a": 1, "broken_order": 0, "least_a": 1, "greatest_a": 4, "p01_a": 1, "p50_a": 2, "p99_a": 4}


def test_sessions_leave_out_late_rows_and_count_them(spark, tmp_path):
    minutes = {0: [0, 3, 60], 1: [200, 203], 2: [5, 400], 3: [205, 10_000]}
    import os

    for k, ms in minutes.items():
        spark.createDataFrame([("u", m, 1.0) for m in ms], "u string, m int, v double").coalesce(1).write.parquet(f"{tmp_path}/raw{k}")
        (part,) = Path(f"{tmp_path}/raw{k}").glob("part*")
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    rows = stream.file_stream(spark, f"{tmp_path}/in", 1).withColumn("t", F.timestamp_seconds(F.col("m") * 60))
    with pytest.warns(UserWarning, match="1 rows came behind"):
        got = stream.drained(stream.sessions(rows, ["u"], "t", "v", "10 minutes", "30 minutes"))
    assert sorted((r.s, r.n) for r in got.select(F.unix_seconds("start").alias("s"), "n").collect()) == [(0, 2), (3600, 1), (12000, 3), (24000, 1)]


def test_versions_over_several_batches(spark):
    versions = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y"), ("a", 20, "z"), ("b", 5, None), (None, 1, "n"), ("a", None, "never")], "k string, since long, v string")
    asked = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate([("a", 9), ("a", 10), ("a", 19), ("a", 20), ("a", 99), ("b", 7), ("c", 7), (None, 7)])], "i int, k string, t long")
    rows = stream.sliced_stream(asked, "t", slices=3, files=2)
    got = {r.i: (r.v, r.since) for r in stream.drained(stream.enriched_as_of(rows, versions, "k", "t", "since", ["v", "since"])).collect()}
    assert got == {0: (None, None), 1: ("x", 10), 2: ("x", 10), 3: ("z", 20), 4: ("z", 20), 5: (None, 5), 6: (None, None), 7: (None, None)}
