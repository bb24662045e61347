"""Small literal cases, with negative controls, that SQL comparison can't show."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import aggs, joins, labels, replay, ridge, sequences, windows
from tidemark.sources import io
from tidemark.streaming import stream


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("cents", "taker", "maker"), [(10, 0.63, 0.16), (20, 1.12, 0.28), (50, 1.75, 0.44), (85, 0.90, 0.23), (90, 0.63, 0.16)])
def test_fees_are_exact(spark, cents, taker, maker):
    row = one(spark, X.fee("0.07", F.lit(100), F.lit(cents)).alias("t"), X.fee("0.0175", F.lit(100), F.lit(cents)).alias("m"))
    assert (float(row.t), float(row.m)) == (taker, maker)


def test_fees_in_doubles_go_wrong():
    assert math.ceil(0.07 * 100 * 0.1 * 0.9 * 100) / 100 != 0.63


@pytest.fixture
def ticks(spark):
    return spark.createDataFrame([("g", 0, 50), ("g", 10, 51), ("g", 25, 52), ("g", 40, 53)], "game string, t long, bid int")


def test_asof_anchor_and_tolerance(spark, ticks):
    left = spark.createDataFrame([("g", 20), ("g", 80), ("h", 20)], "game string, at long")
    for chunk in (None, 7, 1000):
        out = joins.asof_join(left, ticks, ["game"], "at", "t", {"bid": "bid", "t": "seen"}, tolerance=30, chunk=chunk).collect()
        assert {(r.game, r.at): (r.bid, r.seen) for r in out} == {("g", 20): (51, 10), ("g", 80): (None, None), ("h", 20): (None, None)}
    out = joins.asof_join(left, ticks, ["game"], "at", "t", {"bid": "bid"}, direction="forward", chunk=7).collect()
    assert {(r.game, r.at): r.bid for r in out} == {("g", 20): 52, ("g", 80): None, ("h", 20): None}


def test_nearest_takes_the_earlier_of_equals(spark):
    left = spark.createDataFrame([("g", 15)], "game string, at long")
    right = spark.createDataFrame([("g", 10, "a"), ("g", 20, "b")], "game string, t long, v string")
    assert joins.asof_nearest(left, right, ["game"], "at", "t", {"v": "v"}).first().v == "a"
    assert joins.asof_nearest(left, right, ["game"], "at", "t", {"v": "v"}, most=4).first().v is None


@pytest.mark.parametrize(("side", "price", "exit_price"), [(1, 64, 55.0), (-1, 36, 45.0)])
def test_take_profit_is_clamped(spark, side, price, exit_price):
    entries = spark.createDataFrame([("g", 1, 0, side, 50)], "game string, id long, start long, side int, entry int")
    ticks = spark.createDataFrame([("g", 30, price, 1)], "game string, t long, bid int, n long")
    out = labels.first_breach(entries, ticks, ["game"], "id", "start", "side", "entry", "t", "bid", "n", 240, 5.0, 3.0).first()
    assert (out.exit_reason, out.exit_time, out.exit_price) == ("tp", 30, exit_price)


def test_flip_waits_until_it_is_known(spark):
    entries = spark.createDataFrame([("g", 1, 0, 1, 50, "home")], "game string, id long, start long, side int, entry int, entry_team string")
    ticks = spark.createDataFrame([("g", t, 51, t) for t in (10, 20, 30)], "game string, t long, bid int, n long")
    for delay, at in ((0, 10), (15, 20), (25, 30)):
        flips = spark.createDataFrame([("g", 5 + delay, "away", False)], "game string, known_at long, run_side string, off boolean")
        out = labels.first_breach(entries, ticks, ["game"], "id", "start", "side", "entry", "t", "bid", "n", 240, 5.0, 3.0, flips).first()
        assert (out.exit_reason, out.exit_time) == ("flip", at)


def test_checkpoints_round_half_to_even(spark):
    assert one(spark, labels.checkpoint_offsets(5, 2).alias("k")).k == [2, 5]


def test_streak_before_the_row(spark):
    rows = spark.createDataFrame([("g", 1, "home", 2), ("g", 2, "home", 0), ("g", 3, "home", 3), ("g", 4, "away", 2), ("g", 5, "home", 0)], "game string, n int, team string, p int")
    out = windows.with_streak(rows, ["game"], ["n"], "team", F.col("p")).orderBy("n").collect()
    assert [(r.streak_side, r.streak_length, r.streak_points) for r in out] == [("", 0, 0), ("home", 1, 2), ("home", 1, 2), ("home", 2, 5), ("away", 1, 2)]


def test_time_window_is_left_open(spark):
    rows = spark.createDataFrame([("g", 0), ("g", 60_000_000), ("g", 60_000_001)], "game string, us long")
    out = rows.select("us", windows.trailing("count", F.lit(1), ["game"], F.col("us"), 60_000_000).alias("n")).orderBy("us").collect()
    assert [r.n for r in out] == [1, 1, 2]


def test_non_overlap(spark):
    rows = spark.createDataFrame([("g", 1, 0, 10), ("g", 2, 5, 8), ("g", 3, 10, 20), ("g", 4, 19, 30), ("g", 5, 20, 21)], "game string, id long, s long, e long")
    assert sorted(r.id for r in replay.non_overlapping(rows, ["game"], "s", "e", "id").collect()) == [1, 3, 5]


def test_trajectory_aggregates(spark):
    t = F.array(*[F.lit(x) for x in (0.1, -0.5, 0.5, 0.2)])
    assert one(spark, replay.AGGREGATORS["max_abs"](t).alias("x"), replay.AGGREGATORS["final"](t).alias("y")).asDict() == {"x": -0.5, "y": 0.2}


def test_lineup_fold(spark):
    subs = spark.createDataFrame([("g", 1, 7, 2), ("g", 2, 8, 99), ("g", 3, 2, 7)], "game string, n int, came long, went long")
    out = sequences.lineups(subs, ["game"], ["n"], "came", "went", [1, 2, 3]).orderBy("n").collect()
    assert [r.lineup for r in out] == [[1, 3, 7], [1, 3, 7], [1, 2, 3]]


def test_set_id_and_clocks(spark):
    row = one(spark, X.set_id(F.array(F.lit(203999), F.lit(2544))).alias("i"), X.clock_seconds(F.lit("PT11M40.00S")).alias("c"), X.clock_seconds(F.lit("x")).alias("bad"), X.display_minutes(F.lit("90'+14'")).alias("m"))
    assert (row.i, row.c, row.bad, row.m) == ("727f7d514f5e", 700.0, None, 104.0)


def test_patch_refuses_conflicts(spark):
    old = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    fine = spark.createDataFrame([(1, 9)], "k int, v int")
    assert {tuple(r) for r in io.patch(old, fine, ["k"], ["v"]).collect()} == {(1, 9), (2, 6)}
    with pytest.raises(Exception, match="conflicting"):
        io.patch(old, fine.union(spark.createDataFrame([(1, 8)], "k int, v int")), ["k"], ["v"]).collect()


def test_paired_refuses_other_keys(spark):
    a = spark.createDataFrame([(1, 5)], "k int, v int")
    for other in ([(2, 5)], [(1, 5), (1, 6)], []):
        with pytest.raises(Exception, match="don't have the same keys"):
            joins.paired(a, spark.createDataFrame(other, "k int, w int"), ["k"]).collect()
    assert joins.paired(a, spark.createDataFrame([(1, 7)], "k int, w int"), ["k"]).collect() == [(1, 5, 7)]


def test_ridge_matches_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=400) * 0.1
    day = np.repeat(np.arange(8), 50)
    df = spark.createDataFrame([(int(d), float(a), float(b), float(c)) for d, (a, b), c in zip(day, x, y)], "day int, a double, b double, y double")
    out = ridge.rolling_ridge(df, "day", ["a", "b"], "y", alpha=10.0, half_life=3.0, every=1, at_least=50).toPandas()
    w = 0.5 ** ((7 - day) / 3.0)[day < 7]
    m = np.hstack([np.ones((350, 1)), x[:350]])
    want = np.linalg.solve((m * w[:, None]).T @ m + np.diag([0, 10, 10]), (m * w[:, None]).T @ y[:350])
    got = out[out.as_of == 7].set_index("feature").coefficient
    assert np.allclose([got["a"], got["b"]], want[1:])


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("c"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("v"))
    row = aggs.cluster_bootstrap(df, "c", "v", 300).first()
    assert row.lo < row["mean"] < row.hi and row.p_nonneg == 1.0


@pytest.mark.parametrize("leaf", [16, 10_000])
def test_bootstrap_is_multinomial_and_of_no_partitioning(spark, leaf):
    import numpy as np

    df = spark.range(3001).select((F.col("id") % 301).alias("c"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0 - 60).alias("v"))
    rows = [tuple(aggs.cluster_bootstrap(df.repartition(k), "c", "v", 2000, leaf=leaf).first()) for k in (2, 8, 31)]
    assert rows[0] == rows[1] == rows[2]
    pdf = df.toPandas().groupby("c").v.agg(["sum", "count"]).to_numpy()
    counts = np.random.default_rng(1).multinomial(301, np.full(301, 1 / 301), 2000)
    means = (counts @ pdf[:, 0]) / (counts @ pdf[:, 1])
    mean, lo, hi, share = rows[0]
    assert mean == pytest.approx(pdf[:, 0].sum() / 3001, abs=1e-7)
    sd = means.std()
    assert abs(lo - np.quantile(means, 0.025)) < 0.3 * sd and abs(hi - np.quantile(means, 0.975)) < 0.3 * sd
    assert abs(share - (means >= 0).mean()) < 0.05


def test_bootstrap_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0), ("b", None), ("b", None)], "c string, v double")
    row = aggs.cluster_bootstrap(df, "c", "v", 200).first()
    assert row["mean"] == 2.0 and 1 <= row.lo <= row.hi <= 3
    assert aggs.cluster_bootstrap(df.where("false"), "c", "v", 50).first()["mean"] is None


def test_sparse_ridge_of_a_thousand_players(spark):
    """Line-ups of ten, against the closed form over all players at once."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, players = 6000, 1000
    crews = np.array([rng.choice(players, 10, replace=False) for _ in range(n)])
    signs = np.repeat([[1.0] * 5 + [-1.0] * 5], n, 0)
    game = np.arange(n) // 500
    y = rng.normal(size=n) + rng.normal(size=players)[crews[:, :5]].sum(1)
    df = spark.createDataFrame([(int(g), [(str(int(p)), float(s)) for p, s in zip(c, ss)], float(v)) for g, c, ss, v in zip(game, crews, signs, y)], "g int, crew array<struct<k: string, v: double>>, y double")
    out = ridge.sparse_rolling_ridge(df, "g", F.col("crew"), "y", alpha=100.0, half_life=5.0, every=4).toPandas()
    assert sorted(set(out.as_of)) == [4, 8]
    for at in (4, 8):
        seen = game < at
        x = np.zeros((seen.sum(), players + 1))
        x[np.arange(len(x))[:, None], crews[seen]] = signs[seen]
        x[:, -1] = 1
        w = 0.5 ** ((at - game[seen]) / 5.0)
        want = np.linalg.solve((x * w[:, None]).T @ x + np.diag([100.0] * players + [0.0]), (x * w[:, None]).T @ y[seen])
        got = out[out.as_of == at].set_index("feature").coefficient
        met = sorted(set(crews[seen].ravel()))
        assert len(got) == len(met) and np.abs(got[[str(p) for p in met]].to_numpy() - want[met]).max() < 1e-6


def test_sparse_ridge_of_awkward_rows(spark):
    """Repeated features of a row add up; nulls don't count; groups stand alone; no rows give none."""
    kind = "by string, o double, crew array<struct<k: string, v: double>>, y double"
    rows = [(g, float(o), [("a", 1.0), ("a", 1.0), (None, 5.0), ("b", None)] if o % 2 else [("b", 1.0)], 10.0 + o if g else None) for g in ("x", None) for o in range(8)]
    rows += [("x", None, [("a", 1.0)], 3.0), ("x", 1.0, None, 4.0)]
    df = spark.createDataFrame(rows, kind)
    out = ridge.sparse_rolling_ridge(df, "o", F.col("crew"), "y", alpha=2.0, half_life=4.0, every=7, at_least=3, by="by").collect()
    import numpy as np

    o = np.array([0, 1, 2, 3, 4, 5, 6, 1.0])
    x = np.array([[0, 1, 1], [2, 0, 1], [0, 1, 1], [2, 0, 1], [0, 1, 1], [2, 0, 1], [0, 1, 1], [0, 0, 1.0]])
    y, w = np.array([10, 11, 12, 13, 14, 15, 16, 4.0]), 0.5 ** ((7 - o) / 4)
    want = np.linalg.solve((x * w[:, None]).T @ x + np.diag([2.0, 2, 0]), (x * w[:, None]).T @ y)
    assert {(r.by, r.as_of, r.feature): (round(r.coefficient, 8), r.n) for r in out} == {("x", 7.0, "a"): (round(want[0], 8), 8), ("x", 7.0, "b"): (round(want[1], 8), 8)}
    assert ridge.sparse_rolling_ridge(df.where("false"), "o", F.col("crew"), "y").count() == 0


def test_sparse_ridge_of_many_parts(spark, monkeypatch):
    """A group of more pairs than one task takes is solved in blocks by all, a smaller one beside it alone."""
    import numpy as np

    monkeypatch.setattr(ridge, "ALONE", 300)
    monkeypatch.setattr(ridge, "BLOCK", 500)
    monkeypatch.setattr(ridge, "PIECE", 64)
    rng = np.random.default_rng(5)
    kind = "by string, o double, crew array<struct<k: string, v: double>>, y double"
    data = {by: [(float(k // 20), rng.choice(25, 4, replace=False), rng.choice([-1.0, 1.0], 4), rng.normal() + 3) for k in range(rows)] for by, rows in (("x/1", 240), ("z", 40))}
    df = spark.createDataFrame([(by, o, [(str(int(f)), float(v)) for f, v in zip(c, s)], float(y)) for by, rows in data.items() for o, c, s, y in rows], kind)
    out = ridge.sparse_rolling_ridge(df, "o", F.col("crew"), "y", alpha=3.0, half_life=4.0, every=1, at_least=20, by="by").where("as_of in (1, 6, 11)")
    got = {(r.by, r.as_of, r.feature): (r.coefficient, r.n) for r in out.collect()}
    want = {}
    for by, rows in data.items():
        for at in {r[0] for r in rows} & {1.0, 6.0, 11.0}:
            seen = [r for r in rows if r[0] < at]
            x = np.zeros((len(seen), 26))
            x[:, 25] = 1
            for k, (_, c, s, _) in enumerate(seen):
                x[k, c] = s
            w = 0.5 ** ((at - np.array([r[0] for r in seen])) / 4)
            b = np.linalg.solve((x * w[:, None]).T @ x + np.diag([3.0] * 25 + [0.0]), (x * w[:, None]).T @ np.array([r[3] for r in seen]))
            want |= {(by, at, str(f)): (b[f], len(seen)) for f in np.flatnonzero(np.abs(x[:, :25]).sum(0))}
    assert got.keys() == want.keys() and len(want) > 90
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_exposure_of_equal_times(spark, tmp_path):
    """Rows that the order leaves equal are booked together, as in the SQL of l17_exposure and l17_daily_limits."""
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import registry

    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (1, TIMESTAMP '2026-01-02 03:00:00', 7, 'purchase', 90.0), (2, TIMESTAMP '2026-01-02 04:00:00', 7, 'purchase', 60.0), (2, TIMESTAMP '2026-01-02 04:00:00', 7, 'error', 55.0), (3, TIMESTAMP '2026-01-02 05:00:00', 7, 'view', 5.0)) AS t (event_id, ts, user_id, event_type, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    for name in ("l17_exposure", "l17_daily_limits"):
        got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted((i, *[float(x) for x in row[:-1]], row[-1]) for i, *row in con.execute(registry.ORACLE_SQL[name]).fetchall())


def test_lower_sums_halve_their_bounds(spark):
    """Sums over lower values are whole for any number of parts; no value is compared with every bound."""
    df = spark.createDataFrame([(g, float(k) if k else math.nan, k + 1) for g in "ab" for k in range(60)], "g string, x double, n long")
    for parts in (1, 5, 64):
        out = aggs.with_lower_sums(df, ["g"], "x", ["n"], parts)
        assert {(r.g, r.n): r.lower_n for r in out.collect()} == {(g, k + 1): sum(j + 1 for j in range(1, k or 60)) for g in "ab" for k in range(60)}
    assert "filter(_bounds" not in out._jdf.queryExecution().toString()


def test_files_in_and_out(spark, tmp_path):
    schema = "yes_bid int, volume long"
    (tmp_path / "t" / "2026-03-06").mkdir(parents=True)
    import pandas as pd

    pd.DataFrame({"yes_bid": pd.array([0, 7], "int32"), "volume": pd.array([1, None], "Int64")}).to_parquet(tmp_path / "t/2026-03-06/KX-A1.parquet")
    from pyspark.sql.types import StructType

    rows = io.quoted(io.tick_files(spark, str(tmp_path / "t"), StructType.fromDDL(schema))).collect()
    assert [(r.yes_bid, r.volume, r.market, str(r.day)) for r in rows] == [(7, 0, "KX-A1", "2026-03-06")]
    (tmp_path / "x.jsonl").write_text('{"event": "a", "n": 1}\nnot json\n{"event": "b", "n": 2}\n')
    assert io.json_lines(spark, str(tmp_path / "x.jsonl"), StructType.fromDDL("event string, n int")).count() == 2


def test_operators_keep_columns_of_their_own_names(spark):
    a = spark.createDataFrame([(1, 5, "u", 7)], "k int, t int, _rank string, _BUCKET int")
    assert joins.best_per_group(a, ["k"], [F.asc("t")]).collect() == [(1, 5, "u", 7)]
    b = spark.createDataFrame([(1, 8, 3, "f")], "k int, s int, v int, _found string")
    assert joins.range_join(a, b.select("k", "s"), ["k"], "t", "s", 10).select("_rank", "_BUCKET", "s").collect() == [("u", 7, 8)]
    named = a.withColumnRenamed("_rank", "_found")
    assert joins.lookup(named, b, ["k"], {"v": 0}, "there").select("_found", "v", "there").collect() == [("u", 3, True)]
    assert joins.paired(a.withColumnRenamed("_rank", "_l"), b.withColumnRenamed("_found", "_ok"), ["k"]).select("_l", "_ok").collect() == [("u", "f")]
    assert joins.rounded_join(a.withColumnRenamed("_rank", "_key"), b.select("s", "v"), "t", "v").count() == 0
    games = spark.createDataFrame([("2026-01-02", 4)], "d string, _n int")
    days = spark.createDataFrame([("2026-01-01", "x")], "day string, _first string")
    assert joins.near_dates(days, "day", games, "d", 1, 1).select("_first", "_n").collect() == [("x", 4)]
    log = spark.createDataFrame([("g", 1, "h", 2, "keep"), ("g", 2, "h", 0, "keep")], "g string, i int, side string, p int, _s string")
    out = windows.with_streak(log, ["g"], ["i"], "side", F.col("p")).orderBy("i").collect()
    assert [(r._s, r.streak_side, r.streak_length) for r in out] == [("keep", "", 0), ("keep", "h", 1)]
