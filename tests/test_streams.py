"""Keyed state over many batches whose files are not laid out by time."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import machines, stream

OUT = "id long, n long, total double, velocity double"


MS = 1000


def landed(tmp_path, ticks, files, start=0, closing=True):
    """ticks in so many files, in the order given; the source takes the oldest file first. The last
    file has the closing row."""
    import os

    columns = ["id", "user", "us", "value"]
    frames = [pd.DataFrame(ticks[k::files], columns=columns).assign(_closing=False) for k in range(files)]
    if closing:
        last = pd.DataFrame([(0, 0, max(t[2] for t in ticks) + 1_000_000 * MS, 0.0)], columns=columns).assign(_closing=True)
        frames.append(last)
    for k, frame in enumerate(frames, start):
        frame.to_parquet(tmp_path / f"{k:03d}.parquet")
        os.utime(tmp_path / f"{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return f"{tmp_path}/"


def snapshots(spark, path, width, late, files_per_batch=1):
    return stream.keyed(stream.file_stream(spark, path, files_per_batch), "user", machines.rolling_snapshot(width * MS), ["id", "us", "value"], ["us", "id"], OUT, late * MS)


def snapshot(spark, path, width, late, files_per_batch=1, at=None):
    return {r.id: (r.n, r.total, r.velocity) for r in stream.drained(snapshots(spark, path, width, late, files_per_batch), at=at).collect()}


def expected(ticks, width):
    out = {}
    for i, user, us, value in ticks:
        seen = sorted((t, j, v) for j, u, t, v in ticks if u == user and us - width * MS < t and (t, j) <= (us, i))
        out[i] = (len(seen), sum(v for *_, v in seen), value - seen[0][2])
    return out


@pytest.fixture
def ticks():
    rng = random.Random(3)
    return [(i, i % 3, (i * 10 + rng.randrange(10)) * MS, float(rng.randrange(1, 100))) for i in range(120)]


def test_shuffled_files_one_a_batch(spark, tmp_path, ticks):
    want = expected(ticks, 200)
    mixed = random.Random(4).sample(ticks, len(ticks))
    assert snapshot(spark, landed(tmp_path, mixed, 6), 200, 2000) == want


def by_time(ticks, files):
    """Rows so that landed puts a part of the ticks in each file, neighbours swapped."""
    rng, size = random.Random(5), len(ticks) // files
    parts = [rng.sample(ticks[a : a + size], size) for a in range(0, size * files, size)]
    for k in range(0, files - 1, 2):
        parts[k], parts[k + 1] = parts[k + 1], parts[k]
    return [parts[k % files][k // files] for k in range(size * files)]


def test_state_is_carried_past_the_watermark(spark, tmp_path, ticks):
    assert snapshot(spark, landed(tmp_path, by_time(ticks, 6), 6), 200, 450) == expected(ticks, 200)


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path, ticks):
    """Ended after three batches and started again by another query: equal to one run."""
    rows, at = by_time(ticks, 6), f"{tmp_path}/at"
    (tmp_path / "in").mkdir()
    parts = [rows[k::6] for k in range(6)]
    for k in range(3):
        landed(tmp_path / "in", parts[k], 1, k, closing=False)
    early = snapshot(spark, f"{tmp_path}/in/", 200, 450, at=at)
    for k in range(3, 6):
        landed(tmp_path / "in", parts[k], 1, k, closing=k == 5)
    want = expected(ticks, 200)
    assert 0 < len(early) < 120 and early.items() <= want.items()
    assert snapshot(spark, f"{tmp_path}/in/", 200, 450, at=at) == want


def test_a_stream_that_was_killed_in_a_batch_goes_on(spark, tmp_path, ticks):
    rows, at, mark = by_time(ticks, 6), f"{tmp_path}/at", tmp_path / "mark"
    (tmp_path / "in").mkdir()
    landed(tmp_path / "in", rows, 6)
    machine = machines.rolling_snapshot(200 * MS)
    mark.touch()

    def step(state, row, path=str(mark), real=machine.step):
        import os

        if row[0] == 77 and os.path.exists(path):
            raise RuntimeError("killed here")
        return real(state, row)

    def out():
        return stream.keyed(stream.file_stream(spark, f"{tmp_path}/in/", 1), "user", machine._replace(step=step), ["id", "us", "value"], ["us", "id"], OUT, 450 * MS)

    with pytest.raises(Exception, match="killed here"):
        stream.drained(out(), at=at)
    mark.unlink()
    got = stream.drained(out(), at=at).collect()
    assert {r.id: (r.n, r.total, r.velocity) for r in got} == expected(ticks, 200) and len(got) == 120


def test_rows_behind_the_watermark_are_counted(spark, tmp_path, ticks):
    """Spark lets in what comes in the batch right after; the third file is too late."""
    rows = [ticks[a + k] for k in range(20) for a in (100, 80, 0)]
    with pytest.warns(UserWarning, match="20 rows came behind the watermark"):
        got = snapshot(spark, landed(tmp_path, rows, 3), 200, 10)
    assert got == expected(ticks[80:], 200)


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, user long, us long, value double")
    empty.write.parquet(f"{tmp_path}/e")
    assert snapshot(spark, f"{tmp_path}/e", 10, 1) == {}


def test_nulls_ties_and_rows_without_a_time(spark, tmp_path):
    """A null key is a key; a null value is NaN to the machine; equal rows step both; no time, no place."""
    rows = [(1, None, 5 * MS, 2.0), (2, None, 6 * MS, None), (3, 7, 5 * MS, 1.0), (3, 7, 5 * MS, 1.0), (9, 7, None, 4.0)]
    frame = spark.createDataFrame([(*r, False) for r in rows] + [(0, 0, 10_000 * MS, 0.0, True)], "id long, user long, us long, value double, _closing boolean")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = sorted((r.id, r.n, str(r.total)) for r in stream.drained(snapshots(spark, f"{tmp_path}/in", 100, 10)).collect())
    assert got == [(1, 1, "2.0"), (2, 2, "nan"), (3, 1, "1.0"), (3, 2, "2.0")]


def test_sliced_stream_is_whole_and_in_order(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id * 7 as us", "'x' as note").union(spark.range(1).selectExpr("-1L", "cast(null as bigint)", "'no time'"))
    seen = stream.drained(stream.sliced_stream(rows, "us", slices=3, files=5, closing=10).withColumn("part", F.lit(1)))
    assert seen.where("not _closing").count() == 1001 and [r.us for r in seen.where("_closing").collect()] == [999 * 7 + 10]
    batches = {}

    def note(b, n):
        batches[n] = [r.us for r in b.collect() if r.us is not None]

    stream.sliced_stream(rows, "us", slices=3, files=5).writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 3 and sum(map(len, batches.values())) == 1000
    assert all(max(batches[k]) < min(batches[k + 1]) for k in range(2))
    assert stream.drained(stream.sliced_stream(rows.where("false"), "us", closing=5)).where("not _closing").count() == 0


def test_swap_and_fade_do_not_depend_on_batches(spark, tmp_path, ticks):
    mixed = random.Random(6).sample(ticks, len(ticks))
    path = landed(tmp_path, mixed, 5)
    machine = machines.break_fade((200.0, 600.0), 200.0, 80.0, 10.0, 100.0)
    got = []
    for files in (1, 64):
        rows = stream.file_stream(spark, path, files).selectExpr("id", "user", "us", "cast(us / 1000 as double) as minute", "value", "_closing")
        out = stream.keyed(rows, "user", machine, ["id", "minute", "value"], ["us", "id"], "id long, action string, side string, drift double", 2000 * MS)
        got.append(sorted(tuple(map(str, r)) for r in stream.drained(out).collect()))
    assert got[0] == got[1] and len(got[0]) == 120 and {"EXIT", "WAIT", "ENTER"} == {x[1] for x in got[0]}


def decisions(snaps, **how):
    step, start, *_ = machines.break_fade(**({"breaks": (30.0, 75.0), "window": 5.0, "lookback": 10.0, "drift": 5.0, "hold": 8.0} | how))
    state, out = start(), []
    for k, (minute, price) in enumerate(snaps):
        out += [x[1:3] for x in step(state, (k, minute, price))]
    return out


def test_break_fade_cases():
    assert decisions([(m, 50 + m) for m in range(0, 29)]) == [("WAIT", None)] * 29  # outside the window
    assert decisions([(20, 50), (25, 54), (30, 60)])[-1] == ("ENTER", "NO")  # a riser
    assert decisions([(20, 50), (25, 46), (30, 40)])[-1] == ("ENTER", "YES")
    small = decisions([(20, 50), (30, 52), (31, 70)])
    assert small[1:] == [("WAIT", None)] * 2  # judged once, though it moves later
    short = decisions([(29, 50), (30, 60), (34, 62)])
    assert short == [("WAIT", None), ("WAIT", None), ("ENTER", "NO")]  # too little history leaves the break open
    held = decisions([(20, 50), (30, 60), (33, 70), (38, 70), (70, 50), (76, 40)])
    assert [x[0] for x in held] == ["WAIT", "ENTER", "WAIT", "EXIT", "WAIT", "ENTER"]


def test_swap_waits_for_the_open_position():
    step, start, *_ = machines.swap_with_hysteresis()
    state = start()
    rows = [(0, "a", 50, None, False), (1, "a", 90, None, False), (2, "a", 90, "a", False), (3, "a", 90, "b", True), (4, "a", 90, "b", False), (5, "b", 50, "a", False)]
    assert [x[1] for r in rows for x in step(state, r)] == ["start", "no_candidates", "best_is_current", "swap_deferred_open", "swap", "stay"]


def test_market_snapshot_and_staleness():
    step, start, *_ = machines.market_snapshot(120, 30, 30, 60, second=1)
    state = start()
    ticks = [(0, 40, 44, 42, 100, 10), (20, 41, 43, 42, 100, 11), (55, 45, 47, 46, 130, 15)]
    assert step(state, (0, 0, True, None, None, None, None, None))[0][1] is False
    for t in ticks:
        assert step(state, (1, t[0], False, *t[1:])) == []
    (got,) = step(state, (2, 60, True, None, None, None, None, None))
    # bid, ask, spread, last, interest, volume, ms since trade, interest change, d bid, d spread, speed, its change, bid - last
    assert got[1:] == (True, 45, 47, 2, 46, 15, 30, 5000, 5, 45, 2, (45 - 41) / 30, (45 - 41) / 30, -1)
    assert step(state, (3, 86, True, None, None, None, None, None))[0][1] is False


def test_market_snapshot_is_that_of_whole_lists():
    """The searches and carried sums against scans of all ticks that the window holds."""
    rng = random.Random(8)
    step, start, *_ = machines.market_snapshot(120, 50, 30, 60, second=1)
    state, ticks, now, volume, before = start(), [], 0, 0, (0.0, 0.0, 0.0)
    ago = lambda back, k: min(ticks, key=lambda x: (abs(x[0] - (now - back)), x[0]))[k]
    for i in range(3000):
        now += rng.choice([0, 1, 5, 20, 70])
        if rng.random() < 0.6:
            volume += rng.choice([0, 0, 3])
            if rng.random() < 0.01:
                volume = 0
            t = (now, *(float(rng.randrange(100)) for _ in range(3)), float(volume), float(rng.randrange(9)))
            ticks = [x for x in (*ticks, t) if x[0] >= now - 120]
            assert step(state, (i, now, False, *t[1:])) == []
            continue
        (got,) = step(state, (i, now, True, None, None, None, None, None))
        if not ticks or now - ticks[-1][0] > 50:
            assert got == (i, False, *[None] * 13)
            continue
        grown = [(b[0], max(0.0, b[4] - a[4])) for a, b in zip(ticks, ticks[1:])]
        traded = [t for t, n in grown if n > 0]
        _, bid, ask, last, _, interest = ticks[-1]
        speed = (bid - ago(30, 1)) / 30
        want = (bid, ask, ask - bid, last, interest, sum(n for t, n in grown if t > now - 60), (now - traded[-1]) * 1000 if traded else 999999.0, interest - ago(60, 5), bid - before[0], ask - bid - before[1], speed, speed - before[2], bid - last)
        before = (bid, ask - bid, speed)
        assert got[:2] == (i, True) and got[2:] == pytest.approx(want), i


def test_keys_share_the_state_of_their_bucket(spark, tmp_path, monkeypatch):
    """200 keys, null and NaN among them, in three buckets: each steps as if alone, by one timer a bucket."""
    from tidemark.operators import folds

    monkeypatch.setattr(stream, "BUCKETS", 3)
    seen, real = [], stream.late_rows
    monkeypatch.setattr(stream, "late_rows", lambda q: seen.extend(op["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for op in p["stateOperators"]) or real(q))
    key = F.when(F.col("id") % 200 == 0, None).when(F.col("id") % 200 == 1, float("nan")).otherwise((F.col("id") % 200).cast("double"))
    rows = spark.range(3000).select("id", key.alias("user"), ((F.col("id") * 7919 % 3001 + 1000) * MS).alias("us"), (F.col("id") % 17).cast("double").alias("value"))
    machine, takes = machines.rolling_snapshot(900 * MS), ["id", "us", "value"]
    got = stream.drained(stream.keyed(stream.sliced_stream(rows, "us", closing=500 * MS), "user", machine, takes, ["us", "id"], OUT, 100 * MS)).collect()
    want = folds.unfolded(rows, ["user"], ["us", "id"], takes, machine, OUT).drop("user").collect()
    assert len(got) == 3000 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert 0 < max(seen) <= 3
