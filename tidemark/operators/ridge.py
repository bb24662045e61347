"""Rolling ridge regression over sparse rows: ratings of many players from the line-ups they were in."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import bucketed, kept, remove, shared_dir, staged, stages_dropped, written

_ENTRY = "array<struct<k: string, v: double>>"
#: Pairs of a block of the Gram matrix, features of a part of it, and entries of a row that holds some of a block.
BLOCK, PART, PIECE = 3_000_000, 100_000, 1 << 16
#: Pairs of a group that one task solves alone; larger groups are solved by all tasks together.
ALONE = 2_000_000
_PART = "by string, part int, parts int, seen array<long>, marks array<double>, keys binary, names array<string>, diagonal binary, ridge binary, label binary"
_PIECE = "block string, by string, i int, j int, parts int, c binary, a binary, b binary, g binary"
_STATE = "by string, part int, parts int, marks array<double>, n int, diagonal binary, ridge binary, x binary, r binary, p binary, s binary, w binary, gamma array<double>, delta array<double>, left array<double>"
_RESULT = "by string, as_of double, feature string, coefficient double, n long"


def _square(data, n: int) -> np.ndarray:
    """(n features, checkpoints) of bytes."""
    return np.frombuffer(data, np.float64).reshape(n, -1)


def _decays(marks: np.ndarray, half_life: float) -> np.ndarray:
    """[c, m]: the weight at checkpoint m of what was summed up to checkpoint c; 0 before it."""
    age = marks[None, :] - marks[:, None]
    return np.where(age >= 0, 0.5 ** (np.maximum(age, 0) / half_life), 0.0)


def _block_key(i: Column, j: Column, by: Column) -> Column:
    return F.concat_ws("/", i, j, by)


def _part_of(half_life: float, alpha: float):
    """One row for a part of a group's features, in order of their hashes: at each checkpoint their decayed
    squares and products with the label. The free intercept, named "", has no ridge."""

    def part(key, t):
        h, first, at = np.unique(t["h"].to_numpy(), return_index=True, return_inverse=True)
        names = t["k"].take(pa.array(first)).to_pylist()
        if len(names) != len(set(t["k"].unique().to_pylist())):
            raise ValueError("two features have the same 64-bit hash")
        marks = np.array(t["marks"][0].as_py())
        c, decays = t["c"].to_numpy() - 1, _decays(marks, half_life)
        sums = []
        for name in ("square", "product"):
            blocks = np.bincount(at * len(marks) + c, t[name].to_numpy(), len(h) * len(marks)).reshape(len(h), -1)
            sums.append(blocks @ decays)
        ridge = np.where(np.array(names) == "", 0.0, alpha)
        row = {"by": key[0].as_py(), "part": key[1].as_py(), "parts": t["parts"][0].as_py(), "seen": t["seen"][0].as_py(), "marks": marks.tolist(), "keys": h.tobytes(), "names": names, "diagonal": sums[0].tobytes(), "ridge": ridge.tobytes(), "label": sums[1].tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([("by", pa.string()), ("part", pa.int32()), ("parts", pa.int32()), ("seen", pa.list_(pa.int64())), ("marks", pa.list_(pa.float64())), ("keys", pa.binary()), ("names", pa.list_(pa.string())), ("diagonal", pa.binary()), ("ridge", pa.binary()), ("label", pa.binary())]))

    return part


def _pieces(key, pairs, parts):
    """The pairs of parts i and j as entries by place, both ways round: by block of time and row, equal ones summed."""
    by, i, j = (k.as_py() for k in key)
    out = {f: [] for f in ("block", "by", "i", "j", "parts", "c", "a", "b", "g")}
    if len(pairs):
        of = dict(zip(parts["part"].to_pylist(), parts["keys"].to_pylist()))
        a, b = (np.searchsorted(np.frombuffer(of[p], np.int64), pairs[h].to_numpy()).astype(np.int32) for p, h in ((i, "hi"), (j, "hj")))
        c, g = pairs["c"].to_numpy().astype(np.int32), pairs["g"].to_numpy()
        ways = [(i, j, a, b), (j, i, b, a)] if i != j else [(i, i, np.concatenate([a, b]), np.concatenate([b, a]))]
        if i == j:
            c, g = np.tile(c, 2), np.tile(g, 2)
        for i, j, a, b in ways:
            order = np.lexsort((b, a, c))
            a, b, cs, gs = a[order], b[order], c[order], g[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (cs[1:] != cs[:-1])]))
            a, b, cs, gs = a[new], b[new], cs[new], np.add.reduceat(gs, new)
            for k in range(0, len(new), PIECE):
                s = slice(k, k + PIECE)
                for f, x in zip(out, (f"{i}/{j}/{by}", by, i, j, parts["parts"][0].as_py(), cs[s].tobytes(), a[s].tobytes(), b[s].tobytes(), gs[s].tobytes())):
                    out[f].append(x)
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table({f: pa.array(x, kind) for (f, x), kind in zip(out.items(), kinds)})


def _times(pieces: pa.Table, u: np.ndarray, n: int, decays: np.ndarray) -> np.ndarray:
    """A block's entries, decayed to each checkpoint, times u: (n rows, checkpoints)."""
    y, width = np.zeros((n, u.shape[1])), max(1, (1 << 22) // u.shape[1])
    for c, a, b, g in zip(*[pieces[f] for f in ("c", "a", "b", "g")]):
        c, a, b = (np.frombuffer(x.as_buffer(), np.int32) for x in (c, a, b))
        g = np.frombuffer(g.as_buffer(), np.float64)
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        for low, high in zip(starts, [*starts[1:], len(c)]):
            m = c[low] - 1
            for k in range(low, high, width):
                s = slice(k, min(high, k + width))
                rows = np.flatnonzero(np.concatenate([[True], a[s][1:] != a[s][:-1]]))
                y[a[s][rows], m:] += np.add.reduceat(g[s, None] * u[b[s], m:], rows, axis=0) * decays[m, m:]
    return y


def _dots(diagonal, r, u, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (r * u).sum(0), (w * u).sum(0), (r * r).sum(0)


class _Steps:
    """Conjugate gradients for all checkpoints of a group at once, with the diagonal as preconditioner, in the form
    of Chronopoulos and Gear: a step's sums over all parts are taken together, once."""

    def __init__(self, tolerance: float = 1e-12):
        self.tolerance, self.gamma, self.step, self.aim, self.count = tolerance, None, None, None, 0

    def next(self, gamma: np.ndarray, delta: np.ndarray, left: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(step, turn) for each checkpoint from r.u, w.u and r.r; None when all are solved."""
        if self.aim is None:
            self.aim = self.tolerance**2 * left
        going = left > np.maximum(self.aim, 1e-300)
        if not going.any() or self.count > most:
            return None
        self.count += 1
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = np.zeros_like(gamma) if self.gamma is None else np.where(going & (self.gamma > 0), gamma / self.gamma, 0.0)
            under = delta if self.gamma is None else delta - np.where(turn > 0, turn * gamma / self.step, 0.0)
            step = np.where(going & (under > 0), gamma / under, 0.0)
        self.gamma, self.step = gamma, step
        return (step, turn) if step.any() else None


def _moved(x, r, p, s, w, whole, step, turn):
    """x, r, p, s and u after a step; u is r through the preconditioner."""
    u = r / whole
    p, s = u + turn * p, w + turn * s
    x, r = x + step * p, r - step * s
    return x, r, p, s, r / whole


def _whole(diagonal: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    whole = diagonal + ridge[:, None]
    return np.where(whole > 0, whole, 1.0)


def _coefficients(by, names, marks, seen, diagonal, x, at_least: int) -> Iterator[pa.RecordBatch]:
    """The result's rows: at each checkpoint the features that were there before it."""
    names = np.array(names, object)
    for m in np.flatnonzero(np.array(seen) >= at_least):
        there = np.flatnonzero((diagonal[:, m] != 0) & (names != ""))
        count = len(there)
        columns = [pa.array([by] * count, pa.string()), pa.array(np.full(count, marks[m])), pa.array([n[1:] for n in names[there]], pa.string()), pa.array(x[there, m]), pa.array(np.full(count, seen[m], np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["by", "as_of", "feature", "coefficient", "n"])


def _alone(half_life: float, at_least: int):
    """All checkpoints of a group that is one part."""

    def solve(key, parts, pieces):
        out, names = [], parts["names"][0].as_py()
        n, marks = len(names), np.array(parts["marks"][0].as_py())
        diagonal, label = (_square(parts[f][0].as_py(), n) for f in ("diagonal", "label"))
        whole, decays = _whole(diagonal, np.frombuffer(parts["ridge"][0].as_py(), np.float64)), _decays(marks, half_life)
        x, p, s, r, steps = np.zeros_like(label), np.zeros_like(label), np.zeros_like(label), label, _Steps()
        u = r / whole
        while True:
            w = whole * u + _times(pieces, u, n, decays)
            move = steps.next(*_dots(diagonal, r, u, w), 20 * n + 50)
            if move is None:
                break
            x, r, p, s, u = _moved(x, r, p, s, w, whole, *move)
        out += _coefficients(key[0].as_py(), names, marks, parts["seen"][0].as_py(), diagonal, x, at_least)
        return pa.Table.from_batches(out, pa.schema([("by", pa.string()), ("as_of", pa.float64()), ("feature", pa.string()), ("coefficient", pa.float64()), ("n", pa.int64())]))

    return solve


def _together(parts: DataFrame, blocks: DataFrame, half_life: float) -> Iterator[DataFrame]:
    """The states of groups of many parts, step by step; the last holds the solution x. The driver sees each
    part's three sums for each checkpoint. Blocks stay where they are; parts of u go to the blocks of their column."""
    schema = pa.schema([("by", pa.string()), ("part", pa.int32()), ("parts", pa.int32()), ("marks", pa.list_(pa.float64())), ("n", pa.int32()), *[(f, pa.binary()) for f in ("diagonal", "ridge", "x", "r", "p", "s", "w")], *[(f, pa.list_(pa.float64())) for f in ("gamma", "delta", "left")]])

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ridge"]) // 8
                zero = bytes(len(row["label"]))
                yield pa.RecordBatch.from_pylist([{**{f: row[f] for f in ("by", "part", "parts", "marks", "diagonal", "ridge")}, "n": n, "x": zero, "r": row["label"], "p": zero, "s": zero, "w": zero, "gamma": None, "delta": None, "left": None}], schema)

    def moved(moves):
        def move(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    n = row["n"]
                    diagonal, x, r, p, s, w = (_square(row[f], n) for f in ("diagonal", "x", "r", "p", "s", "w"))
                    step, turn = moves.get(row["by"], (np.zeros(x.shape[1]), np.zeros(x.shape[1])))
                    x, r, p, s, _ = _moved(x, r, p, s, w, _whole(diagonal, np.frombuffer(row["ridge"], np.float64)), step, turn)
                    yield pa.RecordBatch.from_pylist([{**row, **{f: v.tobytes() for f, v in (("x", x), ("r", r), ("p", p), ("s", s))}}], schema)

        return move

    def preconditioned(row):
        diagonal, r = (_square(row[f], row["n"]) for f in ("diagonal", "r"))
        whole = _whole(diagonal, np.frombuffer(row["ridge"], np.float64))
        return diagonal, whole, r, r / whole

    def times(key, pieces, parts):
        row = parts.to_pylist()[0]
        u = preconditioned(row)[3]
        # rows of part i may be fewer or more than of j; the last one that is met is enough
        n = 1 + max((int(np.frombuffer(a.as_buffer(), np.int32).max()) for a in pieces["a"]), default=-1)
        y = _times(pieces, u, n, _decays(np.array(row["marks"]), half_life)) if n else np.zeros((0, u.shape[1]))
        return pa.table({"by": pa.array([row["by"]], pa.string()), "part": pa.array([int(key[0].as_py().split("/", 1)[0])], pa.int32()), "y": pa.array([y.tobytes()], pa.binary())})

    def gathered(key, parts, products):
        row = parts.to_pylist()[0]
        diagonal, whole, r, u = preconditioned(row)
        w = whole * u
        for y in sorted(products["y"].to_pylist()):
            y = np.frombuffer(y, np.float64).reshape(-1, w.shape[1])
            w[: len(y)] += y
        gamma, delta, left = _dots(diagonal, r, u, w)
        return pa.Table.from_pylist([{**row, "w": w.tobytes(), "gamma": gamma.tolist(), "delta": delta.tolist(), "left": left.tolist()}], schema)

    state, steps, moves = parts.mapInArrow(first, _STATE), {}, {}
    while True:
        sent = state.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")).select(_block_key(F.col("i"), F.col("part"), F.col("by")).alias("block"), "by", "marks", "n", "diagonal", "ridge", "r")
        products = blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(times, "by string, part int, y binary")
        state = yield state.groupBy("by", "part").cogroup(products.groupBy("by", "part")).applyInArrow(gathered, _STATE)
        sums: dict[str, list] = {}
        for row in state.select("by", "n", "gamma", "delta", "left").collect():
            one = sums.setdefault(row["by"], [0, 0.0, 0.0, 0.0])
            for k, v in enumerate((row["n"], *(np.array(row[f]) for f in ("gamma", "delta", "left")))):
                one[k] = one[k] + v
        found = {by: steps.setdefault(by, _Steps()).next(gamma, delta, left, 20 * n + 50) for by, (n, gamma, delta, left) in sums.items()}
        moves = {by: move for by, move in found.items() if move is not None}
        if not moves:
            return
        state = state.mapInArrow(moved(moves), _STATE)


def sparse_rolling_ridge(rows: DataFrame, order: str, entries: Column, label: str, alpha: float = 1000.0, half_life: float = 80.0, every: int = 5, at_least: int = 200, by: str | None = None) -> DataFrame:
    """by, as_of, feature, coefficient, n: weighted ridge with free intercept, refitted at every `every`-th
    value of `order` (a number) on all earlier rows, n of them and at_least many, which decay with age.

    entries is an array of structs (k, v): the row's features that aren't 0, such as its players. A
    row makes a product for each two of its features; they are summed per pair and block of
    time between checkpoints, never for each checkpoint anew, so the Gram matrix is entries of
    features that ever met. Features are dealt to parts by hash and their pairs to blocks of two parts,
    of BLOCK pairs about. All checkpoints of a group are solved together by conjugate gradients:
    in one task if the group has up to ALONE pairs, else by a Spark job a step, in which each block
    multiplies its part of the vectors. Rows with a null label or order, and null features or
    values, don't count. Runs when called; the result is kept in the shared folder."""
    spark = rows.sparkSession
    group = F.col(by).cast("string") if by else F.lit("")
    given = F.filter(entries.cast(_ENTRY), lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    given = F.transform(given, lambda e: F.struct(F.concat(F.lit("f"), e["k"]).alias("k"), e["v"].alias("v")))
    base = rows.select(group.alias("by"), F.col(order).cast("double").alias("o"), F.col(label).cast("double").alias("y"), F.coalesce(given, F.array().cast(_ENTRY)).alias("f")).where("o is not null and y is not null and by is not null")
    distinct = F.array_distinct(F.transform("f", lambda e: e["k"]))
    total = lambda k: F.aggregate(F.filter("f", lambda e: e["k"] == k), F.lit(0.0), lambda a, e: a + e["v"])
    base = base.withColumn("f", F.when(F.size(distinct) < F.size("f"), F.transform(distinct, lambda k: F.struct(k.alias("k"), total(k).alias("v")))).otherwise(F.col("f")))
    with stages_dropped(spark):
        base = staged(base)
        w = Window.partitionBy("by").orderBy("o")
        calendar = base.groupBy("by", "o").agg(F.count("*").alias("n"))
        calendar = calendar.select("by", "o", (F.row_number().over(w) - 1).alias("at"), F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("seen"))
        calendar = staged(calendar)
        marks = calendar.where((F.col("at") > 0) & (F.col("at") % every == 0)).select("by", (F.col("at") / every).cast("int").alias("c"), F.col("o").alias("mark"), "seen")
        ends = calendar.select("by", "o", (F.floor(F.col("at") / every) + 1).cast("int").alias("c")).join(marks.drop("seen"), ["by", "c"]).select("by", "o", "c", F.pow(F.lit(0.5), (F.col("mark") - F.col("o")) / half_life).alias("w"))
        n = F.size("f")
        size = base.select("by", (n * (n - 1) / 2).alias("pairs"), F.explode_outer("f.k").alias("k"), n.alias("n")).groupBy("by").agg(F.sum(F.col("pairs") / F.greatest("n", F.lit(1))).alias("pairs"), F.approx_count_distinct("k").alias("features"))
        parts = F.when(F.col("pairs") <= ALONE, 1).otherwise(F.ceil(F.greatest(F.sqrt(F.col("pairs") * 2 / BLOCK), F.lit(2))))
        size = size.select("by", F.greatest(parts, F.ceil(F.col("features") / PART)).cast("int").alias("parts"))
        calls = marks.groupBy("by").agg(F.array_sort(F.collect_list(F.struct("c", "mark", "seen"))).alias("all"))
        calls = staged(calls.join(size, "by").select("by", "parts", F.col("all.mark").alias("marks"), F.col("all.seen").alias("seen")))

        part = lambda k: F.pmod(F.xxhash64(k), F.col("parts")).cast("int")
        hashed = F.transform("f", lambda e: F.struct(part(e["k"]).alias("part"), F.xxhash64(e["k"]).alias("h"), e["v"].alias("v")))
        terms = base.join(ends, ["by", "o"]).join(calls.select("by", "parts"), "by")
        one = F.array(F.struct(F.lit("").alias("k"), F.lit(1.0).alias("v")))
        single = terms.select("by", "parts", "c", "w", "y", F.explode(F.concat(one, "f")).alias("e")).groupBy("by", "parts", "c", F.col("e.k").alias("k"))
        v = F.col("e.v")
        single = staged(single.agg(F.sum(F.col("w") * v * v).alias("square"), F.sum(F.col("w") * v * F.col("y")).alias("product"), F.sum(F.col("w") * v).alias("g")).withColumns({"part": part(F.col("k")), "h": F.xxhash64("k")}))
        with_calls = single.join(calls.drop("parts"), "by").select("by", "part", "parts", "h", "k", "c", "square", "product", "marks", "seen")
        of = staged(with_calls.groupBy("by", "part").applyInArrow(_part_of(half_life, alpha), _PART))

        pair = lambda a, b: F.struct(F.least(a["part"], b["part"]).alias("i"), F.greatest(a["part"], b["part"]).alias("j"), F.when(a["part"] <= b["part"], a["h"]).otherwise(b["h"]).alias("hi"), F.when(a["part"] <= b["part"], b["h"]).otherwise(a["h"]).alias("hj"), (a["v"] * b["v"]).alias("v"))
        met = terms.select("by", "c", "w", hashed.alias("f"))
        met = met.select("by", "c", "w", F.explode(F.flatten(F.transform("f", lambda a, k: F.transform(F.slice("f", k + 2, F.size("f")), lambda b: pair(a, b))))).alias("p"))
        met = met.select("by", "p.i", "p.j", "p.hi", "p.hj", "c", (F.col("w") * F.col("p.v")).alias("g"))
        free = F.struct(part(F.lit("")).alias("part"), F.xxhash64(F.lit("")).alias("h"), F.lit(1.0).alias("v"))
        free = single.where("k != ''").select("by", "c", pair(free, F.struct("part", "h", F.col("g").alias("v"))).alias("p")).select("by", "p.i", "p.j", "p.hi", "p.hj", "c", F.col("p.v").alias("g"))
        both = of.select("by", "part", "parts", "keys", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
        both = both.select("by", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "parts", "keys")
        blocks = met.unionByName(free).groupBy("by", "i", "j").cogroup(both.groupBy("by", "i", "j")).applyInArrow(_pieces, _PIECE)
        blocks = bucketed(blocks, "block", compression="zstd", **{"parquet.block.size": str(16 << 20)})

        small = of.where("parts = 1").groupBy("by").cogroup(blocks.where("parts = 1").groupBy("by")).applyInArrow(_alone(half_life, at_least), _RESULT)
        if calls.where("parts > 1").isEmpty():
            return kept(small)
        folder, last = f"{shared_dir(spark)}/ridge-{uuid.uuid4().hex}", None
        try:
            states, given = _together(of.where("parts > 1"), blocks.where("parts > 1"), half_life), None
            for k in range(1 << 30):
                try:
                    state = states.send(given)
                except StopIteration:
                    break
                given = written(state, f"{folder}/{k}")
                if k:
                    remove(spark, f"{folder}/{k - 1}")
                last = given

            def solved(batches):
                for batch in batches:
                    for row in batch.to_pylist():
                        count = len(row["names"])
                        yield from _coefficients(row["by"], row["names"], row["marks"], row["seen"], _square(row["diagonal"], count), _square(row["x"], count), at_least)

            large = of.select("by", "part", "names", "seen", "marks", "diagonal").join(last.select("by", "part", "x"), ["by", "part"]).mapInArrow(solved, _RESULT)
            return kept(small.unionByName(large))
        finally:
            remove(spark, folder)


def rolling_ridge(rows: DataFrame, order: str, features: list[str], label: str, alpha: float = 1000.0, half_life: float = 80.0, every: int = 5, at_least: int = 200, by: str | None = None) -> DataFrame:
    """(by,) as_of, feature, coefficient: weighted ridge with free intercept, refitted at every `every`-th
    value of `order` on all earlier rows, which decay with age. For a few columns; for many features
    of which a row has few there is sparse_rolling_ridge.

    Gram entries are summed per order value by Spark; only these sums, (features + 2)^2 numbers
    for each order value, go through the decayed running sum and the solve, a group of `by` each."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(label).cast("double")]
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    group = F.col(by).cast("string") if by else F.lit("")
    sums = rows.groupBy(group.alias("by"), F.col(order).cast("double").alias("o")).agg(F.count("*").alias("n"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("g"))

    def solve(table: pd.DataFrame) -> pd.DataFrame:
        table, out = table.sort_values("o"), []
        gram, seen, last = np.zeros((k, k)), 0, None
        for at, (o, n, g) in enumerate(zip(table.o, table.n, table.g)):
            if last is not None:
                gram *= 0.5 ** ((o - last) / half_life)
            if at % every == 0 and seen >= at_least:
                a = gram[:-1, :-1] + np.diag([0.0] + [alpha] * len(features))
                b = np.linalg.lstsq(a, gram[:-1, -1], rcond=None)[0]
                out += [(table.by.iloc[0], o, f, float(c)) for f, c in zip(features, b[1:])]
            step = np.zeros((k, k))
            for (i, j), v in zip(pairs, g):
                step[i, j] = step[j, i] = v
            gram, seen, last = gram + step, seen + n, o
        return pd.DataFrame(out, columns=["by", "as_of", "feature", "coefficient"])

    return sums.groupBy("by").applyInPandas(solve, "by string, as_of double, feature string, coefficient double")
