"""Exact top-k search by inner product, a block at a time.

Vectors are ordered by the nearest of a bounded set of pivots and packed into blocks, each with
its forward index (a matrix) and the largest and smallest value of each term (dimension); ranges
are runs of blocks with extremes of their own. A query's bound on a block is the sum over terms
of its value times the block's extreme. In rounds, batches of neighbouring queries visit ranges in
descending order of bound, one in the first round and GROWTH times as many in each further one; in each
range every query takes the blocks in its own order, until the next bound is below its kth score.
Rounds go on until no range is left whose bound reaches the kth score of a query. No pair of vectors is ever a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared, staged, unshared

#: Vectors of a block, blocks of a range, queries of a batch at most.
BLOCK, RANGE, QUERY_BATCH = 256, 64, 64
#: Vectors that others are ordered around, and ranges whose extremes travel together.
PIVOTS, SUMMARIES = 256, 256
#: How many times the ranges of the last round a batch visits in the next: rounds cost jobs,
#: ranges whose bounds would have fallen in between cost a visit in which their blocks are skipped.
GROWTH = 4
#: Parts that the batches which visit a range are dealt in.
SALTS = 16
_HITS = "dim int, query long, id long, score long, blocks long"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """id, v: floor(scale * x) of each component x as a double, as doubles. Vectors that are
    null or hold a null, NaN or infinite component, and rows without an id, take no part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)).cast("double")).alias("v"))
    return rows.dropDuplicates(["id", "v"])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum stays below 2^53."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        whole = np.vectorize(int, otypes=[object])
        exact = whole(a).dot(whole(b).T)
        return np.vectorize(lambda x: min(max(int(x), -(2**63)), 2**63 - 1), otypes=[object])(exact)
    return a @ b.T


def _best(queries, ids, scores, k):
    """For each query: ids and scores of this block's k highest, ties to the smaller id."""
    for q, row in zip(queries, scores):
        use = ids != q
        s, i = row[use].astype(np.int64), ids[use]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            near = s >= edge
            s, i = s[near], i[near]
        top = np.lexsort((i, ~s))[:k]  # ~s is -s - 1, which never overflows
        yield i[top], s[top]


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """A seeded sample of PIVOTS vectors by their length; any sample gives exact results."""
    some = rows.orderBy(F.xxhash64("id", F.lit(23)), "id").limit(PIVOTS).select("v").collect()
    by: dict[int, list] = {}
    for r in some:
        by.setdefault(len(r["v"]), []).append(r["v"])
    return {dim: np.array(v, np.float64) for dim, v in by.items()}


def _ordered(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """dim, pivot, id, v in that order, dealt by ranges of it, so that no pivot is too large for a task."""
    given = shared(rows.sparkSession, pivots)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        pivots, out = unshared(given), np.zeros(len(vectors), np.int32)
        dims = vectors.map(len).to_numpy()
        for dim in np.unique(dims):
            p = pivots.get(int(dim))
            if p is not None and dim:
                m = np.array(vectors[dims == dim].tolist(), np.float64)
                out[dims == dim] = ((p * p).sum(axis=1) - 2 * (m @ p.T)).argmin(axis=1)
        return pd.Series(out)

    keyed = rows.select(F.size("v").alias("dim"), nearest("v").alias("pivot"), "id", "v")
    return keyed.repartitionByRange("dim", "pivot", "id").sortWithinPartitions("dim", "pivot", "id")


def _narrow(m: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the narrowest kind of number that holds it."""
    top = np.abs(m).max() if m.size else 0
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind, m.astype(kind).tobytes()


def _wide(kind: str, data: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, dim).astype(np.float64)


def _runs(batches, most, breaks):
    """(dim, pivot, ids, matrix) of up to `most` rows in a row with equal values of breaks."""
    held, key = [], None

    def made():
        return held[0].dim, held[0].pivot, np.array([r.id for r in held], np.int64), np.array([r.v for r in held], np.float64).reshape(len(held), held[0].dim)

    for batch in batches:
        for r in batch.itertuples():
            now = tuple(getattr(r, c) for c in breaks)
            if held and (now != key or len(held) == most):
                yield made()
                held = []
            key = now
            held.append(r)
    if held:
        yield made()


def _packed(rows: DataFrame, block: int, per: int) -> DataFrame:
    """A row for each range: its blocks' sizes, ids, matrices (narrow) and extremes."""

    def pack(batches):
        part, n, held = TaskContext.get().partitionId(), 0, []

        def made():
            nonlocal n
            n += 1
            kind, data = _narrow(np.vstack([m for *_, m in held]))
            high, low = np.array([m.max(axis=0) for *_, m in held]), np.array([m.min(axis=0) for *_, m in held])
            sizes = np.array([len(i) for _, _, i, _ in held], np.int32)
            row = held[0][0], part << 32 | n, len(held), sizes.tobytes(), np.concatenate([i for _, _, i, _ in held]).tobytes(), kind, data, high.tobytes(), low.tobytes(), high.max(axis=0).tobytes(), low.min(axis=0).tobytes()
            return pd.DataFrame([row], columns=[c.split()[0] for c in _RANGES.split(", ")])

        for run in _runs(batches, block, ("dim", "pivot")):
            if held and (held[0][0] != run[0] or len(held) == per):
                yield made()
                held = []
            held.append(run)
        if held:
            yield made()

    return rows.mapInPandas(pack, _RANGES)


_RANGES = "dim int, range long, blocks int, sizes binary, ids binary, kind string, data binary, high binary, low binary, most binary, least binary"


def _asked(rows: DataFrame, most: int) -> DataFrame:
    """dim, batch, pivot (of its first query), qids, kind, data: queries that lie near one another."""

    def pack(batches):
        part = TaskContext.get().partitionId()
        for n, (dim, pivot, ids, m) in enumerate(_runs(batches, most, ("dim",))):
            yield pd.DataFrame([(dim, part << 32 | n, pivot, ids.tobytes(), *_narrow(m))], columns=["dim", "batch", "pivot", "qids", "kind", "data"])

    return rows.mapInPandas(pack, "dim int, batch long, pivot int, qids binary, kind string, data binary")


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block: no score can be larger."""
    bound = _product(np.hstack([np.maximum(q, 0), np.minimum(q, 0)]), np.hstack([high, low])).astype(np.float64)
    return bound + np.abs(bound) * 2.0**-50  # rounding of huge values never cuts a block


def _search(dim, r, of, k):
    """_HITS of one batch of queries (r) in one range (of), each query in its own order of blocks."""
    qids = np.frombuffer(r.qids, np.int64)
    q = _wide(r.kind, r.data, dim, len(qids))
    floor = np.frombuffer(r.floor, np.float64).copy()
    bound = _bounds(q, of["high"], of["low"])
    order = np.argsort(-bound, axis=1, kind="stable")
    found, seen = [[] for _ in qids], np.zeros(len(qids), np.int64)
    for step in range(bound.shape[1]):
        at = order[:, step]
        active = np.flatnonzero(bound[np.arange(len(qids)), at] >= floor)
        if not len(active):
            break
        for b in np.unique(at[active]):
            some = active[at[active] == b]
            seen[some] += 1
            for j, (ids, scores) in zip(some, _best(qids[some], of["ids"][b], _product(q[some], of["vectors"][b]), k)):
                found[j] = sorted([*found[j], *((-s, i) for s, i in zip(scores.tolist(), ids.tolist()))])[:k]
                if len(found[j]) == k:
                    floor[j] = max(floor[j], -found[j][-1][0])
    return [(dim, int(qids[j]), i, -s, int(seen[j]) if n == 0 else 0) for j, hits in enumerate(found) for n, (s, i) in enumerate(hits)]


def _visited(batches, k):
    """Rows are sorted: a range comes before the batches that visit it."""
    key = of = None
    for batch in batches:
        out = []
        for r in batch.itertuples():
            if r.own:
                ends = np.cumsum(np.frombuffer(r.sizes, np.int32))
                ids, m = np.frombuffer(r.ids, np.int64), _wide(r.kind, r.data, r.dim, int(ends[-1]))
                key, of = (r.dim, r.range, r.salt), {"ids": np.split(ids, ends[:-1]), "vectors": np.split(m, ends[:-1]), "high": np.frombuffer(r.high).reshape(-1, r.dim), "low": np.frombuffer(r.low).reshape(-1, r.dim)}
            elif key == (r.dim, r.range, r.salt):
                out += _search(r.dim, r, of, k)
        yield pd.DataFrame(out, columns=["dim", "query", "id", "score", "blocks"])


def _visit(pairs: DataFrame, asked: DataFrame, ranges: DataFrame, floors: DataFrame, k: int) -> DataFrame:
    """_HITS of pairs: dim, batch, range. A range travels once for each part of its batches."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(SALTS)))
    none = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    own = pairs.select("dim", "range", "salt").distinct().join(ranges.hint("merge"), ["dim", "range"])
    own = own.select("dim", "range", "salt", F.lit(True).alias("own"), "sizes", "ids", "kind", "data", "high", "low", *none("qids", "floor"))
    other = pairs.join(asked.join(floors.hint("merge"), ["dim", "batch"]).hint("merge"), ["dim", "batch"])
    other = other.select("dim", "range", "salt", F.lit(False).alias("own"), *none("sizes", "ids"), "kind", "data", *none("high", "low"), "qids", "floor")
    dealt = ["dim", "range", "salt"]
    rows = own.unionByName(other).repartition(*dealt).sortWithinPartitions(*dealt, F.desc("own"))
    return rows.mapInPandas(lambda b: _visited(b, k), _HITS)


def _floors(asked: DataFrame, hits: DataFrame | None, k: int) -> DataFrame:
    """dim, batch, floor: each query's kth score so far, minus infinity where it has fewer."""
    if hits is None:
        nothing = F.lit(None).cast("long").alias("kth")
        kth = asked.select("dim", F.lit(None).cast("long").alias("query"), nothing).limit(0)
    else:
        ranked = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "id")
        kth = hits.withColumn("n", F.row_number().over(ranked)).where(F.col("n") == k).select("dim", "query", F.col("score").alias("kth"))
    known = asked.select("dim", "batch", "qids").mapInPandas(_unpacked, "dim int, batch long, at int, query long")
    known = known.join(kth.hint("merge"), ["dim", "query"], "left").groupBy("dim", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("kth")))), lambda x: x["kth"]).alias("floors"))

    def flat(batches):
        for batch in batches:
            yield pd.DataFrame({"dim": batch.dim, "batch": batch.batch, "floor": [np.array(f, np.float64).tobytes() for f in batch.floors]})

    return known.mapInPandas(flat, "dim int, batch long, floor binary")


def _unpacked(batches):
    for batch in batches:
        rows = [(r.dim, r.batch, j, int(q)) for r in batch.itertuples() for j, q in enumerate(np.frombuffer(r.qids, np.int64))]
        yield pd.DataFrame(rows, columns=["dim", "batch", "at", "query"])


def _reachable(asked: DataFrame, floors: DataFrame, ranges: DataFrame) -> DataFrame:
    """dim, batch, range, most: the ranges whose bound reaches the floor of one of a batch's queries.
    Batches meet the ranges' extremes a chunk at a time."""
    numbered = ranges.select("dim", "range", "most", "least", (F.pmod(F.xxhash64("range"), F.lit(max(1, -(-ranges.count() // SUMMARIES))))).alias("chunk"))
    chunks = numbered.groupBy("dim", "chunk").agg(F.collect_list(F.struct("range", "most", "least")).alias("of")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    there = numbered.groupBy("dim").agg(F.collect_set("chunk").alias("chunks"))  # a row for each length of vectors
    meets = asked.join(floors.hint("merge"), ["dim", "batch"]).join(F.broadcast(there), "dim").withColumn("chunk", F.explode("chunks")).drop("chunks")
    meets = meets.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(SALTS)).cast("int")).join(chunks.hint("merge"), ["dim", "chunk", "salt"])

    def reach(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                high, low = (np.array([np.frombuffer(x[c]) for x in r.of]).reshape(len(r.of), r.dim) for c in ("most", "least"))
                floor = np.frombuffer(r.floor)
                bound = _bounds(_wide(r.kind, r.data, r.dim, len(floor)), high, low)
                for j in np.flatnonzero((bound >= floor[:, None]).any(axis=0)):
                    out.append((r.dim, r.batch, r.of[j]["range"], float(bound[:, j].max())))
            yield pd.DataFrame(out, columns=["dim", "batch", "range", "most"])

    return meets.select("dim", "batch", "kind", "data", "floor", "of").mapInPandas(reach, "dim int, batch long, range long, most double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> tuple[DataFrame, DataFrame]:
    """(hits, ranges): dim, query, id, score of each query's best so far, of which the k best are
    the result, with the blocks it scored; and the ranges with their numbers of blocks."""
    rows = staged(quantized(vectors, id_col, vector_col, scale))
    pivots = _pivots(rows)
    ordered = _ordered(rows, pivots)
    ranges = staged(_packed(ordered, BLOCK, RANGE))
    asked = staged(_asked(_ordered(quantized(queries, id_col, vector_col, scale), pivots), QUERY_BATCH))

    hits, done, round_ = None, None, 0
    while True:
        floors = staged(_floors(asked, hits, k))
        left = _reachable(asked, floors, ranges)
        if done is not None:
            left = left.join(done.hint("merge"), ["dim", "batch", "range"], "left_anti")
        order = Window.partitionBy("dim", "batch").orderBy(F.desc("most"), "range")
        now = staged(left.withColumn("n", F.row_number().over(order)).where(F.col("n") <= GROWTH**round_).select("dim", "batch", "range"))
        if now.isEmpty():
            break
        more = staged(_visit(now, asked, ranges, floors, k))
        hits = more if hits is None else hits.unionByName(more)
        done = now if done is None else done.unionByName(now)
        round_ += 1
    if hits is None:
        hits = rows.sparkSession.createDataFrame([], _HITS)
    return hits, ranges


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all vectors but its own id.

    Scores are integer inner products of quantized vectors (see quantized); only vectors of
    the query's length are candidates. Ties go to the smaller id. Repeated rows count once.
    With fewer than k candidates all come. Scores beyond 64 bits are held at their ends.
    Vectors without structure have bounds that no block is skipped by; results stay exact.
    """
    hits, _ = search(vectors, queries, k, id_col, vector_col, scale)
    ranked = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "id")
    best = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
