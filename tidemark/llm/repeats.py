"""Suffix-array dedup: removes every byte of a 200-byte string that starts anywhere else too.

Each window of 200 bytes is represented by its least gram of 32 bytes (its anchor), so equal
windows have equal anchors at equal offsets. Anchors that occur once are dropped. A window with
its anchor in its first 84 bytes holds the 116 bytes from the anchor on, any other the 116
that end with the anchor: these two cores group the rest. Equal surroundings of a core go on as
one, with their number. The 16-byte cells of a group's surroundings are the symbols of a text,
whose suffix array (linear grouping by Lyndon prefixes) has equal runs of cells side by side: a
window's whole cells are equal to those of the windows in its interval of the array, and among
these the bytes before and after its whole cells are compared. Windows whose interval holds such
an equal are the spans. Large groups are dealt in parts; windows that are alone in their part
meet those of the other parts by hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, staged
from .suffixes import common_prefixes, suffix_array

LENGTH, GRAM = 200, 32
_REACH = LENGTH - GRAM  # an anchor is at most so far behind its window's start
_HALF = _REACH // 2  # 84
_CORE = _HALF + GRAM  # 116
_SPAN = _REACH + _CORE  # bytes around a core that its windows can cover: 284
_CELL = 16
_PIECE = 1 << 20
#: A suffix array is of so many surroundings about: small groups go together, large ones are dealt in parts.
_BLOCK = 2000

_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = down = np.ones(1, np.uint64)
    inverse = pow(_BASE, -1, 2**64)
    while len(up) < n:
        k = len(up)
        up = np.concatenate([up, up * np.uint64(pow(_BASE, k, 2**64))])
        down = np.concatenate([down, down * np.uint64(pow(inverse, k, 2**64))])
    return up[:n], down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Anchors:
    """Finds the anchors of all windows of a text."""

    def __init__(self):
        self.up, self.down = _powers(_PIECE + LENGTH + 1)

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors; none in texts of fewer than LENGTH bytes."""
        at, of = [], []
        for start in range(0, max(0, len(data) - LENGTH + 1), _PIECE):
            b = np.frombuffer(data, np.uint8)[start : start + _PIECE + LENGTH - 1]
            n = len(b)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
            h = _mixed((sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1])
            # by hash, then by place
            least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            width, goal = 1, _REACH + 1
            while width < goal:
                step = min(width, goal - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            first = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = first[np.concatenate([[True], first[1:] != first[:-1]])]
            at.append(first + start)
            of.append(h[first])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at, index = np.unique(np.concatenate(at), return_index=True)
        return at, np.concatenate(of)[index]


def _anchor_rows(batches):
    finder = _Anchors()
    for batch in batches:
        doc, place, gram = [], [], []
        for key, text in zip(batch.doc, batch.text):
            at, h = finder.find(text.encode("utf-8", "replace"))
            doc.append(np.full(len(at), key, np.int64))
            place.append(at)
            gram.append(h.astype(np.int64))
        if doc:
            yield pd.DataFrame({"doc": np.concatenate(doc), "at": np.concatenate(place), "gram": np.concatenate(gram)})


def _sides(n: int, at: int):
    """(side, core start, first and end byte of what its windows can cover) of an anchor."""
    if at + _CORE <= n:
        lo, hi = max(0, at - (_HALF - 1)), min(n, at + LENGTH)
        if hi - lo >= LENGTH:
            yield 0, at, lo, hi
    if at >= _HALF:
        lo, hi = max(0, at - _REACH), min(n, at + _CORE)
        if hi - lo >= LENGTH:
            yield 1, at - _HALF, lo, hi


def _core_rows(batches):
    """doc, spot (2 * place + side), core, around: hashes of the core, and of it and its surroundings."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            data = r.text.encode("utf-8", "replace")
            for at in r.places.tolist():
                for side, core, lo, hi in _sides(len(data), at):
                    seed = side + 1
                    whole = xxhash.xxh3_64_intdigest(data[lo:hi], seed + (core - lo) * 4)
                    out.append((r.doc, 2 * at + side, xxhash.xxh3_64_intdigest(data[core : core + _CORE], seed) - 2**63, whole - 2**63))
        yield pd.DataFrame(out, columns=["doc", "spot", "core", "around"])


def _surroundings(batches):
    """The bytes of wanted spots: aligned to the core, with the places that exist."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            data = r.text.encode("utf-8", "replace")
            for w in r.wanted:
                for side, core, lo, hi in _sides(len(data), w["spot"] // 2):
                    if side == w["spot"] % 2:
                        begin = core - (_HALF - 1 if side == 0 else _REACH - _HALF)
                        data_ = bytes(lo - begin) + data[lo:hi] + bytes(begin + _SPAN - hi)
                        out.append((w["core"], w["part"], w["parts"], w["around"], r.doc, begin, lo - begin, hi - begin, data_[:_SPAN]))
        yield pd.DataFrame(out, columns=["core", "part", "parts", "around", "doc", "begin", "lo", "hi", "data"])


_UP, _DOWN = _powers(_SPAN + 1)
_STARTS = _SPAN - LENGTH + 1


def _places(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first whole cell of windows that start there, and how many whole cells they hold."""
    begin = -(-starts // _CELL)
    return begin, (starts + LENGTH) // _CELL - begin


def _intervals(block: np.ndarray, group: np.ndarray) -> dict[int, np.ndarray]:
    """By a number of cells: for each surrounding and cell, the interval of the suffix array whose
    suffixes begin with the same so many cells, or -1 where no other does. A cell's symbol is made
    of its bytes, group and place, so that runs match at equal places of one group only."""
    m, cells = len(block), _SPAN // _CELL
    parts = np.ascontiguousarray(block[:, : cells * _CELL]).view(np.uint64).reshape(m, cells, _CELL // 8)
    h = group.astype(np.uint64)[:, None] * np.uint64(cells) + np.arange(cells, dtype=np.uint64)
    for k in range(_CELL // 8):
        # exact: each step numbers the distinct (symbol so far, next 8 bytes)
        pairs = np.stack([h.ravel(), parts[:, :, k].ravel()], axis=1)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        new = np.concatenate([[False], (pairs[order][1:] != pairs[order][:-1]).any(axis=1)])
        h = np.empty(m * cells, np.uint64)
        h[order] = np.cumsum(new).astype(np.uint64)
        h = h.reshape(m, cells)
    _, symbols, times = np.unique(h, return_inverse=True, return_counts=True)
    symbols = symbols.reshape(m, cells)
    common = times[symbols] > 1
    # cells that occur once end every run, and suffixes that begin with one aren't needed:
    # only the stretches of common cells go into the text, each ended by a symbol of its own
    at = np.flatnonzero(common)
    numbers = np.cumsum(times > 1) - 1
    breaks = np.flatnonzero((np.diff(at) != 1) | (at[1:] % cells == 0)) + 1
    place = np.insert(at, breaks, -1)
    text = np.insert(numbers[symbols.ravel()[at]], breaks, 0)
    text[place < 0] = int((times > 1).sum()) + np.arange(len(breaks))
    out = {n: np.full((m, cells), -1, np.int64) for n in sorted({*_places(np.arange(_STARTS))[1].tolist()})}
    if len(text):
        text = text.tolist()
        order = suffix_array(text)
        prefix = np.array(common_prefixes(text, order))
        starts = place[np.array(order)]
        for n, of in out.items():
            near = prefix >= n
            inside = near | np.append(near[1:], False)
            use = inside & (starts >= 0)
            of.ravel()[starts[use]] = np.cumsum(~near)[use]
    return out


def _repeated(block: np.ndarray, group: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For each surrounding and window start: whether the window occurs in another row too. Windows
    of one start in one interval differ in the bytes beside their whole cells only."""
    intervals, out = _intervals(block, group), np.zeros(there.shape, bool)
    for s in range(_STARTS):
        first, n = (int(x) for x in _places(np.array(s)))
        of = intervals[n][:, first]
        rows = np.flatnonzero(there[:, s] & (of >= 0))
        if not len(rows):
            continue
        head, tail = block[rows, s : first * _CELL], block[rows, (first + n) * _CELL : s + LENGTH]
        beside = np.ascontiguousarray(np.hstack([of[rows, None].view(np.uint8).reshape(len(rows), 8), head, tail]))
        _, index, times = np.unique(beside.view(f"V{beside.shape[1]}").ravel(), return_inverse=True, return_counts=True)
        out[rows, s] = times[index] > 1
    return out


def _runs(flags: np.ndarray):
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))


def _settled(batches):
    """From surroundings sorted by core and part: spans (doc, lo, hi) of repeated windows; of cores
    in several parts, also each distinct window (window, doc, lo, hi), to meet those of other parts."""
    held, key = [], None

    def close(rows):
        block = np.frombuffer(b"".join(r.data for r in rows), np.uint8).reshape(len(rows), _SPAN)
        group = np.cumsum([k > 0 and (r.core, r.part) != (rows[k - 1].core, rows[k - 1].part) for k, r in enumerate(rows)])
        lo, hi, begin = (np.array([getattr(r, c) for r in rows], np.int64) for c in ("lo", "hi", "begin"))
        start = np.arange(_STARTS)
        there = (start >= lo[:, None]) & (start + LENGTH <= hi[:, None])
        again = _repeated(block, group, there)
        told: set[int] = set()
        for k, r in enumerate(rows):
            for a, b in _runs(again[k]):
                yield r.doc, int(begin[k] + a), int(begin[k] + b - 1 + LENGTH), None
            if r.parts > 1:
                for s in np.flatnonzero(there[k]):
                    window = xxhash.xxh3_64_intdigest(r.data[s : s + LENGTH], (r.core + int(s) * _BASE) & (2**64 - 1)) - 2**63
                    if not again[k, s] or window not in told:
                        told.add(window)
                        yield r.doc, int(begin[k] + s), int(begin[k] + s + LENGTH), window

    def frame(rows):
        out = list(close(rows)) if rows else []
        return pd.DataFrame({"doc": pd.array([x[0] for x in out], "Int64"), "lo": pd.array([x[1] for x in out], "Int64"), "hi": pd.array([x[2] for x in out], "Int64"), "window": pd.array([x[3] for x in out], "Int64")})

    for batch in batches:
        for r in batch.itertuples():
            if (r.core, r.part) != key:
                if len(held) >= _BLOCK:
                    yield frame(held)
                    held = []
                key = (r.core, r.part)
            held.append(r)
    yield frame(held)


def _cut(batches):
    """doc, n_removed, n_spans, kept_sha256 of texts with their spans."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            kept, spans = cut_spans(r.text.encode("utf-8", "replace"), r.spans)
            out.append((r.doc, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=["doc", "n_removed", "n_spans", "kept_sha256"])


def cut_spans(data: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of data without the spans, and the spans with overlapping ones merged."""
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted((int(s["lo"]), int(s["hi"])) for s in spans):
        if merged and lo <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(hi, merged[-1][1])
        else:
            merged.append((lo, hi))
    kept, last = [], 0
    for lo, hi in merged:
        kept.append(data[last:lo])
        last = hi
    return b"".join([*kept, data[last:]]), merged


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc (a key of id and text), text. Returns (hits, spans): the rows that hold a
    repeated anchor, and (doc, lo, hi) of repeated strings, which may overlap."""
    rows = staged(docs.mapInPandas(_anchor_rows, "doc long, at long, gram long"))
    many = staged(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    places = rows.join(many, "gram").groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("places"))
    hits = bucketed(docs.join(places, "doc"), "doc")
    cores = staged(hits.mapInPandas(_core_rows, "doc long, spot long, core long, around long"))
    counted = staged(cores.groupBy("core", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc", "spot")).alias("of")))

    # equal surroundings: every window around is repeated
    size = hits.select("doc", F.octet_length("text").alias("size")).distinct()
    same = cores.join(counted.where("n > 1").select("core", "around"), ["core", "around"]).select("doc", "spot").join(size, "doc")
    at, left = F.floor(F.col("spot") / 2), F.col("spot") % 2 == 1
    lo = F.greatest(at - F.when(left, _REACH).otherwise(_HALF - 1), F.lit(0))
    hi = F.least(at + F.when(left, _CORE).otherwise(LENGTH), F.col("size"))
    full = same.select("doc", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    # different surroundings of one core: one of each goes to the suffix arrays
    mixed = staged(counted.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    parts = F.ceil(F.col("kinds") / _BLOCK).cast("int")
    one = F.struct("of.spot", "core", "around", F.pmod("around", parts).cast("int").alias("part"), parts.alias("parts"))
    wanted = counted.join(mixed.hint("merge"), "core").select("of.doc", one.alias("w")).groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    around = hits.join(wanted, "doc").mapInPandas(_surroundings, "core long, part int, parts int, around long, doc long, begin long, lo int, hi int, data binary")
    around = around.repartition("core", "part").sortWithinPartitions("core", "part", "around")
    settled = staged(around.mapInPandas(_settled, "doc long, lo long, hi long, window long"))
    # windows that are alone in their part, or stand for those of one part, in several parts
    across = settled.where("window is not null").groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    split = settled.join(across, "window").select("doc", "lo", "hi")
    return hits, full.unionByName(settled.where("window is null").select("doc", "lo", "hi")).unionByName(split)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Matches lie within documents, and are judged on the input: overlapping and touching strings
    merge into one span, and nothing is put in place of what goes. Null texts count as empty.
    A repeated row is another document, so both lose whatever is long enough. An empty table
    gives no rows. No anchor or group is dropped for its frequency.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("doc"), text.alias("text"))
    hits, spans = repeated_spans(rows.select("doc", "text"))
    by_doc = spans.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cut = hits.join(by_doc, "doc").mapInPandas(_cut, "doc long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc"])
    every = rows.select("id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    out = every.join(cut, "doc", "left")
    return out.select("id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))
