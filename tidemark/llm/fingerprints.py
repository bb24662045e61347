"""Lempel-Ziv phrase fingerprints: likeness of documents in the sense of compression.

A document's UTF-8 bytes are parsed into dictionary phrases: each phrase is the shortest that
wasn't seen before. The phrases' hashes fall into BINS bins, and the least hash of each bin
makes the signature (empty bins take the next full bin's, moved by how far off it is). Likeness is the share of equal places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

BINS = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


class _Powers:
    """Powers of the hash base and its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 2**64))])
        return self.up[:n], self.down[:n]


def _parse(data: bytes, start: int, node: int, tree: dict, cuts: list) -> int:
    """Goes on with the parse at `start`, inside the phrase that has led to `node`: appends where
    phrases end, adds them to the tree (node * 256 + byte -> node) and returns the last node."""
    nodes = len(tree)
    for at, byte in enumerate(data[start:] if start else data, start + 1):
        key = node << 8 | byte
        after = tree.get(key)
        if after is None:
            nodes += 1
            tree[key] = nodes
            cuts.append(at)
            node = 0
        else:
            node = after
    return node


def _signature(data: bytes, cuts: list, powers: _Powers) -> np.ndarray:
    """BINS values of 16 bits. A text without phrases has all ones."""
    if not cuts:
        return np.full(BINS, 0xFFFF, np.uint16)
    up, down = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    ends = np.array(cuts)
    begins = np.concatenate([[0], ends[:-1]])
    h = (sums[ends] - sums[begins]) * down[begins]
    # finalizer, so that all bits depend on all
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = np.sort(h ^ (h >> np.uint64(31)))
    width = 64 - BINS.bit_length() + 1
    bins = (h >> np.uint64(width)).astype(np.int64)
    at = np.searchsorted(bins, np.arange(BINS)) % len(h)  # where a bin is empty: the next full one's
    low, far = h[at] >> np.uint64(width - 16), (bins[at] - np.arange(BINS)) % BINS
    return (low + far.astype(np.uint64) * np.uint64(0x9E37)).astype(np.uint16)


def fingerprint(text: str, powers: _Powers | None = None) -> np.ndarray:
    data, cuts = text.encode("utf-8", "replace"), []
    _parse(data, 0, 0, {}, cuts)
    return _signature(data, cuts, powers or _Powers())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _compared(text: str, after: str, powers: _Powers) -> tuple:
    """The columns that need the text and the next: edited_sha256 to near_edited."""
    half = len(text) // 2
    kept = text[: len(text) - half]
    edited = (kept + after[:half]).encode("utf-8", "replace")
    data, cuts, tree = text.encode("utf-8", "replace"), [], {}
    # both texts share their beginning, and so the parse up to there
    shared = len(kept.encode("utf-8", "replace"))
    node = _parse(data[:shared], 0, 0, tree, cuts)
    more, other = list(cuts), dict(tree)
    _parse(data, shared, node, tree, cuts)
    _parse(edited, shared, node, other, more)
    own, changed = _signature(data, cuts, powers), _signature(edited, more, powers)
    return hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed)


_COLUMNS = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next id (equal ids by text, null ids last), after the
    last comes the first. The edited text has its last floor(n_chars / 2) code points replaced
    by the next document's first as many. Null texts count as empty; a text without phrases is
    like another such only. A repeated row is a document of its own, next to its like; a table
    with one row has itself as next. Ids pass through Python as text. Texts are sorted by id once; neighbours across partitions meet afterwards,
    a row for each partition.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = [F.col("own").asc_nulls_last(), F.col("hash")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    schema = "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge string, text string"

    def compare(batches):
        part, powers, first, last, waiting = TaskContext.get().partitionId(), _Powers(), None, None, None
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if last is not None:
                    sha, own, changed, near = _compared(last[1], r.text, powers)
                    if waiting is not None:
                        out.append((*waiting[:6], likeness(waiting[6], own), part, None, None))
                    waiting = (last[0], len(last[1]), sha, _hex(own), _hex(changed), near, own)
                else:
                    first = (r.id, r.text)
                last = (r.id, r.text)
            yield pd.DataFrame(out, columns=[*_COLUMNS, "part", "edge", "text"])
        if last is not None:
            # the last two still need what the next partition begins with
            out = [(first[0], None, None, None, None, None, None, part, "first", first[1]), (last[0], None, None, None, None, None, None, part, "last", last[1])]
            if waiting is not None:
                out.append((*waiting[:6], likeness(waiting[6], fingerprint(last[1], powers)), part, None, None))
            yield pd.DataFrame(out, columns=[*_COLUMNS, "part", "edge", "text"])

    done = staged(ordered.mapInPandas(compare, schema))
    by_part = Window.orderBy("part")  # a row for each partition
    firsts = done.where("edge = 'first'").select("part", F.col("text").alias("after"))
    follow = firsts.select("part", F.coalesce(F.lead("after").over(by_part), F.first("after").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))

    def close(batches):
        powers = _Powers()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                sha, own, changed, near = _compared(r.text, r.after, powers)
                out.append((r.id, len(r.text), sha, _hex(own), _hex(changed), near, likeness(own, fingerprint(r.after, powers))))
            yield pd.DataFrame(out, columns=_COLUMNS)

    ends = done.where("edge = 'last'").join(follow, "part").select("id", "text", "after").mapInPandas(close, schema.split(", part")[0])
    return done.where("edge is null").select(*_COLUMNS).unionByName(ends).withColumn("id", F.col("id").cast(kind))
