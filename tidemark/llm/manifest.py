"""A Merkle manifest of a dataset, as a persistent tree.

Leaves are digests of rows, ordered within their group; three nodes in a row make one of the next
level. The tree is built in aligned blocks of 3^LEVELS nodes: each task holds a block, and the
blocks' tops are the nodes of the next round, up to each group's subroot and from the subroots to
the root. A tampered leaf makes a version of its own: the nodes above it are copied, all others
are shared with the untampered tree. A version goes from its leaf to its block's top, and on along
the path that the block has through the rounds above.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: Nodes that make one of the next level, and levels of a block.
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS
#: Rows of a partition are numbered below this (Spark's own numbering).
_SHIFT = 33


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row's values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def _joined(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def block_tree(nodes: list[bytes], alone: bool) -> list[list[bytes]]:
    """The levels of a block, lowest first. A block that is its group's only one ends at one node,
    others after LEVELS levels, so that all tops are of the same level."""
    levels = [nodes]
    while len(levels[-1]) > 1 if alone else len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([_joined(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of a node's ancestors and itself in their runs, up to the block's top."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % ARITY
        out.append((b"".join(nodes[run:at]), b"".join(nodes[at + 1 : run + ARITY])))
        at //= ARITY
    return out


def copied(path: list[tuple[bytes, bytes]], digest: bytes) -> list[bytes]:
    """The nodes that a version copies above a changed node, bottom up; the siblings stay shared."""
    out = []
    for left, right in path:
        digest = _joined([left, digest, right])
        out.append(digest)
    return out


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with pos (from 0 within `group`, by order) and n (the group's rows). Rows are dealt by
    ranges, so a group with a third of all rows is numbered in many tasks; then only a row for each
    group and partition is ordered."""
    placed = staged(rows.repartitionByRange(F.col("group"), *order).sortWithinPartitions(F.col("group"), *order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", _SHIFT)).withColumn("at", F.col("at").bitwiseAND((1 << _SHIFT) - 1))
    parts = placed.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    w = Window.partitionBy("group")
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("group", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("n"))
    return placed.join(parts, ["group", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(nodes: DataFrame, width: int):
    return nodes.withColumn("block", F.floor(F.col("pos") / width).cast("long")).groupBy("group", "block")


def _tops(nodes: DataFrame) -> DataFrame:
    """group, pos, n, digest of the blocks' tops: the nodes of the next round."""
    alone, tree = F.col("n") <= BLOCK, block_tree

    def top(key, table):
        rows = sorted(zip(table["pos"].to_pylist(), table["digest"].to_pylist()))
        levels = tree([d.hex().encode() for _, d in rows], table["alone"][0].as_py())
        return pa.table({"group": [key[0].as_py()], "pos": [key[1].as_py()], "n": [table["upper"][0].as_py()], "digest": [bytes.fromhex(levels[-1][0].decode())]}, schema=pa.schema([("group", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

    upper = F.ceil(F.col("n") / BLOCK).cast("long")
    rows = nodes.select("group", "pos", "digest", alone.alias("alone"), upper.alias("upper"))
    return _blocks(rows, BLOCK).applyInArrow(top, "group string, pos long, n long, digest binary")


def _paths(nodes: DataFrame) -> DataFrame:
    """group, pos, lefts, rights, top of all nodes: the siblings on their way to their group's top,
    as hex texts, in as many rounds as the largest group has levels of blocks."""
    tree, around = block_tree, siblings
    schema = pa.schema([("group", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("top", pa.string())])

    def climb(key, table):
        rows = sorted(zip(table["pos"].to_pylist(), table["digest"].to_pylist()))
        n, first = table["n"][0].as_py(), rows[0][0]
        levels = tree([d.hex().encode() for _, d in rows], n <= BLOCK)
        ways = [around(levels, pos - first) for pos, _ in rows]
        k, top = len(rows), levels[-1][0].decode()
        sides = [[[x[side].decode() for x in way] for way in ways] for side in (0, 1)]
        return pa.table([[key[0].as_py()] * k, [pos for pos, _ in rows], [n] * k, [key[1].as_py()] * k, *sides, [top] * k], schema=schema)

    rounds = []
    while True:
        done = staged(_blocks(nodes, BLOCK).applyInArrow(climb, "group string, pos long, n long, block long, lefts array<string>, rights array<string>, top string"))
        rounds.append(done)
        if (done.agg(F.max("n")).first()[0] or 0) <= BLOCK:
            break
        nodes = done.where(F.col("pos") % BLOCK == 0).select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.unhex("top").alias("digest"))
    above = rounds.pop().select("group", "pos", "lefts", "rights", "top")
    while rounds:
        upper = above.select("group", F.col("pos").alias("block"), F.col("lefts").alias("more_l"), F.col("rights").alias("more_r"), F.col("top").alias("last"))
        above = rounds.pop().join(upper, ["group", "block"]).select("group", "pos", F.concat("lefts", "more_l").alias("lefts"), F.concat("rights", "more_r").alias("rights"), F.col("last").alias("top"))
    return above


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", tampered: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, version of every row.

    leaf is the digest of the row's columns; leaves ascend by id within their group (nulls last,
    equal ids by their digests), groups by their bytes (null first). tampered gives columns other
    values: a row whose leaf changes by them has a version of the tree, whose copied nodes (from
    the leaf's parent to the root) are in `version`; folded_root is the version's root. Of other
    rows version is empty and folded_root is worked out from the leaf. proof_sha256 is the digest of
    all siblings on the way. Null, empty and long values are hashed whole; repeated rows are leaves
    of their own; columns that aren't named don't matter; an empty table gives no rows.
    """
    own = [F.col(c) for c in columns]
    changed = leaf_digest(*[(tampered or {}).get(c, F.col(c)) for c in columns])
    # null first, then all others by their bytes
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit(""))
    kind = docs.schema[id_col].dataType
    leaves = docs.select(group.alias("group"), F.col(id_col).alias("id"), leaf_digest(*own).alias("digest"), (changed if tampered else F.lit(None).cast("binary")).alias("other"))
    leaves = leaves.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")))
    leaves = staged(_numbered(staged(leaves), [F.col("id").asc_nulls_last(), F.col("digest"), F.col("other")]))

    blocks = _paths(_tops(leaves))
    subroots = staged(blocks.where("pos = 0").select(F.lit("").alias("group"), F.col("group").alias("id"), F.unhex("top").alias("digest")))
    last = _numbered(subroots, [F.col("id")])
    last = _paths(last).join(last.select("pos", F.col("id").alias("of")), "pos").select(F.col("of").alias("group"), F.col("lefts").alias("more_l"), F.col("rights").alias("more_r"), F.col("top").alias("root"))
    blocks = staged(blocks.join(last, "group").select("group", F.col("pos").alias("block"), F.concat("lefts", "more_l").alias("lefts"), F.concat("rights", "more_r").alias("rights"), F.col("top").alias("subroot"), "root"))

    tree, around, copy = block_tree, siblings, copied

    def prove(key, rows, upper):
        order = pc.sort_indices(rows["pos"]).to_pylist()
        rows = rows.take(order)
        digests = [d.hex().encode() for d in rows["digest"].to_pylist()]
        levels = tree(digests, rows["alone"][0].as_py())
        above = [(a.encode(), b.encode()) for a, b in zip(upper["lefts"][0].as_py(), upper["rights"][0].as_py())]
        proofs, folded, versions = [], [], []
        for at, (digest, other) in enumerate(zip(digests, rows["other"].to_pylist())):
            path = around(levels, at) + above
            proofs.append(hashlib.sha256(b"".join([x for sides in path for x in sides])).hexdigest())
            start = digest if other is None else other.hex().encode()
            nodes = copy(path, start)
            folded.append((nodes[-1] if nodes else start).decode())
            versions.append([] if other is None else [x.decode() for x in nodes])
        k = len(digests)
        return pa.table({"id": rows["id"], "leaf": [d.decode() for d in digests], "subroot": [upper["subroot"][0].as_py()] * k, "root": [upper["root"][0].as_py()] * k, "proof_sha256": proofs, "folded_root": folded, "version": pa.array(versions, pa.list_(pa.string()))})

    rows = leaves.select("group", "pos", "id", "digest", "other", (F.col("n") <= BLOCK).alias("alone"))
    schema = f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, version array<string>"
    return _blocks(rows, BLOCK).cogroup(blocks.groupBy("group", "block")).applyInArrow(prove, schema)
