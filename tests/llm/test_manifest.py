"""The Merkle manifest against a tree built in one list, with whole recomputation after tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, pos int, group string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    i, text, lang, source, n = row
    return h(*map(said, (i, source, lang, n, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 3 * 3
        out += [nodes[k] for k in range(run, min(run + 3, len(nodes))) if k != at]
        at //= 3
    return out


def brute(rows):
    """The contract's rows. A tampered leaf's root comes from a whole new tree."""
    by = {}
    for r in rows:
        i, text, *rest = r
        changed = text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        other = leaf((i, text.replace("\n", "") if changed else text, *rest))
        by.setdefault(r[3], []).append((i is None, i or 0, leaf(r), other, i))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, (_, _, own, other, i) in enumerate(sorted(by[s])):
            nodes = list(trees[s][0])
            nodes[at] = other
            subs = list(top[0])
            subs[k] = levels_of(nodes)[-1][0]
            folded = levels_of(subs)[-1][0]
            root = top[-1][0]
            out.append((i, own, trees[s][-1][0], root, h(*siblings(trees[s], at), *siblings(top, k)), folded, folded == root))
    return sorted(out, key=str)


def awkward(n):
    rng = random.Random(n)
    rows = [(i, "".join(rng.choice("ab\né") for _ in range(rng.randrange(40))), rng.choice(["en", None]), "hot" if rng.random() < 0.6 else rng.choice(["b", "é", "Z", "", "~", None, "solo-" + str(i % 5)]), i) for i in rng.sample(range(-50, 10 * n), n)]
    return rows + [(None, None, None, None, None), (None, "x\ny", "en", "hot", 3), (None, "x\ny", "en", "hot", 3), (7_000_000, "\n" * 300_000, "en", "one alone", 1), rows[0], rows[0], (rows[1][0], "other text\n", "en", rows[1][3], 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, "g", "d") for r in rows], COLUMNS)


@pytest.mark.parametrize(("n", "levels"), [(40, 1), (300, 2), (300, 6), (3, 6)])
def test_registered_query_is_brute_force(spark, tmp_path, monkeypatch, n, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    rows = awkward(n)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    want = brute(rows)
    assert got == want
    assert 0 < sum(r[-1] for r in want) < len(want)


def test_more_than_a_block(spark, tmp_path):
    rows = [(i, f"{i}\n" if i % 3 else "x", "en", "hot" if i < 2300 else "b", i) for i in range(2400)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    some = random.Random(1).sample(range(2400), 40)
    tree, top = levels_of([leaf(r) for r in rows[:2300]]), None
    small = levels_of([leaf(r) for r in rows[2300:]])
    top = levels_of([small[-1][0], tree[-1][0]])
    for i in some:
        own, at, k = (tree, i, 1) if i < 2300 else (small, i - 2300, 0)
        assert got[i][1:5] == (own[0][at], own[-1][0], top[-1][0], h(*siblings(own, at), *siblings(top, k)))


def test_versions_copy_the_path_alone(spark):
    rows = [(i, "a\nb", "en", "s", 3) for i in range(1000)]
    docs = frame(spark, rows)
    out = manifest.manifest(docs, ["doc_id", "text"], tampered={"text": F.when(F.col("doc_id") % 10 == 0, "forged").otherwise(F.col("text"))}).collect()
    assert {len(r.version) for r in out if r.id % 10} == {0} and {len(r.version) for r in out if r.id % 10 == 0} == {7}
    assert all((r.folded_root == r.root) == bool(r.id % 10) and (not r.version or r.version[-1] == r.folded_root) for r in out)
    nodes = [x for r in out for x in r.version]
    assert len(nodes) == len(set(nodes)) == 700  # each version has its own copies
    kept = manifest.manifest(docs, ["doc_id"])
    assert kept.where("size(version) > 0 or folded_root != root").count() == 0


def test_an_empty_table_and_one_leaf(spark):
    assert manifest.manifest(frame(spark, []), ["doc_id", "text"]).count() == 0
    (r,) = manifest.manifest(frame(spark, [(1, "x", None, None, None)]), ["doc_id"]).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == h("1:1") and r.proof_sha256 == h("")


def test_partitioning_changes_nothing(spark):
    docs = frame(spark, awkward(200))
    roots = {manifest.manifest(docs.repartition(k), ["doc_id", "text", "source"]).select("root").distinct().first()[0] for k in (1, 7)}
    assert len(roots) == 1
