"""License scans against brute force: all blocks, all templates, no filters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, queries

COLUMNS = "doc_id long, text string, words string, label string, block int, rank string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(licenses.WORD, low)


def brute(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    """(n_words, n_base, first, last, base labels, labels, score)."""
    w, base, labels, best = words(text), [], set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        base += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    for label, said in templates:
        want, s = set(said.split()), licenses.width(len(said.split()))
        for k in range(0, len(w), s):
            share = len(want & set(w[k : k + 2 * s])) / len(want)
            if share >= threshold / 100:
                labels.add(label)
                best = max(best, share)
    own = {label for _, label in base}
    at = [k for k, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), 1.0 if base else best


def awkward():
    rng = random.Random(4)
    plain = "der the of a und license software mit public version 2 0 4 cc by nc is this you may any use world über 日本 x1".split()
    prose = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    rows = [(None, None), (None, "MIT License"), (0, None), (1, ""), (2, " .,- "), (3, "MIT License"), (4, "mit license mit license MIT-LICENSE, the mıt license mİt license"), (5, "Kit K Mit License worK")]
    rows += [(6, "(c) MIT\nLicense; the Apache License, General\tPublic--License. mit license"), (7, "xmit license mit licenses mit the license")]
    for k, (_, said) in enumerate(licenses.TEMPLATES):
        w = said.split()
        rows.append((10 + k, f"{prose(rng.randrange(90))} {said.upper()} {prose(20)}"))
        short = [x for x in w if x != rng.choice(w)]
        rows.append((40 + k, f"{prose(rng.randrange(90))} {', '.join(short)} {prose(20)}"))
        rows.append((70 + k, f"{prose(5)} {' '.join(w[: len(w) // 2])} {prose(200)} {' '.join(w[len(w) // 2 :])}"))
        mixed = rng.sample(w, len(w))
        rows.append((100 + k, " ".join(mixed)))
    rows += [(200 + k, prose(rng.randrange(1, 300))) for k in range(60)]
    rows += [(300, prose(60_000) + " released under the mit license"), (301, "mit license " * 5000), (3, "MIT License"), (3, "MIT License"), (9, "日 " * 30_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "w", "l", 1, "r") for i, t in awkward()], COLUMNS).cache()


def test_scan_is_brute_force(spark, docs):
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in awkward()), key=str)
    assert {"cc-by-nc", "gpl,lgpl", "unlicense", "apache,gpl,mit"} <= {r[6] for r in got}
    assert licenses.scan(docs.where("false")).count() == 0


@pytest.mark.parametrize("threshold", [60, 75, 100])
def test_other_thresholds_lose_no_block(docs, threshold):
    got = sorted((tuple(r) for r in licenses.scan(docs, threshold=threshold).collect()), key=str)
    assert got == sorted(((i, *brute(t, threshold=threshold)) for i, t in awkward()), key=str)


def test_blocks_say_where(spark):
    said = dict(licenses.TEMPLATES)["unlicense"]
    df = spark.createDataFrame([(1, "so " * 40 + said + " so" * 40)], "doc_id long, text string")
    got = [(r.label, r.first_word, r.n_words, r.contained) for r in licenses.license_blocks(df).orderBy("first_word").collect()]
    assert got == [("unlicense", 32, 32, 1.0)]
    assert licenses.license_blocks(df, templates=(("x", "so so very"),), threshold=50).count() == 12
    with pytest.raises(ValueError, match="no templates"):
        licenses.license_blocks(df, templates=())


def test_frequencies_order_the_prefix(docs):
    n = {r.word: r.n for r in licenses.frequencies(docs).collect()}
    rows, rank = licenses._index(docs, "text", licenses.TEMPLATES, 90)
    assert [n.get(w, 0) for w in sorted(rank, key=rank.get)] == sorted(n.get(w, 0) for w in rank)
    assert all(n[w] == sum(w in words(t) for _, t in awkward()) for w in n)
    for _, r, k, _, ranks, at, need, _ in rows:
        assert ranks[at] == r and at <= len(ranks) - need and ranks == sorted(ranks)


def test_phrases_that_overlap_themselves_are_refused(docs):
    with pytest.raises(ValueError, match="overlap"):
        licenses.scan(docs, phrases={"a b a": "x"})


def test_plan_has_no_python(docs):
    said = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", said)


def test_registered_query(spark, tmp_path):
    spark.createDataFrame(awkward(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_license_scan(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.col("score"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *brute(t)) for i, t in awkward()), key=str)
