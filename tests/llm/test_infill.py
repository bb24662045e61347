"""Fill-in-middle against a plain rewriting, and its chunks, cache and cuts by themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import infill, queries

COLUMNS = "doc_id long, text string, n long, form string, data string"


def plainly(i, text):
    """The contract, said with code points."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def awkward():
    rng = random.Random(7)
    made = lambda n: "".join(rng.choice(["a", "b ", "é", "日", "😀", "<", "P>", "\n", "S", "<M"]) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "x"), (3, "<"), (4, "<M"), (5, "a<P>b"), (6, "y" * 300 + "<S>"), (None, "null id"), (None, None)]
    rows += [(i, made(rng.randrange(0, 900))) for i in range(7, 200)]
    passage = made(3000).replace("<M", "M").replace("<", "")
    rows += [(i, made(50).replace("<", "") + passage) for i in range(200, 215)]
    rows += [(300, "日" * 200_000), (301, "word " * 100_000), (302, passage * 300), (-5, "minus"), (210, rows[-1][1]), (210, rows[-1][1])]
    # marks that lie across the edge of two chunks
    rows += [(400 + k, "q" * (infill.MOST - k) + "<S>" + "q" * 50) for k in range(4)]
    return rows


def test_rows_are_those_of_a_plain_rewriting(spark):
    rows = awkward()
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], COLUMNS)
    out = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=str)
    assert got == sorted(((i, *plainly(i, t)) for i, t in rows), key=str)
    assert sorted((r.back for r in out.collect()), key=str) == sorted((t or "" for _, t in rows), key=str)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.where("false")).count() == 0


def test_output_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(infill, "BATCH", 1000)
    rows = [(i, "ab" * (i % 700)) for i in range(400)]
    out = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.id, r.n, r.output) for r in out) == sorted((i, plainly(i, t)[0], plainly(i, t)[4]) for i, t in rows)


def test_chunks_cover_and_follow_content(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    whole = infill.chunk_ends(data)
    assert whole[-1] == len(data) and whole == sorted(set(whole))
    sizes = [b - a for a, b in zip([0, *whole], whole)]
    assert all(infill.LEAST <= s <= infill.MOST for s in sizes[:-1]) and 150 < sum(sizes) / len(sizes) < 800
    monkeypatch.setattr(infill, "SLAB", 1000)
    assert infill.chunk_ends(data) == whole  # slabs change nothing
    shifted = {e - 777 for e in infill.chunk_ends(bytes(777) + data)}
    assert len(shifted & set(whole)) > 0.9 * len(whole)  # what stands before changes few ends
    assert infill.chunk_ends(b"") == [] and infill.chunk_ends(bytes(10_000))[-1] == 10_000


def test_shared_chunks_are_known_and_the_cache_is_bounded(monkeypatch):
    rng = random.Random(2)
    data = "".join(rng.choice("abcdé ") for _ in range(50_000)).encode()
    known = infill.Summaries()
    first = infill.Chunked(data, known)
    before = len(known.new)
    again = infill.Chunked(b"another beginning" + data, known)
    assert len(known.new) - before < 0.1 * before and len(first) == len(data.decode()) == len(again) - 17
    monkeypatch.setattr(infill, "KEPT", 5000)
    small = infill.Summaries()
    for _ in range(3):
        assert len(infill.Chunked(data, small)) == len(first)
        assert sum(map(len, small.new)) + sum(map(len, small.old)) <= 2 * (5000 + infill.MOST)
    text = data.decode()
    assert all(first.byte_of(c) == len(text[:c].encode()) for c in rng.sample(range(len(text) + 1), 500))


def test_registered_query(spark, tmp_path):
    rows = awkward()
    spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *(p := plainly(i, t))[:4], sha(p[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, queries.op12_fill_in_middle(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_restored_beside_marks(spark, form):
    """Parts that end or begin like marks."""
    parts = [("<", "S>", "<"), ("<S", "M>", "<M"), ("P>", "<P", "S><"), ("", "", "<"), ("<<", ">", "")]
    said = [f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}" for p, m, s in parts]
    df = spark.createDataFrame([(x, form) for x in said], "output string, form string")
    assert [r[0] for r in df.select(infill.restored(F.col("output"), F.col("form"))).collect()] == ["".join(p) for p in parts]
