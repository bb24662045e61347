"""Large ids beside nulls come through as they are, and columns may have any name."""

from tidemark.llm import fingerprints, langid, mixing, pieces, quality, secrets

LARGE = 9007199254740993
ROWS = [(LARGE, "one two three token=abcdef123", "en", "a", 29), (None, "four five six", "en", "a", 13), (3, None, None, None, 0)]


def frame(spark):
    names = ["row", "text_md5", "text_hash", "runs", "copy", "words", "found", "nth"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *names) for r in ROWS], schema), names


def test_large_ids_beside_nulls(spark):
    df, _ = frame(spark)
    want = {LARGE, None, 3}
    views = quality.score(df.selectExpr("doc_id as id", "text", "source", "lang"), None)
    for out in (langid.identify(df, None), pieces.encode_documents(df, "/opt/tokenizers/piece_bpe_32k.model"), fingerprints.compare_neighbours(df), views):
        assert {r.id for r in out.collect()} == want


def test_columns_of_any_name_stay(spark):
    df, names = frame(spark)
    clean = secrets.redact(df)
    mixed = mixing.mixed_documents(df)
    for out in (clean, mixed, quality.accepted(df, df.selectExpr("doc_id", "1 as quality"))):
        assert out.columns == df.columns
        assert all(r[n] == n for r in out.collect() for n in names)
    assert {r.text for r in clean.collect()} == {"one two three [secret]", "four five six", None}
    assert {r.doc_id for r in mixed.collect()} == {LARGE, None}


def test_stages_leave_nothing_but_their_result(spark, tmp_path):
    from pathlib import Path

    from tidemark.llm import jaccard
    from tidemark.llm.common import kept, shared_dir, stages_dropped

    docs = spark.createDataFrame([(i, f"one two three four five {i % 3}", "a") for i in range(12)], "doc_id long, text string, source string")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    with stages_dropped(spark):
        out = kept(jaccard.one_of_each(docs))
    assert out.count() == 3 and len(set(folder.iterdir()) - before) == 1
