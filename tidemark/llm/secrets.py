"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Patterns find candidates with their places. The hash of each candidate's value is aggregated
over the corpus by distinct repository and owner: values that many owners share are examples,
values of one or few owners look live. Bare tokens, which no pattern names, become spans only
where that frequency, and their own look or another place with a key, speaks for a credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed_row, staged

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: kind, pattern, group of the value, least characters of the value
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Whole runs of value characters; those without a digit are dropped.
BARE = r"[A-Za-z0-9+/_.=-]{16,}"
KINDS = ("assign", "access", "hex", "bare")
#: A value of at least so many owners, or repositories whoever owns them, is an example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 1000
#: Parts that the places of one value are dealt in.
_SALTS = 16
_DOC = ["id", "text_hash"]


def _faster(pattern: str, least: int) -> str:
    """For a pattern that is one run, asking for its least length finds the same matches."""
    return {ACCESS: rf"AKIA[A-Z0-9]{{{least - 4},}}", HEX: rf"[0-9a-f]{{{least},}}"}.get(pattern, pattern)


def _found(kind: str, pattern: str, group: int) -> Column:
    """Array of struct(kind, at, gap, match, value): matches and the text before each."""
    text = F.col("text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("match"), value.alias("value")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), F.length(x["match"]).alias("n"), x["value"].alias("value")),
    )
    empty = F.array().cast("array<struct<kind:string,at:int,gap:int,n:int,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(rows, lambda x: x["n"].isNotNull())).otherwise(empty)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """id, text_hash, repo, owner, kind, start, end, value of every match that is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    least = {kind: n for kind, _, _, n in BASE} | {"bare": 16}
    found = F.concat(*[_found(k, _faster(p, n), g) for k, p, g, n in BASE], _found("bare", BARE, 0))
    # a document's matches are numbered within their kind, so places are running sums of lengths
    rows = rows.select(*_DOC, "repo", "owner", F.explode(found).alias("m")).select(*_DOC, "repo", "owner", "m.*")
    rows = rows.dropDuplicates([*_DOC, "kind", "at"])
    before = Window.partitionBy(*_DOC, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("n")).over(before), F.lit(0)) + F.col("gap")
    rows = rows.withColumn("start", start.cast("bigint")).withColumn("end", (F.col("start") + F.col("n")).cast("bigint"))
    enough = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("kind"))
    digit = (F.col("kind") != "bare") | F.col("value").rlike("[0-9]")
    return rows.where((F.length("value") >= enough) & digit).select(*_DOC, "repo", "owner", "kind", "start", "end", "value")


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """value_hash, n_repos, n_owners, keyed, label: frequency of each value over the corpus.

    Distinct repositories are counted within owners, then owners: each step pre-aggregates
    before its shuffle, so a value that a third of all documents hold meets in no one task.
    Values that many owners share, or very many repositories of any owner, are examples.
    """
    one = found.groupBy(F.sha2("value", 256).alias("value_hash"), "owner", "repo").agg(F.max((F.col("kind") != "bare").cast("int")).alias("keyed"))
    per_owner = one.groupBy("value_hash", "owner").agg(F.count("*").alias("n_repos"), F.max("keyed").alias("keyed"))
    freq = per_owner.groupBy("value_hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"), F.max("keyed").alias("keyed"))
    return freq.withColumn("label", F.when((F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos), "example").otherwise("live"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """id, text_hash, kind, start, end, label, n_repos, n_owners of every span.

    Base spans all stay; their label says whether their value is an example or looks live. A
    bare token is a span if it touches no base span, looks live, and its value either stands
    behind a key elsewhere or mixes upper case, lower case and digits in 20+ characters.
    Null texts count as empty, null repositories and owners as one each. Rows with equal id and
    text have one set of spans. An empty table gives no rows. Places count code points, ends exclusive.
    """
    found = staged(candidates(docs, id_col, text_col, repo_col, owner_col)).withColumn("value_hash", F.sha2("value", 256))
    # a value of very many places meets its frequency in several parts
    freq = ownership(found, example_owners, example_repos).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    spans = found.withColumn("salt", F.pmod(F.xxhash64(*_DOC, "start"), F.lit(_SALTS)).cast("int")).join(freq, ["value_hash", "salt"])
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]") & (F.length("value") >= 20)
    base = F.col("kind") != "bare"
    spans = spans.where(base | ((F.col("label") == "live") & ((F.col("keyed") == 1) | mixed)))
    order = Window.partitionBy(*_DOC).orderBy("start", (~base).cast("int"))
    reached = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.withColumn("_in", (F.coalesce(reached, F.lit(0)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end")))
    return spans.where(base | ~F.col("_in")).select(*_DOC, "kind", "start", "end", "label", "n_repos", "n_owners")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id and text_hash of every row, with counts, base_sha256 and spans. Repeated rows come as often as they are."""
    spans = secret_spans(docs, id_col, text_col, **how)
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), *[F.lit(None).cast(t).alias(c) for c, t in spans.dtypes[2:]])
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.struct("start", rank.alias("rank"), "kind", "end")
    rows = every.unionByName(spans).groupBy(*_DOC).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.count_if(F.col("label") == "live").alias("n_live"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("all"),
        F.count_if(F.col("kind").isNull()).alias("copies"),
    )
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.withColumn("base_sha256", F.sha2(said(F.filter("all", lambda x: x["kind"] != "bare")), 256)).withColumn("spans", said(F.col("all"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("all", "copies", "copy")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", **how) -> DataFrame:
    """docs with each span (overlapping ones together) replaced by [secret] or, if all its
    values are examples, [example]. No row goes; texts without spans stay as they are."""
    spans = secret_spans(docs, id_col, text_col, **how)
    order = Window.partitionBy(*_DOC).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("group", F.sum((F.coalesce(reached, F.lit(0)) <= F.col("start")).cast("int")).over(order))
    runs = spans.groupBy(*_DOC, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("label") == "live", "[secret]").otherwise("[example]")).alias("mark"))
    last = F.lag("end", 1, 0).over(Window.partitionBy(*_DOC).orderBy("start"))
    runs = runs.withColumn("last", last).groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end", "last", "mark"))).alias("runs"))
    text = F.col(text_col)
    # the text travels once, in its row
    rows = docs.select(packed_row(docs), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    rows = rows.alias("d").join(runs.alias("r"), (F.col("d.text_hash") == F.col("r.text_hash")) & F.col("d.id").eqNullSafe(F.col("r.id")), "left").select("row", F.col("row")[text_col].alias("text"), "runs")
    pieces = F.transform("runs", lambda r: F.concat(F.substring("text", r["last"] + 1, r["start"] - r["last"]), r["mark"]))
    tail = F.substring("text", F.element_at("runs", -1)["end"] + 1, F.length("text"))
    rows = rows.withColumn("clean", F.when(F.col("runs").isNotNull(), F.concat(F.array_join(pieces, ""), tail)))
    row = F.col("row").withField(f"`{text_col}`", F.coalesce("clean", "text"))
    if n_chars_col and n_chars_col in docs.columns:
        row = row.withField(f"`{n_chars_col}`", F.coalesce(F.length("clean").cast(docs.schema[n_chars_col].dataType), F.col("row")[n_chars_col]))
    return rows.select(row.alias("row")).select("row.*")
