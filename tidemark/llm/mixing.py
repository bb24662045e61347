"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative target shares, which gives every slot
of the schedule a source; slots are ranked within their source, and slot k of a source takes
block k of that source's shuffled token stream, which repeats at most `epochs` times.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, exclusive_offsets, packed_row, rows_or_one, staged

#: Weights by the source's rank in code-point order, repeating.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Tokens that a slot takes.
BLOCK_TOKENS = 32
_CELLS, _CHUNK = 1024, 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, no, one row for each source (null is a source, ranked last); no is its rank from 1.

    Targets are in proportion to the weights and sum to all tokens, but stop at `epochs` times
    the source's size; the excess goes to the others by weight until none is above. With the
    sources ordered by limit per unit of weight, the level is that of the first that stays
    below its limit. Only this table, a row for each source, is ordered as a whole.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(rank, F.lit(len(weights))) + 1)
    per = per.select("source", "source_size", (rank + 1).alias("no"), w.alias("w"), (F.col("source_size") * float(epochs)).alias("limit"))
    order = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (total - below) / rest)
    stays = F.when(F.col("limit") / F.col("w") >= F.col("level"), F.col("level"))
    level = F.first(stays, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("target", F.least(F.col("limit"), F.coalesce(level, F.lit(0.0)) * F.col("w"))).select("source", "source_size", "target", "no")


def _points(slot):
    """frac(0.5 + slot * golden ratio), by two products so that large slots keep their precision."""
    getcontext().prec = 50
    golden = (Decimal(5).sqrt() - 1) / 2
    high = golden * 2**20 % 1
    part = F.pmod(F.floor(slot / F.lit(float(2**20))) * F.lit(float(high)), F.lit(1.0))
    return F.pmod(part + F.pmod(slot, F.lit(2**20)) * F.lit(float(golden)) + F.lit(0.5), F.lit(1.0))


def schedule(spark, targets: DataFrame, slots: int) -> DataFrame:
    """no, block: the slots of the schedule, ranked from 0 within each source (by its no)."""
    order = Window.orderBy("no")
    share = F.col("target") / F.sum("target").over(Window.partitionBy())
    upper = F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = targets.where("target > 0").select("no", (upper - share).alias("lo"), upper.alias("hi"), F.row_number().over(order).alias("n"), F.count("*").over(Window.partitionBy()).alias("of"))
    spans = spans.withColumn("hi", F.when(F.col("n") == F.col("of"), 1.1).otherwise(F.col("hi")))
    # the next source begins exactly where this one ends
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("n")), F.lit(0.0))).drop("of")
    cell = lambda c: F.least(F.floor(c * _CELLS), F.lit(_CELLS - 1))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    points = spark.range(slots).select("id", F.floor(F.col("id") / _CHUNK).alias("chunk"), _points(F.col("id")).alias("u"))
    drawn = points.withColumn("cell", cell(F.col("u"))).join(spans, "cell").where("u >= lo and u < hi").select("id", "chunk", "no")
    base = exclusive_offsets(drawn, ["no"], "chunk", F.lit(1), "base")
    within = F.row_number().over(Window.partitionBy("no", "chunk").orderBy("id")) - 1
    return drawn.withColumn("within", within).join(base, ["no", "chunk"]).select("no", (F.col("base") + F.col("within")).cast("bigint").alias("block"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, epochs: int = EPOCHS, seed: int = 17, block: int = BLOCK_TOKENS) -> DataFrame:
    """id, source, text_md5, copy, size, source_size, target, taken of every row.

    size counts words (a null text has none); taken is how many the mix takes, repeats counted,
    from 0 to epochs * size. Of equal rows (id, source and text) each is a document of its own,
    numbered by copy. Sources tie never: equal names are one source, and a row for each is ordered
    in one task. An empty table gives no rows; a document without words takes 0. The order of a
    source's documents is that of a seeded checksum, so that reruns agree.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.md5(text).alias("text_md5"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"))
    rows = rows.groupBy("id", "source", "text_md5").agg(F.first("size").alias("size"), F.count("*").alias("copies"))
    rows = staged(rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies"))
    spark = docs.sparkSession
    targets = staged(source_targets(rows, weights, epochs))
    total = int(targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])

    # buckets follow one another in the order of the checksum
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), "text_md5", F.col("copy").cast("string")))
    buckets = rows_or_one(rows, 2_000)
    rows = rows.withColumn("h", h).withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * buckets / float(2**32)))
    base = exclusive_offsets(rows, ["source"], "bucket", F.col("size"), "base")
    w = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    same = lambda a, b: a.eqNullSafe(b)
    keep = ["id", "source", "text_md5", "copy", "size"]
    rows = rows.alias("r").join(base.alias("b"), same(F.col("r.source"), F.col("b.source")) & (F.col("r.bucket") == F.col("b.bucket"))).select(*[f"r.{c}" for c in keep], (F.col("base") + F.col("before")).alias("start"))
    rows = staged(rows.alias("r").join(targets.alias("t"), same(F.col("r.source"), F.col("t.source"))).select(*[f"r.{c}" for c in keep], "start", "source_size", "target", "no"))

    # each document in each pass, cut at the block borders of its source's stream; its start names it there
    lap = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    pieces = rows.where("size > 0").select("no", "start", "size", "source_size", lap.alias("lap")).select("no", "start", "size", (F.col("start") + F.col("lap") * F.col("source_size")).alias("lo"))
    pieces = pieces.withColumn("hi", F.col("lo") + F.col("size"))
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    overlap = F.least(F.col("hi"), (F.col("block") + 1) * block) - F.greatest(F.col("lo"), F.col("block") * block)
    pieces = pieces.select("no", "block", "start", overlap.cast("int").alias("words"))
    slots = schedule(spark, targets, -(-total // block))
    taken = pieces.join(slots.hint("merge"), ["no", "block"], "left_semi").groupBy("no", "start").agg(F.sum("words").alias("taken"))
    named = rows.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).join(taken.withColumnRenamed("start", "at"), ["no", "at"], "left")
    return named.select(*keep, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The documents of the mix, in the columns of docs: a document that the mix takes k times
    and a part comes k times whole, and once as its first words (with the white space between).
    Documents of which nothing is taken don't come."""
    plan = mix(docs, id_col, text_col, source_col, **how).where("taken > 0")
    # the text travels once, in its row
    rows = docs.select(packed_row(docs), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"))
    rows = rows.dropDuplicates(["id", "source", "text_md5"]).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("p.id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.text_md5") == F.col("p.text_md5"))
    rows = rows.join(plan.alias("p"), same).select("row", F.col("row")[text_col].alias("text"), "size", "taken")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size"))))).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size")))
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn("cut", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(part))
    row = F.col("row").withField(f"`{text_col}`", F.col("cut"))
    if n_chars_col and n_chars_col in docs.columns:
        row = row.withField(f"`{n_chars_col}`", F.length("cut").cast(docs.schema[n_chars_col].dataType))
    return rows.select(row.alias("row")).select("row.*")
