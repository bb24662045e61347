"""Sources and sinks, and the states of tables that merges lead to."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def align(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """df in the columns and types of schema: missing ones are null, others go. What can't be
    cast raises, or is null with strict=False."""
    have = set(df.columns)
    cast = lambda f: F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType.simpleString())
    return df.select(*[(cast(f) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def tick_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files at path/<date>/<market>.parquet: adds market (file stem) and day (folder)."""
    name = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).parquet(f"{path}/*/*.parquet")
    return rows.select("*", F.regexp_extract(name, r"([^/]+)\.parquet$", 1).alias("market"), F.to_date(F.regexp_extract(name, r"/([^/]+)/[^/]+\.parquet$", 1)).alias("day"))


def quoted(ticks: DataFrame, bid: str = "yes_bid", counters: tuple[str, ...] = ("volume", "open_interest")) -> DataFrame:
    """Ticks with a bid, null counters as 0."""
    return ticks.where(F.col(bid) > 0).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counters if c in ticks.columns})


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json_events(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def write_flat_csv(df: DataFrame, path: str, arrays: dict[str, int]) -> None:
    """CSV with each array column as name_0 .. name_{n-1}."""
    flat = [c for c in df.columns if c not in arrays]
    wide = [F.get(F.col(c), F.lit(k)).alias(f"{c}_{k}") for c, n in arrays.items() for k in range(n)]
    df.select(*flat, *wide).write.mode("overwrite").option("header", True).csv(path)


def append_aligned(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Appends to a Parquet table in its schema, NaN as null."""
    fixed = align(df, schema)
    floats = [f.name for f in schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    fixed.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}).write.mode("append").parquet(path)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _moved(spark: SparkSession, path: str, to: str) -> None:
    (a, fs), (b, _) = _folder(spark, path), _folder(spark, to)
    if not fs.rename(a, b):
        raise OSError(f"{path} could not be moved to {to}")


def _there(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, path)
    return fs.exists(at)


def recovered(spark: SparkSession, path: str) -> None:
    """Puts back a table whose swap was killed between its two moves."""
    if not _there(spark, path) and _there(spark, f"{path}__old"):
        _moved(spark, f"{path}__old", path)


def table_at(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The Parquet table at path; no rows if there is none yet."""
    recovered(spark, path)
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def swap_table(df: DataFrame, path: str, rows: int | None = None, least: int | None = None) -> int:
    """Puts df in place of the table at path and gives its number of rows, which is counted while it is
    written. It is written beside the table and moved in only if it has `rows` rows, or at least
    `least`; otherwise, or if the write fails, the old table stays. df may read the table itself."""
    spark = df.sparkSession
    recovered(spark, path)
    seen = Observation()
    try:
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}__new")
        n = seen.get["n"]
        if (rows is not None and n != rows) or (least is not None and n < least):
            raise ValueError(f"{n} rows were written, {rows if rows is not None else f'{least} or more'} were expected")
    except Exception:
        at, fs = _folder(spark, f"{path}__new")
        fs.delete(at, True)
        raise
    if _there(spark, path):
        _moved(spark, path, f"{path}__old")
    _moved(spark, f"{path}__new", path)
    at, fs = _folder(spark, f"{path}__old")
    fs.delete(at, True)
    spark.catalog.refreshByPath(path)
    return n


def write_groups(staging: DataFrame, path: str, group: list[str]) -> None:
    """Replaces the groups that staging holds in a table with a folder for each group; others stay. The
    new folders take the places of the old ones when the job ends, so a failed write changes nothing."""
    staging.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*group).parquet(path)


def patch_table(path: str, spark: SparkSession, fixes: DataFrame, on: list[str], columns: list[str], backup_path: str | None = None) -> dict[str, int]:
    """patch, swapped in: rows before and after, which must be equal, and how many changed, from one
    pass. With backup_path the rows that change are kept there first."""
    old = spark.read.parquet(path)
    if backup_path:
        keys = fixes.where(" or ".join(f"`{c}` is not null" for c in columns)).select(*on).distinct()
        old.join(keys, on, "left_semi").write.mode("errorifexists").parquet(backup_path)
    changed, same = Observation(), [F.col(f"_was.{c}").eqNullSafe(F.col(c)) for c in columns]
    # the old values go along, so that changes are counted while the table is written
    wide = patch(old.withColumn("_was", F.struct(*columns)), fixes, on, columns).observe(changed, F.count_if(~reduce(and_, same)).alias("n"))
    before = old.count()
    after = swap_table(wide.drop("_was"), path, rows=before)
    return {"before": before, "after": after, "changed": changed.get["n"]}


def backup(df: DataFrame, where, path: str) -> None:
    """The rows that are about to change, kept beside the table."""
    df.where(where).write.mode("errorifexists").parquet(path)


def replace_if_ahead(local: DataFrame, remote: DataFrame, path: str) -> bool:
    """Copies remote over path if it holds more rows than local."""
    ahead = remote.count() > local.count()
    if ahead:
        remote.write.mode("overwrite").parquet(path)
    return ahead


def newer_than(source: DataFrame, target: DataFrame, by: list[str], time: str) -> DataFrame:
    """Source rows later than the target's last per key (all, for keys it lacks)."""
    last = target.groupBy(*by).agg(F.max(time).alias("_last"))
    return source.join(last, by, "left").where(F.col("_last").isNull() | (F.col(time) > F.col("_last"))).drop("_last")


def insert_new(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """Insert or ignore: the target and the source rows whose key it lacks, one per key."""
    return target.unionByName(source.dropDuplicates(on).join(target, on, "left_anti").select(*target.columns))


def upsert(target: DataFrame, source: DataFrame, on: list[str], order: list[str] | None = None) -> DataFrame:
    """Insert or replace by key. Of several source rows of a key the last by `order` counts; without
    an order such a key fails when it runs."""
    if order:
        w = Window.partitionBy(*on).orderBy(*[F.desc(c) for c in order])
        one = source.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    else:
        twice = F.raise_error(F.lit("source keys are not unique")).cast("boolean")
        one = source.withColumn("_n", F.count("*").over(Window.partitionBy(*on))).where(F.when(F.col("_n") == 1, True).otherwise(twice))
    return target.join(one, on, "left_anti").select(*target.columns).unionByName(one.select(*target.columns))


def additive_merge(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """a and those rows of b whose key a lacks; columns that either lacks are null there."""
    return a.unionByName(b.join(a, on, "left_anti"), allowMissingColumns=True)


def replace_groups(old: DataFrame, staging: DataFrame, group: list[str]) -> DataFrame:
    """The staging rows, and the old ones of groups that staging doesn't hold."""
    return staging.unionByName(old.join(staging.select(*group).distinct(), group, "left_anti").select(*staging.columns))


def patch(old: DataFrame, fixes: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """old with columns replaced where fixes holds a value. Keys with two different values raise;
    the number of rows stays."""
    one = fixes.groupBy(*on).agg(*[F.max(c).alias(f"_new_{c}") for c in columns], *[F.count_distinct(c).alias(f"_n_{c}") for c in columns])
    checked = [F.when(F.col(f"_n_{c}") > 1, F.raise_error(F.lit(f"conflicting values of {c}")).cast(old.schema[c].dataType)).otherwise(F.coalesce(F.col(f"_new_{c}"), F.col(c))).alias(c) for c in columns]
    rows = old.join(one, on, "left")
    return rows.select(*[c if c not in columns else checked[columns.index(c)] for c in old.columns])


def dimension(parts: list[DataFrame], key: str, name: str) -> DataFrame:
    """One name for each key over several sources: the last source wins, of equals the largest
    name. Keys that are null or not positive go."""
    rows = None
    for rank, part in enumerate(parts):
        tagged = part.select(key, name, F.struct(F.lit(rank), F.col(name)).alias("_rank"))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return rows.where(F.col(key) > 0).groupBy(key).agg(F.max_by(name, "_rank").alias(name))


def write_json(df: DataFrame, path: str) -> None:
    """A table, such as a schedule, as JSON lines, in place of what was there."""
    df.write.mode("overwrite").json(path)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed dimension. A list of up to 10,000 rows is broadcast by joins; of a longer one Spark decides."""
    fixed = spark.createDataFrame(rows, schema)
    return F.broadcast(fixed) if len(rows) <= 10_000 else fixed


def home_away(rows: DataFrame, game: str, side: str, team: str) -> DataFrame:
    """game, home, away from two rows a game; a game without both sides goes."""
    name = lambda s: F.max(F.when(F.col(side) == s, F.col(team)))
    return rows.groupBy(game).agg(name("home").alias("home"), name("away").alias("away")).where("home is not null and away is not null")
