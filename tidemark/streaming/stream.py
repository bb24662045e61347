"""Streams: sources, windowed aggregates, and state machines on Spark's own keyed state."""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType

from .machines import Machine

#: A source's last row, which has a time only and ends the waiting of all before it.
CLOSING = "_closing"
#: Parts of a keyed stream's state, by hash of the key. A checkpoint holds for one number of them.
BUCKETS = 512
#: All NaNs are one key.
_NAN = "NaN"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A Parquet folder (or file) as a stream in its own schema. The source takes a single file by a
    pattern only: one that matches nothing else."""
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def sliced_stream(rows: DataFrame, time: str, slices: int = 4, files: int = 4, closing: int | None = None) -> DataFrame:
    """A table as a stream of `slices` batches in order of time (a number), for replays. The table is
    read once and dealt to slices; then each slice is written in `files` files after the one before,
    and a micro-batch takes one slice. With `closing` the stream has one row more, which is so much
    later than all others, has nothing but its time, and is marked in the column _closing."""
    spark = rows.sparkSession
    at = f"{scratch(spark)}/slices-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min(time), F.max(time)).first()
    width = max(1, -(-(high - low + 1) // slices)) if low is not None else 1
    if closing is not None:
        rows = rows.withColumn(CLOSING, F.lit(False))
    schema = rows.schema
    place = F.coalesce(F.floor((F.col(time) - F.lit(low or 0)) / width), F.lit(0)).cast("int")
    rows.withColumn("_slice", place).repartition(files * slices, "_slice", F.pmod(F.xxhash64(time), F.lit(files))).write.partitionBy("_slice").parquet(f"{at}/dealt")
    dealt = spark.read.schema(StructType([*schema.fields]).add("_slice", "integer")).parquet(f"{at}/dealt")
    parts = [dealt.where(F.col("_slice") == k).drop("_slice").repartition(files) for k in range(slices)]
    if closing is not None:
        last = F.lit((high or 0) + closing)
        row = spark.range(1).select(*[(last if f.name == time else F.lit(True) if f.name == CLOSING else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        parts.append(row)
    empty = spark.createDataFrame([], schema).coalesce(1)
    for k, part in enumerate(parts):
        part.write.parquet(f"{at}/in/{k}/rows")
        # a micro-batch takes so many files, so every slice has as many
        for j in range(files - len(spark.read.schema(schema).parquet(f"{at}/in/{k}/rows").inputFiles())):
            empty.write.parquet(f"{at}/in/{k}/none-{j}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{at}/in/*/*")


def scratch(spark: SparkSession) -> str:
    """This application's folder below that which driver and executors share, for what a stream
    leaves between batches. On a cluster without one it raises: a machine's own would lose rows."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/tidemark-{spark.sparkContext.applicationId}"


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, which Spark leaves out of states and windows."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, at: str | None = None) -> DataFrame:
    """What the stream has given once all that is there now has been taken. update mode: the last row of each
    key; complete mode: the last batch. The checkpoint and the output lie in the folder `at`: a later
    call with the same folder and stream goes on where the last one stopped or was killed, and
    gives the rows of both. Batches go to one folder each, so one that is run again replaces
    itself. Rows behind the watermark are left out with a warning that counts them."""
    spark = stream.sparkSession
    at = at or f"{scratch(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{at}/out/{n}")

    schema = stream.schema
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if late := late_rows(query):
        warnings.warn(f"{late} rows came behind the watermark and were left out", stacklevel=2)
    empty = spark.createDataFrame([], schema).withColumn("_batch", F.lit(0).cast("long"))
    try:
        rows = spark.read.schema(empty.schema).parquet(f"{at}/out/*")
    except Exception as e:  # no batch came
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty.drop("_batch")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_last")
    if mode == "update" and keys:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.names if c not in keys]), "_batch").alias("_row")).select(*keys, "_row.*").select(*schema.names)
        return rows
    return rows.drop("_batch")


def ingest(ticks: DataFrame, key: str, time: str, price: str, late: str = "10 minutes") -> DataFrame:
    """Quoted ticks, each (key, time) once within the watermark; which of equal ones stays is the one
    that came first, so only columns that equal ticks share are to be relied on."""
    return ticks.where(F.col(price) > 0).withWatermark(time, late).dropDuplicatesWithinWatermark([key, time])


def windowed(ticks: DataFrame, by: list[str], time: str, price: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum, least and greatest price per key and window, with a watermark for late rows."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    agg = ticks.withWatermark(time, late).groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum(price).alias("total"), F.min(price).alias("low"), F.max(price).alias("high"))
    return agg.select(*by, F.col("w.start").alias("start"), "n", "total", "low", "high")


def sessions(ticks: DataFrame, by: list[str], time: str, price: str, gap: str, late: str = "1 hour") -> DataFrame:
    """start, last, n, total of each run of ticks in which none is further than gap from the one before.
    A session is given once, when the watermark has passed its end; ticks that come later are left out and
    counted (late_rows)."""
    agg = ticks.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.max(time).alias("last"), F.count("*").alias("n"), F.sum(price).alias("total"))
    return agg.select(*by, F.col("w.start").alias("start"), "last", "n", "total")


def enriched_as_of(stream: DataFrame, versions: DataFrame, on: str, time: str, since: str, columns: list[str]) -> DataFrame:
    """Stream rows with the columns of their key's version at their time: the one with the latest
    `since` up to it (of equal ones the greatest), null where there is none. versions is a static table
    with a row for each version; a key's versions go as one sorted array, so a row meets its key once."""
    row = F.struct(F.col(since).alias("since"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    held = versions.where(F.col(since).isNotNull()).groupBy(F.col(on).alias("_of")).agg(F.array_sort(F.collect_list(row)).alias("_versions"))
    at = F.try_element_at(F.filter("_versions", lambda v: v["since"] <= F.col(time)), F.lit(-1))
    rows = stream.join(held, F.col(on) == F.col("_of"), "left").withColumn("_at", at)
    return rows.select(*stream.columns, *[F.col(f"_at.v{i}").alias(c) for i, c in enumerate(columns)])


def enriched(stream: DataFrame, static: DataFrame, on: list[str]) -> DataFrame:
    """Stream rows with the columns of a static table."""
    return stream.join(static, on, "left")


class _Stepper(StatefulProcessor):
    """Runs a machine for each key of a bucket. Rows wait in list state, those of a batch as one element;
    a timer at the earliest of them fires when the watermark has passed it, and all rows behind the
    watermark step in order of time. The machines' states are one value, so that a batch asks the
    state store a few times for a bucket, not for a key."""

    def __init__(self, machine: Machine, fields: list[str], floats: list[bool], order: int, out: list[str], ttl: int | None):
        self.machine, self.fields, self.floats, self.order, self.out, self.ttl = machine, fields, floats, order, Row(*out), ttl
        self.due_type, self.bytes_type = StructType.fromDDL("at long"), StructType.fromDDL("rows binary")  # here, as workers can't

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.bytes_type)
        self.due = handle.getValueState("due", self.due_type)
        self.held = handle.getValueState("held", self.bytes_type, self.ttl)

    def wait(self, rows: list[tuple]) -> None:
        """A timer at the earliest waiting row, in whole milliseconds not before it."""
        first, due = min(r[1] for r in rows), self.due.get()
        first = -(-first // 1000)
        if due is None or first < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(first)
            self.due.update((first,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came, pick = [], None
        for r in rows:
            pick = pick or itemgetter(*map(r.__fields__.index, (CLOSING, *self.fields)))
            closing, *row = pick(r)
            if not closing:
                row[0] = _NAN if row[0] != row[0] else row[0]
                came.append(tuple(row))
        if came:
            self.waiting.appendList([(pickle.dumps(came),)])
            self.wait(came)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A row is its key, its order and its values."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for part in self.waiting.get() for r in pickle.loads(part[0])]
        first = 1 + self.order
        ripe = sorted((r for r in rows if r[1] <= mark), key=lambda r: [(x is None, x) for x in r[1:first]])
        later = [r for r in rows if r[1] > mark]
        self.due.clear()
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        held, states = self.held.get(), {}
        for k, (changed, state) in (pickle.loads(held[0]) if held is not None else {}).items():
            if not self.ttl or changed + self.ttl > now:
                states[k] = changed, state
        for r in ripe:
            row = tuple(math.nan if x is None and f else x for x, f in zip(r[first:], self.floats))
            state = states[r[0]][1] if r[0] in states else self.machine.start()
            states[r[0]] = now, state
            for out in self.machine.step(state, row):
                yield self.out(*out)
        self.held.update((pickle.dumps(states),))
        if later:
            self.waiting.put([(pickle.dumps(later),)])
            self.wait(later)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, by: str, machine: Machine, columns: list[str], order: list[str], out: str, late: int, ttl: int | None = None) -> DataFrame:
    """A stream of what a machine per key gives. State, waiting rows and timers are Spark's: they lie
    in its state store, go to its checkpoint with every batch and come back from it. They lie there by
    bucket, of which there are BUCKETS by hash of the key: a bucket's keys share one timer and one read
    and write a batch. A task holds one bucket's states and waiting rows at a time.

    Rows step in event-time order (order[0], microseconds, then the rest of order) over all batches:
    each waits until the watermark, `late` microseconds behind the latest row of the stream (whole
    milliseconds), has passed it. One that comes later still is left out and counted (late_rows). Rows that wait when the
    stream ends stay in the state until more come; sliced_stream's closing row lets them go. With ttl a
    key's state goes if it isn't changed for so many milliseconds of processing time. Rows without
    a time have no place in this order and are left out."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [f"_o{i}" for i in range(len(order))], [f"_c{i}" for i in range(len(columns))]
    mark = F.coalesce(F.col(CLOSING), F.lit(False)) if CLOSING in stream.columns else F.lit(False)
    key = F.to_json(F.struct(by)) if isinstance(stream.schema[by].dataType, ArrayType | StructType) else F.col(by)
    rows = stream.where(F.col(order[0]).isNotNull()).select(
        F.pmod(F.xxhash64(by), F.lit(BUCKETS)).alias("_bucket"), key.alias("_key"), mark.alias(CLOSING), F.timestamp_micros(F.col(order[0])).alias("_at"), *[F.col(c).alias(n) for c, n in zip((*order, *columns), (*names[0], *names[1]))]
    )
    floats = [isinstance(rows.schema[n].dataType, DoubleType | FloatType) for n in names[1]]
    stepper = _Stepper(machine, ["_key", *names[0], *names[1]], floats, len(order), StructType.fromDDL(out).names, ttl)
    return rows.withWatermark("_at", f"{-(-late // 1000)} milliseconds").groupBy("_bucket").transformWithState(stepper, out, "Append", "EventTime")
