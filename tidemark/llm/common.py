"""What the operators of this subpackage share: staging, sharing, words and row numbering."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stages import bucketed, kept, shared_dir, staged, stages_dropped  # noqa: F401

#: A word, in Java's and RE2's spelling: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, value) -> Broadcast:
    """value for all tasks, classes and functions of this package included: workers need no copy of it."""
    return spark.sparkContext.broadcast([cloudpickle.dumps(value)])


def unshared(given: Broadcast):
    """What shared was given; made once in each worker, whose tasks share it one after another."""
    held = given.value
    if len(held) == 1:
        held.append(pickle.loads(held[0]))
    return held[1]


def packed_row(docs: DataFrame) -> Column:
    """A row as one struct, so that no column of docs meets one of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def rows_or_one(df: DataFrame, per: int) -> int:
    """How many groups of about `per` rows df makes, at least one. Parquet counts from footers."""
    return max(1, -(-df.count() // per))


def exclusive_offsets(df: DataFrame, group: list[str], bucket: str, amount: Column, name: str) -> DataFrame:
    """For each (group, bucket): the sum of `amount` in the group's lower buckets.

    Only one row for each bucket is ordered, so a group with a third of all rows is never
    gathered in one task.
    """
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    return sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias(name))
