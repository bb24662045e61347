"""Batch scoring with any vectorized model, and permutation importance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score(df: DataFrame, features: list[str], model: Callable[[np.ndarray], np.ndarray], name: str = "score") -> DataFrame:
    """Adds model(matrix) of each Arrow batch; null features count as 0."""

    @F.pandas_udf("double")
    def predict(x: pd.DataFrame) -> pd.Series:
        return pd.Series(np.asarray(model(np.nan_to_num(x.to_numpy(np.float64))), np.float64))

    return df.withColumn(name, predict(F.struct(*[F.col(c).cast("double") for c in features])))


def permutation_importance(df: DataFrame, features: list[str], model, label: str, key: list[str], seed: int = 3, cells: int = 64) -> DataFrame:
    """feature, increase of the mean squared error when the feature's values are exchanged.

    Rows are dealt into cells by hash, and within a cell each row takes the value of the next
    row in hash order: a shuffle that no single task has to do for the whole table."""
    from pyspark.sql.window import Window

    h = F.xxhash64(*key, F.lit(seed))
    rows = df.withColumn("_h", h).withColumn("_cell", F.pmod("_h", F.lit(cells)))
    w = Window.partitionBy("_cell").orderBy("_h", *key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for f in features:
        rows = rows.withColumn(f"_x_{f}", F.coalesce(F.lead(f).over(w), F.first(f).over(whole)))
    rows = score(rows, features, model, "_base")
    for f in features:
        rows = score(rows, [f"_x_{c}" if c == f else c for c in features], model, f"_s_{f}")
    sq = lambda c: F.avg((F.col(c) - F.col(label)) * (F.col(c) - F.col(label)))
    one = rows.agg(sq("_base").alias("base"), *[sq(f"_s_{f}").alias(f) for f in features])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) - F.col("base")).alias("increase")) for f in features])).alias("r")).select("r.*")
