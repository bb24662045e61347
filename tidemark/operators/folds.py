"""Folds over a key's sorted rows, for steps that no window can take."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, FloatType, StructType


class Machine(NamedTuple):
    """A state machine of a key. step(state, row) changes the state and gives output rows. state is a
    dict, which start makes: scalars that are kept together (`values`, a DDL), lists of tuples
    (`lists`: name -> DDL) and maps (`maps`: name -> DDL of key and of value)."""

    step: Callable[[dict, tuple], list[tuple]]
    start: Callable[[], dict]
    values: str = ""
    lists: dict[str, str] = {}
    maps: dict[str, tuple[str, str]] = {}


def same(a: tuple, b: tuple) -> bool:
    """Whether two keys are one group to Spark: nulls are equal, and so are NaNs."""
    return a == b or all(x == y or (x != x and y != y) for x, y in zip(a, b))


def with_fold(df: DataFrame, by: list[str], order: list[str], takes: list[str], start: Callable[[], object], step: Callable[..., tuple], name: str, kind: str) -> DataFrame:
    """Adds what step(state, *takes) -> (state, value) gives at each row of its key, by order.
    Spark sorts (and spills); rows pass in Arrow batches as they are, and only the key and its
    state, which step keeps small, are held. A key's rows meet in one task, as the fold is sequential."""
    added = StructType.fromDDL(f"_v {kind}")[0].dataType
    schema = StructType([*df.schema.fields]).add(name, added)
    dealt = (df.repartition(*by) if by else df.repartition(1)).sortWithinPartitions(*by, *order)
    at = [[df.columns.index(c) for c in names] for names in (by, takes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_type(added)
        key = state = None
        for batch in batches:
            keys, values = (list(zip(*(batch.column(i).to_pylist() for i in cols))) or [()] * batch.num_rows for cols in at)
            out = []
            for now, row in zip(keys, values):
                if key is None or not same(key, now):
                    key, state = now, start()
                state, value = step(state, *row)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    return dealt.mapInArrow(run, schema)


def unfolded(df: DataFrame, by: list[str], order: list[str], takes: list[str], machine: Machine, out: str) -> DataFrame:
    """by and the rows that machine gives, none to many for each row of df, by order in each key. As
    with_fold: Spark sorts, only a key's state is held, and a key is one task."""
    given = StructType.fromDDL(out)
    rows = df.select(*by, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_t{i}") for i, c in enumerate(takes)])
    schema = StructType([*[rows.schema[c] for c in by], *given.fields])
    orders = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))]
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *orders)
    floats = [isinstance(df.schema[c].dataType, DoubleType | FloatType) for c in takes]
    n, first = len(by), len(by) + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in schema]
        key = state = None
        for batch in batches:
            columns = [x.to_pylist() for x in batch.columns]
            rows = []
            for values in zip(*columns):
                now = values[:n]
                if key is None or not same(key, now):
                    key, state = now, machine.start()
                row = tuple(math.nan if x is None and f else x for x, f in zip(values[first:], floats))
                rows += [(*now, *r) for r in machine.step(state, row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

    return dealt.mapInArrow(run, schema)
