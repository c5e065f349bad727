"""Registering user functions: scalar (Arrow batches), aggregate, aggregate in mergeable parts, table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import tasks_for

#: Rows that one task gathers before it folds them into states.
FOLD_ROWS = 200_000


class Functions:
    """A provider of user functions, by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def scalar(self, name: str, fn: Callable, returns: str):
        """fn works on pandas Series."""
        made = F.pandas_udf(fn, returns)
        self.spark.udf.register(name, made)
        self.names.append(name)
        return made

    def aggregate(self, name: str, fn: Callable, returns: str):
        """fn takes pandas Series (annotated) and returns one value; also usable over windows. A group is one task's; for large
        groups, or very many, see MergeableAggregate."""
        made = F.pandas_udf(fn, returns)
        self.spark.udf.register(name, made)
        self.names.append(name)
        return made

    def table(self, name: str, cls: type, returns: str):
        made = F.udtf(cls, returnType=returns)
        self.spark.udtf.register(name, made)
        self.names.append(name)
        return made

    def can_handle(self, name: str) -> bool:
        return name in self.names


class MergeableAggregate:
    """A user aggregate in parts, each for many groups at once: no task sees a whole group, and no call is made per group.

    update takes the values grouped (pandas SeriesGroupBy) and returns their states, a row per group; merge takes states grouped
    (DataFrameGroupBy) and returns states; finish takes states and returns a Series of results. state is their schema.
    """

    def __init__(self, state: str, update: Callable, merge: Callable, finish: Callable, returns: str):
        self.state, self.update, self.merge, self.finish, self.returns = state, update, merge, finish, returns

    def by(self, df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        """keys and the result: states within each task, merged by hash of the keys, of about a million rows a task at most."""
        n, most, update, merge, finish = len(keys), FOLD_ROWS, self.update, self.merge, self.finish
        rows = df.select(*keys, value)
        key_fields = rows.select(*keys).schema
        states = rows.sparkSession.createDataFrame([], self.state).schema
        results = rows.sparkSession.createDataFrame([], f"{name} {self.returns}").schema
        full, last = _schema(key_fields, states), _schema(key_fields, results)
        state_types, result_type = _arrow(states), _arrow(results)

        def folded(table: pa.Table, raw: bool) -> pa.Table:
            first, group = _groups(table, n)
            one = table.column(n).to_pandas() if raw else table.select(range(n, table.num_columns)).to_pandas()
            made = (update if raw else merge)(one.groupby(group))
            values = [pa.array(made[f.name], f.type, from_pandas=True) for f in state_types]
            return pa.table([*table.select(range(n)).take(first).columns, *values], names=[*table.column_names[:n], *state_types.names])

        def fold(batches: Iterator[pa.RecordBatch], raw: bool) -> Iterator[pa.Table]:
            """Tables of states, one row per group but where a task has more than FOLD_ROWS groups."""
            held, fresh = None, []
            for batch in batches:
                fresh.append(batch)
                if sum(b.num_rows for b in fresh) >= most:
                    held, fresh = joined(held, folded(pa.Table.from_batches(fresh), raw)), []
                    if raw and held.num_rows > most:
                        yield held
                        held = None
            if fresh:
                held = joined(held, folded(pa.Table.from_batches(fresh), raw))
            if held is not None:
                yield held

        def joined(held: pa.Table | None, new: pa.Table) -> pa.Table:
            return new if held is None else folded(pa.concat_tables([held, new]), False)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in fold(batches, True):
                yield from table.to_batches(max_chunksize=10_000)

        def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in fold(batches, False):
                result = pa.array(finish(table.select(range(n, table.num_columns)).to_pandas()), result_type.field(0).type, from_pandas=True)
                yield from pa.table([*table.select(range(n)).columns, result], names=[*table.column_names[:n], name]).to_batches(max_chunksize=10_000)

        return rows.mapInArrow(partial, full).repartition(tasks_for(rows), *keys).mapInArrow(final, last)

    def over(self, df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
        """df and the result of each row's group, as over an unordered window; NULL keys are a group."""
        made = self.by(df, keys, value, name).withColumnsRenamed({k: f"__{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & df[k].eqNullSafe(made[f"__{k}"])
        return df.join(made, same).drop(*[f"__{k}" for k in keys])


def _groups(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal values in the first n columns, and every row's group; NULL equals NULL."""
    code = np.zeros(table.num_rows, np.int64)
    for i in range(n):
        encoded = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
        encoded = encoded.combine_chunks() if isinstance(encoded, pa.ChunkedArray) else encoded
        code = np.unique(code * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
    return np.unique(code, return_index=True)[1], code


def _schema(*parts):
    from pyspark.sql.types import StructType

    return StructType([f for part in parts for f in part.fields])


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class TypeProvider:
    """A type of the caller's: values are seen as `kind` and kept as `stored`; pack and unpack work on one value.

    They run in Arrow batches. NULL stays NULL.
    """

    def __init__(self, name: str, stored: str, kind: str, pack: Callable, unpack: Callable):
        self.name, self.stored, self.kind, self.pack, self.unpack = name, stored, kind, pack, unpack

    def store(self, value: Column) -> Column:
        return F.udf(lambda x: None if x is None else self.pack(x), self.stored, useArrow=True)(value)

    def load(self, value: Column) -> Column:
        return F.udf(lambda x: None if x is None else self.unpack(x), self.kind, useArrow=True)(value)
