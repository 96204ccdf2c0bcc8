"""Greedy passes over ordered rows, for what depends on where the last group began rather than on the row before.

Spark shuffles rows by group and sorts them; a task then reads a group's rows in order, keeps only a small state, and yields a value
for each row. So memory doesn't grow with a group, and a group's rows are read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from quillspark.session import ship

#: A new group begins: state of its first row, and that row's value. A row goes on: the new state and the row's value.
Begin = Callable[[tuple], tuple[Any, Any]]
Step = Callable[[Any, tuple], tuple[Any, Any]]


def ordered_scan(df: DataFrame, group: list[str], order: list, inputs: list[str], begin: Begin, step: Step, name: str, kind: DataType) -> DataFrame:
    """df with a column name: the values that begin and step give for the rows of each group in order, from their inputs as tuples.

    Rows with equal order keys come in any order among themselves, so the order should end with a row's id.
    """
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(name, kind)])
    columns = df.columns
    arrow = to_arrow_type(kind)
    keys, given = [columns.index(c) for c in group], [columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            key_values = [batch.column(i).to_pylist() for i in keys]
            values = [batch.column(i).to_pylist() for i in given]
            for i in range(batch.num_rows):
                key, row = tuple(k[i] for k in key_values), tuple(v[i] for v in values)
                state, value = begin(row) if key != now else step(state, row)
                now = key
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*columns, name])

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)
