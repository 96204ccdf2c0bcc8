"""A budget for each owner over a stream: rows pass until it is spent, and are refused from then on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quillspark.session import ship

#: What a stream with state like this needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Budget(StatefulProcessor):
    def __init__(self, cost: str, order: str, cap: int, columns: list[str]) -> None:
        self.cost, self.order, self.cap, self.columns = cost, order, cap, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spent", "spent long, closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        spent, closed = self.state.get() if self.state.exists() else (0, False)
        rows = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # of one owner in one batch
        costs, taken, totals = rows[self.cost].fillna(0).astype("int64").tolist(), [], []
        for c in costs:
            closed = closed or spent + c > self.cap
            spent += 0 if closed else c
            taken.append(not closed)
            totals.append(spent)
        self.state.update((spent, closed))
        yield rows[self.columns].assign(spent=totals, within=taken)

    def close(self) -> None:
        pass


def within_budget(rows: DataFrame, owner: list[str], order: str, cost: str, cap: int) -> DataFrame:
    """rows with spent, what the owner's rows so far have cost, and within: whether the row is taken.

    An owner's rows are taken by batches, and by order within a batch, until one would go beyond the cap: that one and all later ones of the owner are refused (within is false), so a
    reader stops there. A cost of exactly what is left is taken; null costs nothing. The state of an owner is two numbers. rows is a stream; needs STATE_STORE.
    """
    ship(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField("spent", LongType()), StructField("within", BooleanType())])
    processor = _Budget(cost, order, cap, rows.columns)
    return rows.groupBy(*owner).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None")
