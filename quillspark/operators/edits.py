"""Ordered lists that a log of edits changes: inserts, deletes and moves at positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _replayed(base: DataFrame, log: DataFrame, document: list[str]) -> DataFrame:
    """(document, out: items and refused): every document's list after all its edits, a fold in the document's row."""
    kind = base.schema["item"].dataType.simpleString()
    lists = base.groupBy(*document).agg(F.array_sort(F.collect_list(F.struct("position", "item")))["item"].alias("_items"))
    steps = log.groupBy(*document).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "at", "to", F.col("item").cast(kind).alias("item")))).alias("_steps"))
    start = F.struct(F.coalesce("_items", F.array().cast(f"array<{kind}>")).alias("items"), F.array().cast("array<bigint>").alias("refused"))

    def without(items: Column, at: Column) -> Column:
        return F.concat(F.slice(items, F.lit(1), at), F.slice(items, at + 2, F.size(items)))

    def put(items: Column, at: Column, item: Column) -> Column:
        return F.concat(F.slice(items, F.lit(1), at), F.array(item), F.slice(items, at + 1, F.size(items)))

    def step(state: Column, e: Column) -> Column:
        items, at, to = state["items"], e["at"].cast("int"), e["to"].cast("int")
        n = F.size(items)
        there = at.isNotNull() & (at >= 0) & (at < n)
        clamped = F.greatest(F.lit(0), F.least(n, at))
        new = (
            F.when((e["op"] == "insert") & at.isNotNull(), put(items, clamped, e["item"]))
            .when((e["op"] == "delete") & there, without(items, at))
            .when((e["op"] == "move") & there & to.between(0, n - 1), put(without(items, at), to, F.get(items, at)))
            .when(e["op"] == "clear", F.slice(items, 1, 0))
        )
        refused = F.when(new.isNull(), F.concat(state["refused"], F.array(e["seq"].cast("bigint")))).otherwise(state["refused"])
        return F.struct(F.coalesce(new, items).alias("items"), refused.alias("refused"))

    both = lists.join(steps, document, "full")
    return both.select(*document, F.aggregate(F.coalesce("_steps", F.array()), start, step).alias("out"))


def replay(base: DataFrame, log: DataFrame, document: list[str]) -> DataFrame:
    """(document, position, item) after the edits: base (document, position, item), log (document, seq, op, at, to, item).

    Edits go in the order of seq, which is distinct in a document. insert puts item at a position, clamped to the list; delete takes the one at a position out; move takes the one at
    `at` out and puts it at `to` of what is left; clear empties. Positions count from 0. An edit at a position that isn't there, or of another kind, changes nothing (refused_edits).
    A document's list and log meet in one row: for lists of thousands, not millions, of items.
    """
    out = _replayed(base, log, document)
    return out.select(*document, F.posexplode("out.items").alias("position", "item")).withColumn("position", F.col("position").cast("long"))


def refused_edits(base: DataFrame, log: DataFrame, document: list[str]) -> DataFrame:
    """(document, seq): the edits that changed nothing because their position wasn't there or their kind isn't known."""
    return _replayed(base, log, document).select(*document, F.explode("out.refused").alias("seq"))
