"""Ordered page algebra: pages are rows with a document and a page index from 0 without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumber(df: DataFrame, document: list[str], *order: str | Column) -> DataFrame:
    """Number the pages of each document from 0 in the given order."""
    w = Window.partitionBy(*document).orderBy(*order)
    return df.withColumn("page_index", (F.row_number().over(w) - 1).cast("long"))


def slice_pages(df: DataFrame, start: int, stop: int, step: int = 1, document: list[str] | None = None) -> DataFrame:
    """Pages start, start + step, ... before stop, with their indexes as they were. Negative bounds count from each document's end, for which document is needed."""
    i = F.col("page_index")
    if step <= 0:
        raise ValueError("step must be above 0")
    if start >= 0 and stop >= 0:
        return df.where((i >= start) & (i < stop) & (F.pmod(i - start, F.lit(step)) == 0))
    if document is None:
        raise ValueError("negative bounds need the columns that tell documents apart")
    n = F.col("_n")
    first, last = (F.lit(x) if x >= 0 else F.greatest(n + x, F.lit(0)) for x in (start, stop))
    counted = df.withColumn("_n", F.count("*").over(Window.partitionBy(*document)))
    return counted.where((i >= first) & (i < last) & (F.pmod(i - first, F.lit(step)) == 0)).drop("_n")


def page_at(df: DataFrame, index: int, document: list[str]) -> DataFrame:
    """The page at an index of each document, from its end if negative; documents that are too short have none."""
    if index >= 0:
        return df.where(F.col("page_index") == index)
    return slice_pages(df, index, index + 1, 1, document) if index < -1 else df.withColumn("_n", F.max("page_index").over(Window.partitionBy(*document))).where("page_index = _n").drop("_n")


def extract_range(df: DataFrame, document: list[str], first: int, last: int) -> DataFrame:
    """Pages first to last (from 1, inclusive), renumbered; documents that lack one of them have none."""
    if first < 1 or first > last:
        raise ValueError("bad range")
    sized = df.withColumn("_n", F.count("*").over(Window.partitionBy(*document)))
    return sized.where((F.col("_n") >= last) & F.col("page_index").between(first - 1, last - 1)).drop("_n").withColumn("page_index", F.col("page_index") - (first - 1))


def delete_at(df: DataFrame, document: list[str], index: int) -> DataFrame:
    """Without the page at an index (from the end if negative) of each document, renumbered; documents that are too short stay as they are."""
    at = page_at(df, index, document).select(*document, F.col("page_index").alias("_at"))
    kept = df.join(at, document, "left").where("_at IS NULL OR page_index != _at").drop("_at")
    return renumber(kept, document, "page_index")


def delete_pages(df: DataFrame, document: list[str], numbers: list[int]) -> DataFrame:
    """Without the pages of these numbers (from 1; others are ignored), renumbered."""
    return renumber(df.where(~(F.col("page_index") + 1).isin(*numbers)), document, "page_index")


def insert_pages(df: DataFrame, new: DataFrame, position: int, document: list[str], order: str | None = None) -> DataFrame:
    """Put the rows of new (pages without index; in order, if there are several for a document) at a position, which is clamped to 0 and the document's size."""
    size = df.groupBy(*document).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*document).orderBy(order or F.lit(0))
    at = F.greatest(F.lit(0), F.least(F.coalesce("_n", F.lit(0)), F.lit(position)))
    placed = new.join(size, document, "left").withColumn("page_index", (at + F.row_number().over(w) - 1).cast("long")).drop("_n")
    more = new.groupBy(*document).agg(F.count("*").alias("_more"))
    clamped = max(position, 0)  # behind a shorter document's end nothing moves
    moved = df.join(more, document, "left").withColumn("page_index", F.when(F.col("page_index") >= clamped, F.col("page_index") + F.coalesce("_more", F.lit(0))).otherwise(F.col("page_index")).cast("long")).drop("_more")
    return moved.unionByName(placed, allowMissingColumns=True)


def concatenate(parts: list[DataFrame], document: list[str]) -> DataFrame:
    """All pages of the first part, then of the next ones, for each document."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return renumber(out, document, "_part", "page_index").drop("_part")


def move_page(df: DataFrame, document: list[str], source: int, target: int) -> DataFrame:
    """Put page source (from 0) where target is; documents without such a page stay as they are."""
    i = F.col("page_index")
    key = F.when(i == source, F.lit(target) + (0.5 if target > source else -0.5)).otherwise(i.cast("double"))
    return renumber(df.withColumn("_key", key), document, "_key").drop("_key")


def append_blank(df: DataFrame, document: list[str]) -> DataFrame:
    """One page without content at each document's end."""
    blank = df.groupBy(*document).agg((F.max("page_index") + 1).alias("page_index"))
    return df.unionByName(blank, allowMissingColumns=True)
