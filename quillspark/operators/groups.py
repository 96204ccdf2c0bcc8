"""Aggregates, content identity and ordered (layout-like) logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_ids(df: DataFrame, row_id: str, payload: str) -> DataFrame:
    """The smallest id of the rows with the same payload. Rows are grouped by digest and joined back, so a payload never travels."""
    digests = df.select(row_id, F.sha2(F.col(payload), 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min(row_id).alias("canonical_id"), F.count("*").alias("n_copies"))
    return digests.join(first, "digest")


def latest(df: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """The values of each key's last row."""
    last = F.max_by(F.struct(*value), F.struct(*order))
    return df.groupBy(key).agg(last.alias("_v")).select(key, *[F.col("_v")[v].alias(v) for v in value])


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean of each dimension of the vectors of a group: rows (group, dimension, mean)."""
    rows = df.select(group, F.posexplode(vector).alias("dimension", "_x"))
    return rows.groupBy(group, "dimension").agg(F.avg(F.col("_x").cast("double")).alias("mean"))


def weighted_mode(df: DataFrame, group: str, value: str, weight: Column) -> DataFrame:
    """The value with the largest sum of weights; of equal ones the smallest."""
    sums = df.groupBy(group, value).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(group).agg(F.max_by(F.col(value), F.struct(F.col("_w"), -F.col(value))).alias("mode"), F.max("_w").alias("weight"))


def box_means(df: DataFrame, x: str, y: str, value: str, factor: int) -> DataFrame:
    """Integer means, halves up, of factor by factor cells."""
    n, s = F.count("*"), F.sum(value)
    rows = df.groupBy(F.floor(F.col(x) / factor).alias("cell_x"), F.floor(F.col(y) / factor).alias("cell_y")).agg(n.alias("_n"), s.alias("_s"))
    return rows.select("cell_x", "cell_y", F.expr("(_s + _n div 2) div _n").alias("mean"))


def runs(df: DataFrame, group: list[str], order: list[str], same: str) -> DataFrame:
    """Maximal runs of rows in order with an equal value: first and last order key, length."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = df.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(w).cast("long"))
    return rows.groupBy(*group, "run_no").agg(F.first(same).alias(same), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def paragraphs(df: DataFrame, group: list[str], order: str, breaks: Column) -> DataFrame:
    """Number groups of consecutive rows; a row for which breaks holds (it may look at lag columns) begins a new one."""
    w = Window.partitionBy(*group).orderBy(order)
    flagged = df.withColumn("_b", F.when(F.row_number().over(w) == 1, 1).when(breaks, 1).otherwise(0))
    return flagged.withColumn("paragraph", F.sum("_b").over(w).cast("long")).drop("_b")


def head_relative_tiers(values: Column, ratio: float, most: int) -> Column:
    """Tiers of an array of sizes in falling order: a new tier begins where the tier's head is more than ratio times the value.

    Returns an array of (size, tier); tiers are at most `most`.
    """
    start = F.struct(F.lit(None).cast("double").alias("head"), F.lit(0).alias("tier"), F.array().cast("array<struct<size:double,tier:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["head"].isNull() | (acc["head"] > x * ratio)
        tier = F.when(new, F.least(acc["tier"] + 1, F.lit(most))).otherwise(acc["tier"])
        head = F.when(new, x).otherwise(acc["head"])
        return F.struct(head.alias("head"), tier.alias("tier"), F.concat(acc["out"], F.array(F.struct(x.alias("size"), tier.alias("tier")))).alias("out"))

    return F.aggregate(F.reverse(F.array_sort(F.array_distinct(values))), start, step)["out"]


def head_relative_rows(points: Column, tolerance: float) -> Column:
    """Rows of an array of (y, x, id) structs: sorted by falling y, a point belongs to a row if it is near the row's first point.

    Returns an array of (id, row_no), row_no from 1.
    """
    ordered = F.array_sort(points, lambda a, b: F.when(a["y"] > b["y"], -1).when(a["y"] < b["y"], 1).when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)))
    start = F.struct(F.lit(None).cast("double").alias("head"), F.lit(0).alias("row_no"), F.array().cast("array<struct<id:bigint,row_no:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        new = acc["head"].isNull() | (acc["head"] - p["y"] > tolerance)
        row_no = F.when(new, acc["row_no"] + 1).otherwise(acc["row_no"])
        return F.struct(
            F.when(new, p["y"]).otherwise(acc["head"]).alias("head"),
            row_no.alias("row_no"),
            F.concat(acc["out"], F.array(F.struct(p["id"].cast("bigint").alias("id"), row_no.alias("row_no")))).alias("out"),
        )

    return F.aggregate(ordered, start, step)["out"]


def exact_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median of each group. Rows are counted by value first, so what meets in a group is its distinct values, not its rows; nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("_n").over(Window.partitionBy(group))
    at = counts.withColumns({"_upto": upto, "_total": total})
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)  # of an odd number the same
    holds = lambda place: F.when((F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place), F.col(value))
    return at.groupBy(group).agg(((F.max(holds(low)) + F.max(holds(high))) / 2).alias("median"))


def columns_by_gap(df: DataFrame, group: list[str], x: str, tie: str, gap: float) -> DataFrame:
    """Number the columns of a page from 0: a new one begins where the next x is at least gap further on."""
    w = Window.partitionBy(*group).orderBy(x, tie)
    new = F.when(F.col(x) - F.lag(x).over(w) >= gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("column", F.sum("_new").over(w).cast("long")).drop("_new")


def table_runs(rows: DataFrame, group: list[str], order: str, cells: str, least_rows: int = 2, least_cells: int = 2) -> DataFrame:
    """Runs of consecutive rows with as many cells, at least so many rows and cells: (group, first, last, n_rows, n_cells)."""
    found = runs(rows, group, [order], cells).where((F.col("n") >= least_rows) & (F.col(cells) >= least_cells))
    return found.select(*group, "first", "last", F.col("n").alias("n_rows"), F.col(cells).alias("n_cells"))
