"""Logical text runs of pieces that are shown on pages, and what marked content makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.operators.scan import ordered_scan

# Fixed values, in font sizes: how far baselines may be apart, least and most gap within a run, gap that stands for a space.
BASELINE, LEAST_GAP, MOST_GAP, SPACE_GAP = 0.05, -0.10, 1.0, 0.18
#: Operators that begin marked content or mark a point.
MARKS = ("BDC", "BMC", "DP", "MP")


def logical_runs(shows: DataFrame, page: list[str], order: str) -> DataFrame:
    """Pieces joined to runs of text: shows (page, order, x, y, width, size, vertical, text) to page, run (from 0), first, last (order keys), text, n_pieces and width.

    A piece goes on with the run if it stands on the same baseline as the piece before and begins about where that one ends; a wide gap adds a space. Vertical pieces, and pieces after
    one of unknown width (null) or with a size of 0 or less, begin a run of their own.
    """
    w = Window.partitionBy(*page).orderBy(order)
    before = {c: F.lag(c).over(w) for c in ("x", "y", "width")}
    gap, size = F.col("x") - before["x"] - before["width"], F.col("size")
    near = (F.abs(F.col("y") - before["y"]) <= BASELINE * size) & gap.between(LEAST_GAP * size, MOST_GAP * size) & (size > 0) & ~F.coalesce("vertical", F.lit(False)) & ~F.coalesce(F.lag("vertical").over(w), F.lit(False))
    joins = F.coalesce(near, F.lit(False))
    cut = shows.withColumns({"_joins": joins, "_space": F.when(joins & (gap >= SPACE_GAP * size), " ").otherwise("")})
    numbered = cut.withColumn("run", (F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w) - 1).cast("long"))
    pieces = F.array_sort(F.collect_list(F.struct(order, F.concat("_space", F.coalesce("text", F.lit(""))).alias("t"))))["t"]  # of one run
    width = F.max_by(F.col("x") + F.col("width"), F.col(order)) - F.min_by("x", order)
    return numbered.groupBy(*page, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(pieces, "").alias("text"), F.count("*").alias("n_pieces"), width.alias("width"))


def marked_text(tokens: DataFrame, page: list[str], order: str) -> DataFrame:
    """The text that each token adds: tokens (page, order, op, text, actual, hidden) with shown; null where nothing is.

    op is BMC or BDC (marked content begins; actual: a text that stands for all that is shown inside, hidden: whether it belongs to a hidden layer), EMC (it ends) or anything else, which
    shows text. Of nested replacements the outermost counts, and stands where its content ends; hidden layers hide all that is inside, but not the replacement of what they are
    inside of or begin. An EMC without a beginning does nothing; a page ends all that is open.
    """

    def see(state: tuple, t: tuple) -> tuple:
        stack, hidden = state  # texts that stand for content that is open; how many levels are open since a hidden layer began
        op, text, actual, hides = t
        if op in ("BMC", "BDC"):
            hidden = hidden + 1 if hidden else int(op == "BDC" and bool(hides))
            return (((*stack, actual if op == "BDC" else None)), hidden), None
        if op == "EMC":
            hidden -= bool(hidden)
            if not stack:
                return (stack, hidden), None
            *rest, last = stack
            return (tuple(rest), hidden), last if all(x is None for x in rest) else None
        return state, text if not hidden and all(x is None for x in stack) else None

    return ordered_scan(tokens, page, [order], ["op", "text", "actual", "hidden"], lambda t: see(((), 0), t), see, "shown", StringType())


def has_marks(op: Column) -> Column:
    """Aggregate: whether any operator of a page begins marked content or marks a point."""
    return F.coalesce(F.bool_or(op.isin(*MARKS)), F.lit(False))
