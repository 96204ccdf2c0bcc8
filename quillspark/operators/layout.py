"""Page layout: columns by recursive cuts, rows, reading order and aligned tables, for elements (page, id, x, y, font_size).

y grows upwards, so rows are read by falling y. page is one or several columns; ids tell a page's elements apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspark.operators.scan import ordered_scan
from quillspark.session import dealt, durable

# Too few elements for columns; least width of a gutter in font sizes and in units; share of the smaller height
# that bands have in common; least height of a band in font sizes; how often a page is cut; rows and cells of a table and how far cells may
# be off, in font sizes and in units; how far elements of a row may be apart, in font sizes and in units.
COLUMN_ELEMENTS, GUTTER_EM, GUTTER_LEAST, OVERLAP, SPAN_EM, CUTS = 4, 3.0, 18.0, 0.5, 0.5, 3
TABLE_ROWS, TABLE_CELLS, CELL_EM, CELL_LEAST = 2, 2, 0.6, 4.0
ROW_EM, ROW_LEAST, FONT = 0.35, 1.0, 10.0


def _font_sizes(elements: DataFrame, page: list[str], name: str) -> DataFrame:
    """(page, name): the median of the font sizes above 0."""
    return elements.where("font_size > 0").groupBy(*page).agg(F.percentile("font_size", 0.5).alias(name))


def cut_columns(elements: DataFrame, page: list[str], cuts: int = CUTS) -> DataFrame:
    """elements with band, the path of cuts (0: left, 1: right) of the column that each is in; bands in order are columns from left to right.

    All bands of all pages are cut once in each round: at the widest gap between neighbouring x (the leftmost of equal ones), if it is as wide as a
    gutter, both sides have two elements or more, and they stand side by side. Widths are relative to the page's median font size.

    Elements are kept, counted and dealt by page to tasks of bounded size; each round is kept too, since the next one reads it three times.
    """
    elements = durable(elements)
    n = elements.count()
    elements = dealt(elements, page, n)
    sized = elements.join(_font_sizes(elements, page, "_font"), page, "left").withColumn("_font", F.coalesce("_font", F.lit(FONT)))
    state = sized.withColumn("band", F.lit(""))
    by = [*page, "band"]
    for level in range(cuts):
        state = dealt(durable(state), page, n)
        w = Window.partitionBy(*by).orderBy("x")
        gaps = state.where(F.length("band") == level).withColumn("_before", F.lag("x").over(w))
        gap = F.struct((F.col("x") - F.col("_before")).alias("gap"), (-F.col("x")).alias("left"), ((F.col("x") + F.col("_before")) / 2).alias("at"))
        best = gaps.groupBy(*by).agg(F.max(F.when(F.col("_before").isNotNull(), gap)).alias("g"), F.count("*").alias("n"), F.first("_font").alias("f"))
        best = best.where((F.col("n") >= COLUMN_ELEMENTS) & (F.col("g.gap") > 0) & (F.col("g.gap") >= F.greatest(F.lit(GUTTER_LEAST), GUTTER_EM * F.col("f"))))
        cut = best.select(*by, F.col("g.at").alias("_at"), F.col("f"))
        right = F.col("x") >= F.col("_at")
        sides = state.join(cut, by).groupBy(*by, "_at", "f").agg(
            *[f(F.when(side, v)).alias(n) for n, f, side, v in (("ln", F.count, ~right, F.lit(1)), ("rn", F.count, right, F.lit(1)), ("l0", F.min, ~right, F.col("y")), ("l1", F.max, ~right, F.col("y")), ("r0", F.min, right, F.col("y")), ("r1", F.max, right, F.col("y")))]
        )
        shared, smaller = F.least("l1", "r1") - F.greatest("l0", "r0"), F.least(F.col("l1") - F.col("l0"), F.col("r1") - F.col("r0"))
        stands = (shared > 0) & (smaller >= SPAN_EM * F.col("f")) & (shared >= OVERLAP * smaller)
        taken = sides.where((F.col("ln") >= 2) & (F.col("rn") >= 2) & stands).select(*by, "_at")
        state = state.join(taken, by, "left").withColumn("band", F.when(F.col("_at").isNull(), F.col("band")).otherwise(F.concat("band", F.when(right, "1").otherwise("0")))).drop("_at")
    return state.drop("_font")


def number_rows(elements: DataFrame, group: list[str]) -> DataFrame:
    """elements with row_no, from 0: by falling y, an element belongs to a row if its y is near that of the row's first element.

    How near depends on the first element's font size (else the element's own, else 10).
    """

    def begin(e: tuple) -> tuple:
        return (e[0], e[1], 0), 0

    def step(state: tuple, e: tuple) -> tuple:
        y, font, row = state
        if abs(e[0] - y) <= max(ROW_LEAST, ROW_EM * (font or e[1] or FONT)):
            return state, row
        return (e[0], e[1], row + 1), row + 1

    return ordered_scan(elements, group, [F.desc("y"), "x", "id"], ["y", "font_size"], begin, step, "row_no", LongType())


def reading_order(elements: DataFrame, page: list[str]) -> DataFrame:
    """elements with band, row_no (within the band) and place, from 0, in the page: columns from left to right, each row by row."""
    rows = number_rows(cut_columns(elements, page), [*page, "band"])
    w = Window.partitionBy(*page).orderBy("band", "row_no", "x", F.desc("y"), "id")
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def table_segments(rows: DataFrame, page: list[str]) -> DataFrame:
    """Segments of consecutive rows: rows (page, row_no, xs: sorted x of its cells, font: its cells' median font size) to page, segment (from 0), kind, first, last, n_rows, n_cells.

    A table is a run of at least two rows that have as many cells as its first row, two or more, each near the first row's cell; how near depends
    on the first row's font size. A run is as long as it can be, and what isn't in a table is flow (n_cells: null).
    """

    def begin(r: tuple) -> tuple:
        return (r[0], r[1], r[2]), r[2]

    def step(state: tuple, r: tuple) -> tuple:
        xs, font, start = state
        near = max(CELL_LEAST, CELL_EM * (font or FONT))
        if len(xs) >= TABLE_CELLS and len(r[0]) == len(xs) and all(abs(a - b) <= near for a, b in zip(r[0], xs, strict=True)):
            return state, start
        return begin(r)

    runs = ordered_scan(rows, page, ["row_no"], ["xs", "font", "row_no"], begin, step, "_start", LongType())
    found = runs.groupBy(*page, "_start").agg(F.max("row_no").alias("_end"), F.count("*").alias("n_rows"), F.first(F.size("xs")).cast("long").alias("n_cells"))
    table = F.col("n_rows") >= TABLE_ROWS
    w = Window.partitionBy(*page).orderBy("_start")
    new = F.when(table | F.coalesce(F.lag(table).over(w), F.lit(True)), 1).otherwise(0)  # flow after flow goes on
    numbered = found.withColumn("kind", F.when(table, "table").otherwise("flow")).withColumn("_new", new).withColumn("segment", (F.sum("_new").over(w) - 1).cast("long"))
    return numbered.groupBy(*page, "segment").agg(
        F.first("kind").alias("kind"), F.min("_start").alias("first"), F.max("_end").alias("last"), F.sum("n_rows").alias("n_rows"), F.max(F.when(F.col("kind") == "table", F.col("n_cells"))).alias("n_cells")
    )


def rows_of(elements: DataFrame, group: list[str]) -> DataFrame:
    """(group, row_no, xs, font) of elements with row_no, for table_segments."""
    font: Column = F.percentile(F.when(F.col("font_size") > 0, F.col("font_size")), 0.5)
    return elements.groupBy(*group, "row_no").agg(F.array_sort(F.collect_list("x")).alias("xs"), font.alias("font"))  # of one row
