"""Connected components of large edge sets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import at_most, durable

#: Vertices that a task joins at once.
AT_ONCE = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for every vertex of the edges (a, b) the smallest vertex that it is connected with.

    Each task first joins what its own edges connect and hangs it on the smallest vertex there. Where tasks disagree, large-star and
    small-star steps in turn hang a vertex's neighbours on the smallest of them, and tasks join again what they
    see. In a round each vertex's smallest neighbour falls somewhere, or all are stars; then no round follows. As soon as all edges that are
    left have at most AT_ONCE vertices, one task joins them and no round follows either; more are never gathered. Every round is cut with a checkpoint.

    edges are read once, and before this returns. Few vertices are marked for broadcast.
    """
    edges = durable(_joined(edges))
    while not (few := at_most(edges, AT_ONCE // 2)) and not _settled(edges):
        edges = durable(_joined(_small_star(_large_star(edges))))
    if few:
        edges = durable(_joined(edges.coalesce(1)))
    children = edges.select(F.col("a").alias("id"), F.col("b").alias("root")).distinct()
    roots = edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("root"))
    found = children.unionAll(roots)
    return F.broadcast(found) if few else found


def _joined(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, with the same components: of what a task's edges connect, each vertex and the smallest. A task holds AT_ONCE vertices, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in list(up) if (r := root(x)) != x]
            up.clear()
            c = list(zip(*found, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["a", "b"])

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > AT_ONCE:
                yield stars()
        yield stars()

    return edges.select("a", "b").where("a != b").mapInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (a > b) are stars: no vertex hangs on two, none that others hang on hangs on another."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("up")), F.struct(F.col("b").alias("id"), F.lit(None).cast("long").alias("up"))))
    seen = edges.select(ends.alias("end")).groupBy("end.id").agg(F.min("end.up").alias("low"), F.max("end.up").alias("high"), F.count_if(F.col("end.up").isNull()).alias("below"))
    return not seen.agg(F.count_if((F.col("low") != F.col("high")) | (F.col("low").isNotNull() & (F.col("below") > 0)))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours hang on the smallest of it and its neighbours. Edges have a > b."""
    least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours hang on the smallest of these. Edges have a > b; a vertex has no more of them than tasks (or fillings of tasks) have joined it."""
    least = edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return least.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
