"""Unions, gaps and overlaps of sets of byte ranges, by a sweep over their ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import dealt


def coverage(ranges: DataFrame, owner: list[str], start: str = "start", length: str = "length") -> DataFrame:
    """(owner, start, stop, times): maximal stretches that lie in equally many ranges, from the first range's start to the last one's end; gaps have times 0.

    Ends are summed up by place before owners' places are put in order, so equal ranges, however many, are two places.
    """
    ends = ranges.where((F.col(length) > 0) & F.col(start).isNotNull()).select(*owner, F.explode(F.array(F.struct(F.col(start).cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col(start) + F.col(length)).cast("long").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    places = ends.groupBy(*owner, "e.at").agg(F.sum("e.d").alias("d")).where("d != 0")
    w = Window.partitionBy(*owner).orderBy("at")
    return places.select(*owner, F.col("at").alias("start"), F.lead("at").over(w).alias("stop"), F.sum("d").over(w).alias("times")).where("stop IS NOT NULL")


def integrity_findings(ranges: DataFrame, sizes: DataFrame, owner: list[str]) -> DataFrame:
    """What is wrong with the byte ranges (owner, start, length) of files (owner, size): (owner, finding, start, stop).

    invalid: a negative start or a length below 1; beyond: bytes past the file's end; head, gap, tail: bytes that no range covers before, between and after
    the ranges; overlap: bytes in more than one. A file without (valid) ranges is one gap, "uncovered"; a file of no bytes lacks nothing. Ranges of files without a size aren't judged.

    Ranges are counted first and dealt by owner to tasks of bounded size; all that follows stays where they are.
    """
    ranges = dealt(ranges, owner, ranges.count() + sizes.count())
    valid = (F.col("start") >= 0) & (F.col("length") > 0)
    judged = ranges.join(sizes, owner).where("size IS NOT NULL")
    bad = judged.where(~F.coalesce(valid, F.lit(False))).select(*owner, F.lit("invalid").alias("finding"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("length")).cast("long").alias("stop"))
    covered = coverage(judged.where(valid), owner)
    inner = covered.where("times != 1").select(*owner, F.when(F.col("times") == 0, "gap").otherwise("overlap").alias("finding"), "start", "stop")
    # stretches of several overlapping ranges that touch are one overlap
    w = Window.partitionBy(*owner, "finding").orderBy("start")
    inner = inner.withColumn("_run", F.sum(F.when(F.lag("stop").over(w) == F.col("start"), 0).otherwise(1)).over(w))
    inner = inner.groupBy(*owner, "finding", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")
    edges = sizes.where("size IS NOT NULL").join(covered.groupBy(*owner).agg(F.min("start").alias("_first"), F.max("stop").alias("_last")), owner, "left")

    def finding(name: str, start: Column, stop: Column, when: Column) -> Column:
        return F.when(when & (start < stop), F.struct(F.lit(name).alias("finding"), start.cast("long").alias("start"), stop.cast("long").alias("stop")))

    first, last, size = F.col("_first"), F.col("_last"), F.col("size")
    some = first.isNotNull()
    outer = [finding("uncovered", F.lit(0), size, first.isNull()), finding("head", F.lit(0), F.least(first, size), some), finding("tail", last, size, some), finding("beyond", F.greatest(size, first), last, some)]
    edges = edges.select(*owner, F.explode(F.array_compact(F.array(*outer))).alias("f")).select(*owner, "f.*")
    return bad.unionByName(inner).unionByName(edges)


def meaningful_tail(text: Column, end: Column) -> Column:
    """Whether text from end (characters or bytes, from 0) on has a line that is neither blank nor a comment (%)."""
    rest = F.substring(text, end.cast("int") + 1, F.length(text))
    lines = F.split(rest.cast("string"), r"\r\n|\r|\n")
    return F.coalesce(F.exists(lines, lambda x: x.rlike(r"^[\s\x00]*[^\s%\x00]")), F.lit(False)) & (end < F.length(text))
