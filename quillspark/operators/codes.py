"""Code tables in layers: ranges of codes that tables inherit, override and look up, without a row for every code.

A range is cut into dyadic blocks (numbers that agree but for their last k bits), at most two for each k; a number lies in
one block of each size. So "which ranges hold this number" is an equi-join on (size, block), whatever the ranges' lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import durable


def _blocks(lo: str, hi: str, bits: int) -> Column:
    """The dyadic blocks (size, block) that make up lo to hi."""

    def of_size(k: Column) -> Column:
        one = F.lit(1).cast("bigint")
        unit = F.call_function("shiftleft", one, k)
        begin = F.call_function("shiftright", F.col(lo).cast("bigint") + unit - 1, k)
        end = F.call_function("shiftright", F.col(hi).cast("bigint") + 1, k)
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        left = F.when((begin < end) & odd(begin), F.struct(k.alias("size"), begin.alias("block")))
        right = F.when((begin < end) & odd(end), F.struct(k.alias("size"), (end - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), of_size))


def first_range(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, order: list[str], bits: int = 33) -> DataFrame:
    """For distinct (keys, point) of points the first range (lo to hi, numbers from 0 below 2**bits) with the same keys that holds the point, by order.

    Returns keys, point and hit, a struct of all other columns of ranges; points in no range have no row. Ranges whose hi is below lo hold nothing.
    """
    rest = [c for c in ranges.columns if c not in keys]
    blocks = ranges.where("lo <= hi").select(*keys, F.struct(*order, *[c for c in rest if c not in order]).alias("hit"), F.explode(_blocks("lo", "hi", bits)).alias("b"))
    blocks = blocks.groupBy(*keys, "b.size", "b.block").agg(F.min("hit").alias("hit"))
    sizes = [r["size"] for r in blocks.select("size").distinct().collect()]  # bits + 1 at most
    if not sizes:
        return points.select(*keys, point).distinct().join(blocks.select(*keys, "hit"), keys).where("false")
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.call_function("shiftright", F.col(point).cast("bigint"), F.lit(k)).alias("block")) for k in sorted(sizes)]))
    spread = points.where(F.col(point).isNotNull()).select(*keys, point).distinct().select(*keys, point, at.alias("b")).select(*keys, point, "b.*")
    return spread.join(blocks, [*keys, "size", "block"]).groupBy(*keys, point).agg(F.min("hit").alias("hit"))


def table_layers(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For tables (name, base) the chain of each: (name, layer, depth), depth 0 being the table itself; and the names whose chain never ends.

    Chains of pointers are doubled, so log2 of the longest chain rounds are needed. A base that isn't a table ends a chain, and has no layer.
    """
    known = tables.select(F.col("name").alias("base"))
    links = tables.where("base IS NOT NULL").join(known, "base", "left_semi").select("name", F.col("base").alias("layer"))
    layers = durable(tables.select("name", F.col("name").alias("layer"), F.lit(0).cast("long").alias("depth")))
    step, jump = 1, durable(links)  # jump: (name, layer) that many steps up
    limit = tables.count()
    while jump.limit(1).count() and step <= limit:
        reached = jump.join(layers.select(F.col("name").alias("layer"), F.col("layer").alias("_layer"), "depth"), "layer")
        layers = durable(layers.unionByName(reached.select("name", F.col("_layer").alias("layer"), (F.col("depth") + step).alias("depth"))))
        jump = durable(jump.join(jump.select(F.col("name").alias("layer"), F.col("layer").alias("_layer")), "layer").select("name", F.col("_layer").alias("layer")))
        step *= 2
    endless = jump.select("name").distinct() if jump.limit(1).count() else tables.select("name").where("false")
    return layers.join(endless, "name", "left_anti"), endless


def overlaid(tables: DataFrame, ranges: DataFrame) -> DataFrame:
    """The effective ranges of every table: ranges of the table itself cut holes into those that it inherits.

    tables (name, base); ranges (name, length, lo, hi, first, place): codes lo to hi of so many bytes mean first, first + 1 and so on; of
    ranges of one table that overlap, the one with the larger place holds. Returns name, length, lo, hi, first: disjoint, as long as
    they can be. Tables whose chain never ends have no rows (table_layers names them).

    A sweep over the ends of all ranges of a table's layers cuts the codes into stretches that lie in the same ranges; the range that holds a stretch
    is looked up at its beginning.
    """
    layers, _ = table_layers(tables)
    own = ranges.withColumnRenamed("name", "layer").where("lo <= hi")
    all_ = durable(layers.join(own, "layer").select("name", "length", "depth", (-F.col("place")).alias("back"), "lo", "hi", "first"))
    ends = all_.select("name", "length", F.explode(F.array("lo", F.col("hi") + 1)).alias("at")).distinct()
    w = Window.partitionBy("name", "length").orderBy("at")
    stretches = ends.withColumn("until", F.lead("at").over(w)).where("until IS NOT NULL")
    held = stretches.join(first_range(stretches, all_, ["name", "length"], "at", ["depth", "back"]), ["name", "length", "at"])
    held = held.select("name", "length", "at", "until", (F.col("hit.first") + F.col("at") - F.col("hit.lo")).alias("first"))
    # stretches that go on where the one before ends, in codes and in meanings, are one
    joins = (F.lag("until").over(w) == F.col("at")) & (F.lag(F.col("first") - F.col("at")).over(w) == F.col("first") - F.col("at"))
    runs = held.withColumn("_run", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    return runs.groupBy("name", "length", "_run").agg(F.min("at").alias("lo"), (F.max("until") - 1).alias("hi"), F.min_by("first", "at").alias("first")).drop("_run")


def decode_codes(codes: DataFrame, effective: DataFrame, collections: DataFrame, code_ranges: DataFrame, code_values: DataFrame) -> DataFrame:
    """Codes to text: codes (name, length, code, registry, ordering), distinct, by the effective ranges of their table.

    collections (name, registry, ordering) says which collection a table is for; other ones don't fit, and a code of a table that doesn't fit has no number.
    code_ranges (ordering, lo, hi, first) and code_values (ordering, number, text) give texts of numbers: ranges first (first is the code point of lo).
    Returns the codes with number and text, null where there is none.
    """
    fits = codes.join(collections, ["name", "registry", "ordering"], "left_semi")
    hits = first_range(fits, effective, ["name", "length"], "code", ["lo"])
    numbers = hits.select("name", "length", "code", (F.col("hit.first") + F.col("code") - F.col("hit.lo")).alias("number"))
    found = durable(fits.join(numbers, ["name", "length", "code"]))
    points = first_range(found, code_ranges, ["ordering"], "number", ["lo"]).select("ordering", "number", (F.col("hit.first") + F.col("number") - F.col("hit.lo")).alias("point"))
    texts = found.join(points, ["ordering", "number"], "left").join(code_values, ["ordering", "number"], "left")
    text = F.coalesce(code_point(F.col("point")), F.col("text"))
    return codes.join(texts.select("name", "length", "code", "registry", "ordering", "number", text.alias("text")), ["name", "length", "code", "registry", "ordering"], "left")


def code_point(c: Column) -> Column:
    """A code point as text; null for what is none (surrogates too)."""
    fine = c.between(0, 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32"))
