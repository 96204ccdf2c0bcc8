"""Named parts of files as rows: attachments, layers, form fields, fonts and numbered objects, and samples of pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def register_objects(df: DataFrame, group: list[str], order: list[str], first: int, name: str = "object_id") -> DataFrame:
    """df with a number for each row of a group, first, first + 1 and so on, in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, (F.lit(first - 1) + F.row_number().over(w)).cast("long"))


def bounding_boxes(points: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """The smallest box about each group's points: (group, x0, y0, x1, y1). Nulls and points that aren't numbers are left out."""
    fine = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    return fine.groupBy(*group).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def widest_gaps(points: DataFrame, group: list[str], x: str, least: float) -> DataFrame:
    """The widest gap between neighbouring x of each group, if it is at least so wide: (group, gap, cut: where it begins; of equal ones the last)."""
    w = Window.partitionBy(*group).orderBy(x)
    gaps = points.select(*group, F.col(x).alias("_x"), (F.lead(x).over(w) - F.col(x)).alias("_gap")).where("_gap IS NOT NULL")
    return gaps.groupBy(*group).agg(F.max("_gap").alias("gap"), F.max_by("_x", F.struct("_gap", "_x")).alias("cut")).where(F.col("gap") >= least)


# Attachments: names with a payload, put and removed ----------------------------------------------------------------------


def _history(base: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Both as rows (keys, seq, op, content); base rows come first."""
    content = [c for c in base.columns if c not in keys]
    start = base.select(*keys, F.lit(None).cast("long").alias("seq"), F.lit("put").alias("op"), F.struct(*content).alias("content"))
    steps = log.select(*keys, F.col("seq").cast("long").alias("seq"), "op", F.struct(*[F.col(c).cast(base.schema[c].dataType).alias(c) for c in content]).alias("content"))
    return start.unionByName(steps.where(F.col("op").isin("put", "remove")))


def keyed_replay(base: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """base (keys, content columns) after log (keys, seq, op: put or remove, content columns): of each key only the last operation matters, so none is replayed."""
    last = _history(base, log, keys).groupBy(*keys).agg(F.max_by(F.struct("op", "content"), F.coalesce("seq", F.lit(-(1 << 62)))).alias("_l"))
    return last.where("_l.op = 'put'").select(*keys, "_l.content.*")


def removals(base: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, removed): whether each remove of a log found something under its key."""
    w = Window.partitionBy(*keys).orderBy(F.col("seq").asc_nulls_first())
    before = _history(base, log, keys).withColumn("_before", F.lag("op").over(w))
    return before.where("op = 'remove'").select(*keys, "seq", F.coalesce(F.col("_before") == "put", F.lit(False)).alias("removed"))


# Layers ---------------------------------------------------------------------------------------------------------------


def layer_states(layers: DataFrame, toggles: DataFrame, keys: list[str]) -> DataFrame:
    """layers (keys, visible) as toggles (keys, seq, visible) leave them: the last toggle of a layer counts; a state that nothing says is visible."""
    last = toggles.groupBy(*keys).agg(F.max_by("visible", "seq").alias("_last"))
    return layers.join(last, keys, "left").withColumn("visible", F.coalesce("_last", "visible", F.lit(True))).drop("_last")


def visible_content(content: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """content without what belongs to a hidden layer; without a layer, or on one that isn't known, it is visible."""
    return content.join(layers.where("NOT visible").select(*keys), keys, "left_anti")


# Form fields and annotations ----------------------------------------------------------------------------------------------


def set_field_values(fields: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """fields (keys, kind, value, options: array of texts, flags) after changes (keys, seq, value), with refused, how many changes were.

    The last change that a field's kind allows counts. Tx takes any text; Ch one of its options, any text if it is editable (bit 18 of flags, from 0); Btn one of its
    options or Off; Sig none, and read-only fields (bit 0) none. Null empties a field of any kind but Btn, which becomes Off.
    """
    asked = changes.withColumnsRenamed({"value": "_new"}).join(fields.select(*keys, "kind", "options", "flags"), keys)
    flags = F.coalesce("flags", F.lit(0))
    chosen = F.coalesce(F.array_contains("options", F.col("_new")), F.lit(False))
    fits = F.when(F.col("kind") == "Tx", True).when(F.col("kind") == "Ch", F.col("_new").isNull() | chosen | (flags.bitwiseAND(F.lit(1 << 18)) != 0)).when(F.col("kind") == "Btn", F.col("_new").isNull() | chosen | (F.col("_new") == "Off"))
    fine = F.coalesce(fits & (flags.bitwiseAND(F.lit(1)) == 0), F.lit(False))
    value = F.when((F.col("kind") == "Btn") & F.col("_new").isNull(), "Off").otherwise(F.col("_new"))
    judged = asked.withColumns({"_fine": fine, "_new": value})
    last = judged.groupBy(*keys).agg(F.max_by(F.when(F.col("_fine"), F.struct("_new")), F.when(F.col("_fine"), F.col("seq"))).alias("_l"), F.count_if(~F.col("_fine")).alias("_refused"))
    out = fields.join(last, keys, "left")
    return out.withColumns({"value": F.when(F.col("_l").isNotNull(), F.col("_l._new")).otherwise(F.col("value")), "refused": F.coalesce("_refused", F.lit(0))}).drop("_l", "_refused")


def unsigned_content(fields: DataFrame, annotations: DataFrame, pages: DataFrame, document: list[str]) -> DataFrame:
    """What of each document isn't signed: (document, part, id). part is field, annotation or page.

    A field or annotation (document, id, is_signed, signed) is unsigned unless is_signed says so, or, where that is null, signed; all pages (document, id) are reported.
    """
    unsigned = ~F.coalesce("is_signed", "signed", F.lit(False))
    parts = [df.where(unsigned).select(*document, F.lit(part).alias("part"), F.col("id").cast("string").alias("id")) for part, df in (("field", fields), ("annotation", annotations))]
    return parts[0].unionByName(parts[1]).unionByName(pages.select(*document, F.lit("page").alias("part"), F.col("id").cast("string").alias("id")))


def distinct_fonts(fonts: DataFrame, priority: str, tie: str) -> DataFrame:
    """Of fonts with one name (whatever its case), type and face the one of the highest priority, of equal ones the one with the smallest tie."""
    key = [F.lower("name"), F.col("type"), F.coalesce("face", F.lit(0))]
    w = Window.partitionBy(*key).orderBy(F.desc(priority), tie)
    return fonts.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


# Pictures ------------------------------------------------------------------------------------------------------------


def _byte(data: Column, at: Column) -> Column:
    """A byte of binary data, from 0; 0 beyond its end."""
    return F.coalesce(F.conv(F.hex(F.substring(data, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))


def samples(data: Column, bits: Column, width: Column, height: Column, parts: Column) -> Column:
    """The samples of a picture as an array: height rows of width * parts samples of 1, 2, 4, 8 or 16 bits, each row padded to whole bytes; null for other bits.

    What is missing at the end is 0; what is too much is left out.
    """
    of_row = (width * parts).cast("int")
    row_bytes = F.ceil(of_row * bits / 8).cast("int")
    count = of_row * height.cast("int")

    def sample(i: Column) -> Column:
        row, k = F.floor(i / of_row), i % of_row
        bit = k * bits
        at = row * row_bytes + F.floor(bit / 8)
        small = F.call_function("shiftright", _byte(data, at), (F.lit(8) - bits - bit % 8).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1), bits.cast("int")) - 1)
        return F.when(bits == 16, _byte(data, at) * 256 + _byte(data, at + 1)).when(bits == 8, _byte(data, at)).otherwise(small)

    empty = F.array().cast("array<int>")
    return F.when(bits.isin(1, 2, 4, 8, 16), F.when(count <= 0, empty).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), sample)))


def palette_colours(values: Column, palette: Column) -> Column:
    """Samples of an indexed picture as an array of (r, g, b) from a palette, binary data of three bytes a colour; black beyond its end."""
    return F.transform(values, lambda i: F.struct(*[_byte(palette, i * 3 + k).alias(n) for k, n in enumerate("rgb")]))


# Entries of dictionaries ---------------------------------------------------------------------------------------------


def popped(entries: Column, key: str, default: Column | None = None) -> tuple[Column, Column]:
    """(value, rest): the entry of a map under a key, else the default, and the map without it. An entry that is null is one."""
    there = F.map_contains_key(entries, F.lit(key))
    value = F.element_at(entries, F.lit(key))
    return (F.when(there, value) if default is None else F.when(there, value).otherwise(default)), F.map_filter(entries, lambda k, v: k != key)


def item_values(items: Column) -> Column:
    """The values of an array property, items being an array of (lang, value); null where there is no array."""
    return F.transform(items, lambda x: x["value"].cast("string"))
