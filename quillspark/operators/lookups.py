"""Lookups that are joins once data is tabular. Sides that a query says are code tables are left to the planner's size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators.codes import code_point


def range_lookup(codes: DataFrame, ranges: DataFrame, code: str, width: float) -> DataFrame:
    """The range (lo <= code <= hi) of the first layer that has each code; null columns if none does.

    Codes and ranges meet in buckets of a given width, so the join is an equi-join; a range is in each
    bucket that it touches (codes.first_range has no such width, for whole numbers). Each distinct code is looked up once.
    """
    bucket = F.floor(F.col(code) / width)
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    keyed = codes.select(code).where(F.col(code).isNotNull()).distinct().withColumn("_bucket", bucket)
    hit = keyed.join(spread, "_bucket").where(F.col(code).between(F.col("lo"), F.col("hi")))
    rest = [c for c in ranges.columns if c != code]
    best = hit.groupBy(code).agg(F.min(F.struct("layer", "lo", *[c for c in rest if c not in ("layer", "lo")])).alias("_hit"))
    return codes.join(best, code, "left").select(*codes.columns, *[F.col("_hit")[c].alias(c) for c in rest])


def first_of_sources(wanted: DataFrame, sources: DataFrame, name: str, priority: str) -> DataFrame:
    """For each wanted name the source row of the highest priority, compared without case; null columns if there is none."""
    key = F.lower(F.col(name))
    rank = Window.partitionBy("_key").orderBy(F.desc(priority), "source_name")
    best = sources.withColumn("_key", F.lower("source_name")).withColumn("_k", F.row_number().over(rank)).where("_k = 1").drop("_k")
    return wanted.withColumn("_key", key).join(best, "_key", "left").drop("_key")


def synchronise(left: DataFrame, right: DataFrame, keys: list[str], authority: str) -> DataFrame:
    """Full outer join of two key-value tables; the authoritative side's value wins where it has one."""
    if authority not in ("left", "right"):
        raise ValueError(f"unknown side {authority!r}")
    both = left.withColumnRenamed("value", "_l").join(right.withColumnRenamed("value", "_r"), keys, "full_outer")
    order = ("_l", "_r") if authority == "left" else ("_r", "_l")
    return both.select(*keys, F.coalesce(*order).alias("value"), F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("found_in"))


def coverage_gaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side that the other lacks, both ways."""
    a = left.select(*keys).distinct().join(right, keys, "left_anti").withColumn("missing_in", F.lit("right"))
    b = right.select(*keys).distinct().join(left, keys, "left_anti").withColumn("missing_in", F.lit("left"))
    return a.unionByName(b)


def covered_later(df: DataFrame, group: str, order: str, size: Column) -> DataFrame:
    """Rows that a later row of the same group is larger than: a suffix maximum, not a theta join."""
    later = Window.partitionBy(group).orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_most", F.max(size).over(later)).where(F.col("_most") > size).drop("_most")


def resolve_names(names: DataFrame, parts_table: DataFrame, row_id: str, name: str) -> DataFrame:
    """Names made of parts: cut at the first full stop, parted at underscores, each part looked up in (part, value).

    A part that the table lacks may be uniXXXX (one or several code points of four hexadecimal digits) or uXXXX to uXXXXXX (one code point), but no surrogates. One
    part that stays unresolved makes the whole name null.
    """
    stem = F.substring_index(name, ".", 1)
    parts = names.select(row_id, F.posexplode(F.split(stem, "_")).alias("n", "part")).join(parts_table, "part", "left")
    digits = F.regexp_extract("part", "^uni((?:[0-9A-Fa-f]{4})+)$", 1)
    several = F.when((digits != "") & ~F.exists(F.regexp_extract_all(digits, F.lit("[0-9A-Fa-f]{4}"), F.lit(0)), lambda x: x.rlike("^[dD][89A-Fa-f]")), F.decode(F.unhex(digits), "UTF-16BE"))
    one = F.regexp_extract("part", "^u([0-9A-Fa-f]{4,6})$", 1)
    single = code_point(F.when(one != "", F.conv(one, 16, 10).cast("long")))
    value = F.coalesce("value", several, single)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("_v").alias("v")))), lambda x: x["v"])
    return parts.withColumn("_v", value).groupBy(row_id).agg(F.when(F.bool_and(F.col("_v").isNotNull()), F.array_join(ordered, "")).alias("value"))


def with_aliases(wanted: DataFrame, fonts: DataFrame, name: str, names: list[str], row_id: str) -> DataFrame:
    """Rows of fonts any of whose names equals the wanted one without case; each pair once."""
    keys = fonts.select(row_id, F.explode(F.array_distinct(F.transform(F.array(*names), lambda x: F.lower(x)))).alias("_key")).where("_key IS NOT NULL")
    return wanted.withColumn("_key", F.lower(name)).join(keys, "_key").drop("_key").distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; the others stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def changed_rows(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, change): keys that were added or removed, and those whose content differs. Only digests of the content are joined."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.sha2(F.to_json(F.struct(*content)), 256).alias(name))

    both = digest(old, "_old").join(digest(new, "_new"), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


# Properties of the two kinds of metadata that stand for each other, and the form of the second.
METADATA = [
    ("Title", "dc", "title", "alt"),
    ("Author", "dc", "creator", "seq"),
    ("Subject", "dc", "description", "alt"),
    ("Keywords", "pdf", "Keywords", "text"),
    ("Creator", "xmp", "CreatorTool", "text"),
    ("Producer", "pdf", "Producer", "text"),
    ("CreationDate", "xmp", "CreateDate", "date"),
    ("ModDate", "xmp", "ModifyDate", "date"),
]


def _metadata_names(df: DataFrame) -> DataFrame:
    rows = df.sparkSession.createDataFrame(METADATA, "name string, prefix string, property string, form string")
    return F.broadcast(rows)  # as many rows as METADATA


def info_to_properties(info: DataFrame, document: list[str]) -> DataFrame:
    """Info entries (document, name, value) as properties: (document, prefix, property, form, items: array of (lang, value)).

    Names without a property, and empty values, have no row. Dates are written as ISO, or stay as they are if they aren't dates; an alternative has the language x-default.
    """
    rows = info.where("value IS NOT NULL AND value != ''").join(_metadata_names(info), "name")
    iso = scalars.tagged_date_to_iso(F.col("value"))
    value = F.when((F.col("form") == "date") & (iso != ""), iso).otherwise(F.col("value"))
    lang = F.when(F.col("form") == "alt", F.lit("x-default"))
    return rows.select(*document, "prefix", "property", "form", F.array(F.struct(lang.alias("lang"), value.alias("value"))).alias("items"))


def properties_to_info(properties: DataFrame, document: list[str]) -> DataFrame:
    """Properties (document, prefix, property, items: array of (lang, value)) as info entries (document, name, value); a prefix may end with a colon.

    Of alternatives the first without language or in x-default is taken, else the first; sequences are joined by ", "; ISO dates become tagged ones. Empty values have no row.
    """
    rows = properties.select(*document, F.rtrim("prefix", F.lit(":")).alias("prefix"), "property", "items").join(_metadata_names(properties), ["prefix", "property"])
    first = F.get("items", F.lit(0))["value"]
    values = F.array_join(F.transform("items", lambda x: x["value"]), ", ")
    tagged = scalars.iso_text_to_tagged(first)
    value = F.when(F.col("form") == "alt", scalars.localized("items", "x-default")).when(F.col("form") == "seq", values).when((F.col("form") == "date") & (tagged != ""), tagged).otherwise(first)
    return rows.select(*document, "name", value.alias("value")).where("value IS NOT NULL AND value != ''")


def namespaces(registrations: DataFrame, document: list[str]) -> DataFrame:
    """Prefixes and URIs in force after registrations (document, seq, prefix, uri): (document, prefix, uri, of_uri).

    The last registration of a prefix gives its uri; of_uri says whether it is also the prefix that the uri is written with: the last one registered for the uri, unless that prefix stands for another uri
    by now. Trailing colons of prefixes don't count; empty prefixes and URIs are no registrations.
    """
    rows = registrations.withColumn("prefix", F.rtrim("prefix", F.lit(":"))).where("prefix != '' AND uri != ''")
    by_prefix = rows.groupBy(*document, "prefix").agg(F.max_by("uri", "seq").alias("uri"))
    by_uri = rows.groupBy(*document, "uri").agg(F.max_by("prefix", "seq").alias("_prefix"))
    return by_prefix.join(by_uri, [*document, "uri"]).select(*document, "prefix", "uri", (F.col("_prefix") == F.col("prefix")).alias("of_uri"))


def named_marks(marks: DataFrame, properties: DataFrame, elements: DataFrame) -> DataFrame:
    """Marks on pages (page, mark, mcid, name) with the structure element of each: adds the mcid that counts and element, null where there is none.

    A mark has its number itself, or a name that its page's properties (page, name, mcid) resolve; negative numbers are none. elements (page, mcid, element).
    """
    known = properties.where("mcid >= 0").select("page", "name", F.col("mcid").alias("_named"))
    numbered = marks.join(known, ["page", "name"], "left").withColumn("mcid", F.coalesce(F.when(F.col("mcid") >= 0, F.col("mcid")), "_named")).drop("_named")
    return numbered.join(elements, ["page", "mcid"], "left").select("page", "mark", "mcid", "element")
