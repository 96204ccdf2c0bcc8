"""Attributes that a node has from the nearest node above it, for many attributes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import durable


def inherited(nodes: DataFrame, attributes: list[str]) -> DataFrame:
    """nodes (id, parent, attributes) with every null attribute taken from the nearest node above that has a value.

    Adds from_<attribute>, the id of the node that has the value (null if none has), and endless: whether the walk up never
    ends because of a cycle. A missing parent ends a walk. Ids are distinct and not null.

    Pointers are doubled: a round joins the nodes that still lack something with the node that their pointer leads to, takes what that
    has, and moves on to its pointer; so a chain of n steps needs log2(n) rounds, and a node stops as soon as it has every attribute.
    Rounds end when none finishes any more: what is left then lies on or above cycles, keeps what it has met there, and is endless.
    """
    seen = {a: F.when(F.col(a).isNotNull(), F.struct(F.col("id").alias("at"), F.col(a).alias("v"))).alias(a) for a in attributes}
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("_known"))
    state = nodes.join(ids, "parent", "left").select("id", F.when(F.col("_known"), F.col("parent")).alias("up"), *seen.values())
    lacks = F.lit(False)
    for a in attributes:
        lacks = lacks | F.col(a).isNull()
    more = F.col("up").isNotNull() & lacks  # never null
    state = durable(state)
    done, open_ = state.where(~more), state.where(more)
    left = open_.count()
    while left:
        above = done.unionByName(open_).select(F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(a).alias(f"_{a}") for a in attributes])
        above = above.join(open_.select("up").distinct(), "up", "left_semi")
        moved = open_.join(above, "up").select("id", F.col("_up").alias("up"), *[F.coalesce(a, f"_{a}").alias(a) for a in attributes])
        moved = durable(moved)
        done, open_ = done.unionByName(moved.where(~more)), moved.where(more)
        before, left = left, open_.count()
        if left == before:
            break
    ended = done.withColumn("endless", F.lit(False)).unionByName(open_.withColumn("endless", F.lit(True)))
    found = ended.select("id", *[F.col(a)["v"].alias(f"_{a}") for a in attributes], *[F.col(a)["at"].alias(f"from_{a}") for a in attributes], "endless")
    kept = [F.col(f"_{c}").alias(c) if c in attributes else F.col(c) for c in nodes.columns]
    return nodes.drop(*attributes).join(found, "id").select(*kept, *[f"from_{a}" for a in attributes], "endless")


def page_attributes(nodes: DataFrame) -> DataFrame:
    """Effective attributes of the leaves of page trees: nodes (id, parent, media_box, crop_box, rotation, resources).

    All four are inherited. Rotation is turned into 0 to 359 (none: 0); a page without a crop box has its media box in its place.
    """
    out = inherited(nodes, ["media_box", "crop_box", "rotation", "resources"])
    inner = nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    leaves = out.join(inner, "id", "left_anti")
    return leaves.select("id", "media_box", F.coalesce("crop_box", "media_box").alias("crop_box"), F.coalesce(F.pmod("rotation", F.lit(360)), F.lit(0)).alias("rotation"), "resources", "endless")


def form_fields(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Fields of forms: leaves of nodes (id, parent, name, kind, value, flags), with kind, value and flags inherited.

    names (id, path) holds the full names (graph.qualified_names); nodes without a name are widgets of their parent and no fields of
    their own. Of fields with one full name the one with the largest id stands. Returns path, id, kind, value and flags (none: 0).
    """
    out = inherited(nodes, ["kind", "value", "flags"]).where("name IS NOT NULL AND NOT endless")
    inner = nodes.where("name IS NOT NULL").select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    fields = out.join(inner, "id", "left_anti").join(names, "id")
    last: Column = F.max_by(F.struct("id", "kind", "value", F.coalesce("flags", F.lit(0)).alias("flags")), "id")
    return fields.groupBy("path").agg(last.alias("f")).select("path", "f.*")
