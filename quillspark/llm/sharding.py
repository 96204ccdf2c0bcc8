"""Sharding by longest processing time first.

Documents that must stay together (equal texts) form a group; groups are placed in order of
falling size, each on the shard that has least so far (a heap). The heap runs on the driver over
a number of items that doesn't depend on the input: each group that weighs more than a fixed part
of the whole is an item, and all others are dealt by a hash of their text to a fixed number of
bundles. Bundles come in classes whose weights halve, so the last items placed are tiny and level
out what the larger ones left.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import durable

#: A group is placed by itself if it weighs more than 1 / (shards * SINGLE) of the whole.
SINGLE = 64
#: Bundles in each class, for each shard; classes, each with half the weight of the one before.
BUNDLES, CLASSES = 8, 12
#: Rows of a shard that are numbered together.
NUMBERED = 20_000


def _bundle(key: Column, shards: int) -> Column:
    """The bundle of a group by its hash: class c gets 2**-(c+1) of all groups (the last class twice that)."""
    h = F.xxhash64(key, F.lit(7))
    low = F.pmod(h, F.lit(1 << CLASSES))
    kind = F.lit(CLASSES - 1)
    for c in reversed(range(CLASSES - 1)):
        kind = F.when(low.bitwiseAND(F.lit(1 << c)) != 0, F.lit(c)).otherwise(kind)
    return (kind * (shards * BUNDLES) + F.pmod(F.shiftright(h, CLASSES), F.lit(shards * BUNDLES))).cast("int")


def least_loaded(weights: dict, shards: int) -> dict:
    """Items in order of falling weight, each to the least loaded shard (ties: smaller key, smaller shard)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, weight in sorted(weights.items(), key=lambda kv: (-kv[1], str(kv[0]))):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + weight, shard))
    return out


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """Assign every document to a shard so that shards hold nearly equal bytes.

    docs needs doc_id and text; other columns are ignored. Returns doc_id, size (UTF-8 bytes of the
    text plus overhead), text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard, in no
    order that means anything) and grown_shard (null under this law).

    Null texts count as empty and are one group with empty texts. Rows with a null doc_id or with a
    doc_id that repeats are placed like any other row. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_key"),
    )
    rows = durable(rows)
    groups = rows.groupBy("_key").agg(F.sum("size").alias("weight"))
    groups = durable(groups.withColumn("bundle", _bundle(F.col("_key"), shards)))
    total, count = groups.agg(F.sum("weight"), F.count("*")).first()
    if not count:
        shard_of: dict = {}
        single: dict = {}
    else:
        alone = F.col("weight") > F.lit(total / (shards * SINGLE))
        single = {r["_key"]: r["weight"] for r in groups.where(alone).collect()}  # at most shards * SINGLE
        bundles = {r["bundle"]: r["w"] for r in groups.where(~alone).groupBy("bundle").agg(F.sum("weight").alias("w")).collect()}
        shard_of = least_loaded(single | bundles, shards)
    spark = docs.sparkSession
    by_key = spark.createDataFrame([(k, shard_of[k]) for k in single], "_key string, _own int")
    by_bundle = spark.createDataFrame([(b, s) for b, s in shard_of.items() if b not in single], "_bundle int, _theirs int")
    # at most shards * SINGLE and shards * BUNDLES * CLASSES rows
    placed = (
        rows.withColumn("_bundle", _bundle(F.col("_key"), shards))
        .join(F.broadcast(by_key), "_key", "left")
        .join(F.broadcast(by_bundle), "_bundle", "left")
        .withColumn("shard", F.coalesce("_own", "_theirs"))
    )
    return _slots(placed, shards, rows.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _slots(placed: DataFrame, shards: int, count: int) -> DataFrame:
    """Number the rows of each shard from 0, in parts of about NUMBERED rows."""
    from pyspark.sql import Window

    parts = max(1, -(-count // (shards * NUMBERED)))
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)).cast("int"))
    # repeated rows hash alike; they only make a part larger
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id")
    numbered = placed.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "_part"]).withColumn("slot", (F.col("_before") + F.col("_row")).cast("long"))
