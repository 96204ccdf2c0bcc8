"""Document fingerprints: a threshold-scaled sketch of word shingles, in DataFrame functions only.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range. What is kept
doesn't depend on the document's length, so sketches merge by union and stay comparable between
documents of very unequal lengths (containment as well as likeness).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import durable

#: Words of a shingle; one in SCALE shingle hashes is kept.
WORDS, SCALE = 5, 4
WHITE = "[\\x20\\x09-\\x0D]+"


def with_word_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the hashes of the words of a text column (null: no words)."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WHITE), lambda w: w != "")
    return df.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))


def kept_hashes(hashes: str, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted distinct shingle hashes below the threshold; fewer words than a shingle has are one shingle."""
    h = F.col(hashes)
    places = F.greatest(F.size(h) - (words - 1), F.when(F.size(h) > 0, F.lit(1)).otherwise(F.lit(0)))
    shingles = F.transform(
        F.when(places > 0, F.sequence(F.lit(1), places)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.slice(h, i, F.lit(words))),
    )
    below = -(1 << 63) + (1 << 64) // scale
    return F.array_sort(F.array_distinct(F.filter(shingles, lambda x: x < F.lit(below))))


def as_text(kept: Column, text: Column) -> Column:
    """Fingerprint as a string: a digest of the text, then the kept hashes in hexadecimal."""
    return F.concat(F.lower(F.hex(F.xxhash64(text))), F.lit(":"), F.array_join(F.transform(kept, lambda x: F.lower(F.hex(x))), ""))


def likeness(a: Column, b: Column, same_text: Column) -> Column:
    """Share of kept hashes that two sketches have in common, 0 to 1; equal texts 1, two empty sketches of other texts 0."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(same_text, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first document's shingles that the second one has; null if nothing was kept of the first."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(sketches: str) -> Column:
    """Aggregate: the sketch of all documents of a group together."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))


def fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """doc_id, sketch (array of long) and fingerprint (string) of every document.

    docs needs doc_id and text; other columns are ignored. Null texts count as empty; empty texts
    have an empty sketch. Rows stay as they are, repeated or without doc_id.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_word_hashes(df, "text", "_words").withColumn("sketch", kept_hashes("_words", words, scale))
    return df.select("doc_id", "sketch", as_text(F.col("sketch"), F.col("text")).alias("fingerprint"))


def next_ids(ids: DataFrame, parts: int | None = None) -> DataFrame:
    """For each distinct integer in doc_id the next smaller one; for the smallest the largest.

    The ids are dealt to ranges (as many as the session has shuffle partitions, unless given) of about equal
    numbers of ids, however sparse they are, and each range is worked on alone. Only the largest id of each range,
    one row a range, meets those of the others in one task.
    """
    parts = parts or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    own = durable(own.repartitionByRange(parts, "doc_id").withColumn("_part", F.spark_partition_id()))
    ends = own.groupBy("_part").agg(F.max("doc_id").alias("_end"))
    every = Window.partitionBy(F.lit(0))
    ends = ends.select("_part", F.coalesce(F.lag("_end").over(every.orderBy("_part")), F.max("_end").over(every)).alias("_from"))
    within = own.withColumn("next_id", F.lag("doc_id").over(Window.partitionBy("_part").orderBy("doc_id")))
    return within.join(F.broadcast(ends), "_part").select("doc_id", F.coalesce("next_id", "_from").alias("next_id"))


def edited_fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprint every text and an edited form of it, and how alike they and the next document are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document, in falling order of doc_id; after the last comes the first.

    docs needs doc_id (integer) and text; other columns are ignored. Null texts count as empty. Rows
    without doc_id take no part. If rows share a doc_id, each gets a row, and for its
    predecessor the smallest of their texts is the next one. A single document follows itself. An
    empty table gives an empty result.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = durable(texts.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).alias("need")))
    follows = durable(ids.join(next_ids(ids), "doc_id")).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "need")
    heads = with_word_hashes(texts.join(follows, "doc_id"), "text", "_words").select(
        F.col("for_id").alias("doc_id"),
        F.struct(F.substring("text", F.lit(1), F.col("need").cast("int")).alias("head"), kept_hashes("_words", words, scale).alias("kept"), F.xxhash64("text").alias("digest")).alias("next"),
    )
    heads = heads.groupBy("doc_id").agg(F.min("next").alias("next"))
    both = texts.join(heads, "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("next.head"), F.lit(1), third)))
    both = with_word_hashes(with_word_hashes(both, "text", "_own"), "edited", "_other")
    both = both.withColumn("kept", kept_hashes("_own", words, scale)).withColumn("edited_kept", kept_hashes("_other", words, scale))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("kept"), F.col("text")).alias("fingerprint"),
        as_text(F.col("edited_kept"), F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next.kept"), F.xxhash64("text") == F.col("next.digest")).alias("near_next"),
        containment(F.col("kept"), F.col("edited_kept")).alias("in_edited"),
    )
