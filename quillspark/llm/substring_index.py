"""Substring dedup over an incremental, log-structured fingerprint index.

The index holds sorted immutable runs: tables of window fingerprints (hash, and the digests of texts that have it), bucketed and
sorted by hash, so that a new batch is merge-joined with each run without another shuffle. Every
batch adds a run; runs of a level are compacted into one of the next level as soon as there are
FANOUT of them. A fingerprint is the smallest 8-word gram of a window, so that any window that a batch
shares with history has its fingerprint in a run. A hit only says where to look: the whole windows
around it are then compared by hashes of all their words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import windows
from quillspark.llm.text import documents_of, word_hashes
from quillspark.session import durable, remove, shared_folder

WINDOW, GRAM = 50, 8
FANOUT = 2


class FingerprintIndex:
    """Runs of historical fingerprints, as tables of the session's catalogue; their files are in the shared folder."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, runs: list[tuple[int, str]] | None = None) -> None:
        """runs: (level, table) of an index that earlier batches have left; name begins the names of new tables.

        Runs have as many buckets as shuffles have partitions, unless given: then each bucket is one file.
        """
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"runs_{uuid.uuid4().hex}"
        self.folder = shared_folder(spark, "runs")
        self.runs = list(runs or [])
        self.made = len(self.runs)

    def _write(self, run: DataFrame, level: int) -> tuple[int, str]:
        table = f"{self.name}_{level}_{self.made}"
        self.made += 1
        run.write.bucketBy(self.buckets, "hash").sortBy("hash").format("parquet").option("path", f"{self.folder}/{table}").saveAsTable(table)
        return level, table

    def _drop(self, table: str) -> None:
        where = self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first()
        self.spark.sql(f"DROP TABLE {table}")
        if where:
            remove(self.spark, where["data_type"])

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-join a batch of (hash, copy) with all runs, then make it a run.

        copy tells texts apart. Returns the hashes of the batch that occur in more than one text, of the batch or of history.
        """
        run = batch.groupBy("hash").agg(F.min("copy").alias("low"), F.max("copy").alias("high"))
        level, table = self._write(run, 0)
        new = self.spark.table(table)
        hits = new.where("low != high").select("hash")
        for _, name in self.runs:
            old = self.spark.table(name).select("hash", F.col("low").alias("_low"), F.col("high").alias("_high"))
            hits = hits.unionAll(new.join(old, "hash").where("low != high OR _low != _high OR low != _low").select("hash"))
        hits = durable(hits.distinct())
        self.runs.append((level, table))
        self._compact()
        return hits

    def _compact(self) -> None:
        level = 0
        while len(full := [t for k, t in self.runs if k == level]) >= FANOUT:
            merged = self.spark.table(full[0])
            for t in full[1:]:
                merged = merged.unionAll(self.spark.table(t))
            merged = merged.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high"))
            self.runs = [r for r in self.runs if r[1] not in full] + [self._write(merged, level + 1)]
            for t in full:
                self._drop(t)
            level += 1

    def drop(self) -> None:
        """Drop all runs and their files."""
        for _, t in self.runs:
            if self.spark.catalog.tableExists(t):
                self._drop(t)
        self.runs = []


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, copy, hash): the distinct fingerprints of each document of at least window words; docs has doc_id, copy and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blobs in documents_of(batch):
                words, starts = word_hashes(blobs)
                grams = windows.Rolling(words).grams(gram)
                doc, place, _, _ = windows.anchors(grams, starts, window, gram)
                hashes = grams[place].view(np.int64)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(hashes) != 0)))[: len(doc)]
                doc, hashes = doc[new], hashes[new]
                ids, copies = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(copies[doc]), pa.array(hashes)], names=["doc_id", "copy", "hash"])

    return docs.select("doc_id", "copy", "text").mapInArrow(run, "doc_id long, copy long, hash long")


def _windows_near(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, doc_id, copy, at) of every window whose fingerprint is in its row's hits; docs has doc_id, copy, hits and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blobs in documents_of(batch):
                words, starts = word_hashes(blobs)
                rolling = windows.Rolling(words)
                grams = rolling.grams(gram)
                doc, place, first, last = windows.anchors(grams, starts, window, gram)
                hits = np.unique(np.concatenate([np.array(r[2], np.int64) for r in rows]))
                near = np.isin(grams[place].view(np.int64), hits)
                at, which = windows.ranges(first[near], last[near])
                doc = doc[near][which]
                ids, copies = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
                keys = rolling.at(at, window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[doc]), pa.array(copies[doc]), pa.array((at - starts[doc]).astype(np.int32))], names=["key", "doc_id", "copy", "at"])

    return docs.mapInArrow(run, "key long, doc_id long, copy long, at int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3) -> DataFrame:
    """(doc_id, copy, starts, whole): where windows begin that also begin in a document with a smaller doc_id; copy is the digest of the text.

    docs has doc_id (long, not null), copy and text (not null). A text that a document with a smaller doc_id has too isn't
    looked at: whole is true. Of all documents with one text, the one with the smallest doc_id stands for it.
    """
    spark = docs.sparkSession
    copies = durable(docs.select("doc_id", "copy", F.xxhash64("text", F.lit(1)).alias("check")))
    first = copies.groupBy("copy", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"))
    again = copies.join(first.where("first != _last"), ["copy", "check"]).where("doc_id != first").select("doc_id", "copy").distinct()
    prints = fingerprints(docs, window, gram).persist(StorageLevel.MEMORY_AND_DISK)
    low, high = copies.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    cuts = [low + (high + 1 - low) * i // batches for i in range(batches + 1)]
    index, hits = FingerprintIndex(spark), None
    try:
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found = index.add(prints.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
            hits = found if hits is None else hits.unionAll(found)
    finally:
        index.drop()  # hits are durable
    near = prints.join(hits.distinct(), "hash").groupBy("copy").agg(F.collect_set("hash").alias("hits"))  # of one text
    near = near.join(first.groupBy("copy").agg(F.min("first").alias("doc_id")), "copy").select("doc_id", "copy", "hits")
    near = durable(near)
    prints.unpersist()
    # both uses of docs, here and where the result is joined to it, read one exchange
    rows = _windows_near(docs.join(near, ["doc_id", "copy"]).select("doc_id", "copy", "hits", "text"), window, gram)
    least = rows.groupBy("key").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first != _last").drop("_last")
    later = rows.join(least, "key").where("doc_id > _first").select("doc_id", "copy", "at")
    found = later.unionAll(again.select("doc_id", "copy", F.lit(-1).alias("at")))
    return found.groupBy("doc_id", "copy").agg(F.collect_list(F.when(F.col("at") >= 0, F.col("at"))).alias("starts"), F.bool_or(F.col("at") < 0).alias("whole"))  # windows of one document


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3, with_text: bool = False) -> DataFrame:
    """Remove the words of every passage of at least window words that a document with a smaller doc_id has too.

    Words are runs without the white space 0x20, 0x09-0x0D, compared unchanged. Windows are judged on
    the input, not on what is left. The documents pass through a FingerprintIndex in batches of rising doc_id.

    docs needs doc_id (integer) and text; other columns are ignored. Returns doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and, with_text, kept (those words). Null
    and empty texts have no words. Rows without doc_id take no part. Rows that share a doc_id aren't
    compared with each other; each loses what was found for its own text. Empty tables give empty results.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    starts = repeated_windows(texts, window, gram, batches)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blobs in documents_of(batch):
                out = []
                for (doc_id, at, whole), blob in zip(rows, blobs, strict=True):
                    words = blob.split()
                    kept = words
                    if whole and len(words) >= window:
                        kept = []
                    elif at:
                        gone = windows.covered(np.unique(np.array(at, np.int64)), window, len(words))
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    joined = b" ".join(kept)
                    out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
                c = list(zip(*out, strict=True))
                arrays = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(c[4])], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    joined = texts.join(starts, ["doc_id", "copy"], "left").select("doc_id", "starts", "whole", "text")
    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
