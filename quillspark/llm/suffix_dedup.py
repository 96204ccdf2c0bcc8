"""Exact substring dedup by suffix sorting with bucket-pointer refinement.

Suffixes are sorted only as far as a repeat can matter, and only where one is possible:

1. Every window (400 bytes) has an anchor, the smallest 32-byte gram in it, at some offset. Windows with the anchor in
   their first half all hold the same bytes behind it, the others the same bytes before it: these bytes are the core of
   a bucket. Equal windows lie in buckets with equal cores, so buckets with one place only are dropped.
2. The bytes that the windows of a bucket cover at one place are a piece. Equal pieces are one piece with a count; only
   distinct pieces of a bucket carry their bytes to a task.
3. There all suffixes are sorted: first by q-grams, then bucket after bucket by the pointers of later offsets (to the buckets
   in which the rest of a suffix lies). Refined pointers are written back at once, so buckets that come later are
   refined by them and gain more bytes than they had. Neighbours in the order that agree in a whole window are repeats.
4. A bucket of more than CROWDED distinct pieces is split before: its windows go, by halves of their offsets, to buckets with
   longer cores (in the end the whole window, of which there is one distinct piece), and what is found comes back to the pieces.

Copies of a whole text are one text from the start, so a group of copies costs as much as one of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import windows
from quillspark.llm.text import documents_of
from quillspark.session import durable, sized

WINDOW, GRAM = 400, 32
#: Bytes of text that become arrays of eight bytes for each at once.
AT_ONCE = 1 << 18
#: Distinct pieces of a bucket beyond which it is split; bytes of pieces that are sorted together, about (a bucket stays whole).
CROWDED, TOGETHER = 1500, 1 << 18
#: Bytes of the windows that look for passages; a passage has more words than this.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
#: Parts of the order that are refined one after the other in a pass, so that later ones see what earlier ones have found.
PARTS = 4

PIECES = "o1 long, o2 long, at int, size int, key long, digest long, place int, lo int, hi int"


def _byte_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, blobs)])
    return windows.BYTE_HASHES[np.frombuffer(b"".join(blobs), np.uint8)], starts


def suffix_order(text: np.ndarray, length: int, q: int) -> np.ndarray:
    """All suffixes of text (items as hashes), in an order in which those with the same first length items stand together.

    q divides length. A bucket's pointer is the place of its first suffix in the order; depth is how many items a bucket stands for.
    """
    n = len(text)
    marks = windows._scatter(np.arange(1, 2 * q + 1, dtype=np.uint64) * windows.U64(0x9E3779B97F4A7C15))  # an end unlike all else
    grams = windows.Rolling(np.concatenate((text, marks))).grams(q)[: n + q]
    order = np.argsort(grams, kind="stable")
    pointer = np.empty(n + q, np.int64)
    depth = np.full(n + q, q, np.int64)
    active = _point(order, np.arange(n + q), grams[order], pointer)
    while len(active):
        later = []
        heads = np.flatnonzero(np.concatenate(([True], np.diff(pointer[order[active]]) != 0)))
        cuts = np.unique(heads[np.linspace(0, len(heads), PARTS + 1).astype(int)[:-1]])
        for places in np.split(active, cuts[1:]):
            suffixes = order[places]
            rest = suffixes + depth[suffixes]
            key = pointer[suffixes] * np.int64(n + q) + pointer[rest]
            deeper = depth[suffixes] + depth[rest]
            some = np.argsort(key, kind="stable")
            order[places] = suffixes[some]
            depth[suffixes] = deeper
            later.append(_point(order[places], places, key[some], pointer))
        active = np.concatenate(later)
        active = active[depth[order[active]] < length]
    return order[order < n]


def _point(suffixes: np.ndarray, places: np.ndarray, keys: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Write the pointers of suffixes that stand at places in the order of their keys; returns the places of buckets of several."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    pointer[suffixes] = np.repeat(places[first], size)
    return places[np.repeat(size > 1, size)]


def refine(text: np.ndarray, wanted: np.ndarray, length: int, q: int) -> np.ndarray:
    """Which of the wanted suffixes of text have another wanted suffix with the same first length items."""
    asked = np.full(len(text), -1)
    asked[wanted] = np.arange(len(wanted))
    order = suffix_order(text, length, math.gcd(q, length))
    order = order[asked[order] >= 0]
    whole = windows.Rolling(text).at(order, length)
    as_next = np.flatnonzero(whole[1:] == whole[:-1])
    out = np.zeros(len(wanted), bool)
    out[asked[order[as_next]]] = out[asked[order[as_next + 1]]] = True
    return out


def _halves(rolling: windows.Rolling, o1, o2, base, place, first, last, lo, hi, window: int, gram: int) -> pa.RecordBatch:
    """Pieces of the windows first..last about the anchors at place, by the halves of lo..hi.

    lo and hi: the least and most of a window's begin, counted from the first window that could hold the anchor. All windows of a half hold its
    core, whose hash is the key.
    """
    reach, out = window - gram, []
    middle = (lo + hi) // 2
    for a, b in ((lo, middle), (middle + 1, hi)):
        begin, end = np.maximum(first, place - reach + a), np.minimum(last, place - reach + b)
        k = np.flatnonzero(begin <= end)
        a, b, begin, end, at = (x[k] for x in (*np.broadcast_arrays(a, b, begin, end), place))
        key = windows._scatter(rolling.at(at - reach + b, window - (b - a)) + a.astype(np.uint64) * windows.U64(windows.BASE))
        size = end - begin + window
        out.append((o1[k], o2[k], (begin - base[k]).astype(np.int32), size.astype(np.int32), key.view(np.int64), rolling.at(begin, size).view(np.int64), *((x).astype(np.int32) for x in (at - begin, a, b))))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])


def _text_pieces(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The pieces of every text; texts has o1, o2 (what tells texts apart) and text."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blobs in documents_of(batch, AT_ONCE):
                items, starts = _byte_hashes(blobs)
                rolling = windows.Rolling(items)
                doc, place, first, last = windows.anchors(rolling.grams(gram), starts, window, gram)
                o1, o2 = (np.array([r[i] for r in rows], np.int64)[doc] for i in (0, 1))
                yield _halves(rolling, o1, o2, starts[doc], place, first, last, np.int64(0), np.int64(reach), window, gram)

    return texts.select("o1", "o2", "text").mapInArrow(run, PIECES)


def _split_pieces(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """Pieces with their bytes (text) as pieces with longer cores; o1 and o2 are the split piece's key and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blobs in documents_of(batch, AT_ONCE):
                items, starts = _byte_hashes(blobs)
                o1, o2, place, lo, hi = np.array(rows, np.int64).reshape(-1, 5).T
                yield _halves(windows.Rolling(items), o1, o2, starts[:-1], starts[:-1] + place, starts[:-1], starts[1:] - window, lo, hi, window, gram)

    return pieces.select(F.col("key").alias("o1"), F.col("digest").alias("o2"), "place", "lo", "hi", "text").mapInArrow(run, PIECES)


def _with_bytes(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted pieces with their bytes, taken from the rows of source (o1, o2, text)."""
    fields = ["at", "size", "key", "digest", "n", "place", "lo", "hi", "m"]
    of_one = wanted.groupBy("o1", "o2").agg(F.collect_list(F.struct(*fields)).alias("some"))  # pieces of one text
    rows = source.join(sized(wanted.select("o1", "o2").distinct()), ["o1", "o2"], "left_semi").groupBy("o1", "o2").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, texts = batch.column(0), batch.column(1).cast(pa.binary())
            flat = lists.flatten()
            columns = {f: flat.field(i) for i, f in enumerate(fields)}
            at, size = columns["at"].to_pylist(), columns["size"].to_pylist()
            cut, k = [], 0
            for i, n in enumerate(lists.value_lengths().to_pylist()):
                blob = texts[i].as_py()
                cut += [blob[a : a + s] for a, s in zip(at[k : k + n], size[k : k + n], strict=True)]
                k += n
            yield pa.RecordBatch.from_arrays([*(columns[f] for f in fields[2:]), pa.array(cut, pa.binary())], names=[*fields[2:], "text"])

    return rows.join(of_one, ["o1", "o2"]).select("some", "text").mapInArrow(run, "key long, digest long, n long, place int, lo int, hi int, m long, text binary")


def _runs(piece: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to) of what windows cover, from starts in order; windows that follow on each other are one row."""
    new = np.flatnonzero((np.diff(start) != 1) | (np.diff(piece) != 0)) + 1
    first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(start) - 1]))
    return piece[first], start[first], start[last] + window


def _sorted_buckets(pieces: DataFrame, window: int, groups: int) -> DataFrame:
    """(key, digest, a, b): repeated bytes a to b of the pieces that occur once, by suffix sorting within groups of buckets."""
    q = max(d for d in range(1, min(window, 64) + 1) if window % d == 0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blobs = rows["text"].tolist()
        size = np.fromiter(map(len, blobs), np.int64, len(blobs))
        starts = np.cumsum(size + 1) - size - 1
        text = windows.BYTE_HASHES[np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)]
        text[starts + size] = windows._scatter(np.arange(1, len(size) + 1, dtype=np.uint64) * windows.U64(windows.BASE))  # an end of its own for each
        wanted, which = windows.ranges(starts, starts + size - window)
        repeated = refine(text, wanted, window, q) & (rows["n"].to_numpy() == 1)[which]
        wanted, which = wanted[repeated], which[repeated]
        if not len(wanted):
            return pd.DataFrame({"key": [], "digest": [], "a": [], "b": []}, dtype="int64")
        piece, a, b = _runs(which, wanted - starts[which], window)
        return pd.DataFrame({"key": rows["key"].to_numpy()[piece], "digest": rows["digest"].to_numpy()[piece], "a": a, "b": b})

    group = F.pmod(F.xxhash64("key"), F.lit(groups))
    return pieces.select(group.alias("group"), "key", "digest", "n", "text").groupBy("group").applyInPandas(run, "key long, digest long, a long, b long")


def _repeats(source: DataFrame, pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """(o1, o2, a, b): bytes a to b of the texts of source (o1, o2, text) that windows cover which occur at another place too."""
    pieces = pieces.persist(StorageLevel.MEMORY_AND_DISK)
    where = F.xxhash64("o1", "o2", "at")
    twice = sized(pieces.groupBy("key").agg(F.min(where).alias("_a"), F.max(where).alias("_b")).where("_a != _b").select("key"))
    some = durable(pieces.join(twice, "key"))
    pieces.unpersist()
    distinct = some.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("o1", "o2", "at", "size", "place", "lo", "hi")).alias("_r"))
    distinct = durable(distinct.select("key", "digest", "n", "_r.*"))
    buckets = distinct.groupBy("key").agg(F.count("*").alias("m"), F.sum("size").alias("bytes")).where("m > 1")
    buckets = sized(buckets)
    sorted_bytes = buckets.where(F.col("m") <= CROWDED).agg(F.sum("bytes")).first()[0] or 0
    apart = durable(_with_bytes(source, distinct.join(buckets.select("key", "m"), "key")))
    found = distinct.where("n > 1").select("key", "digest", F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))
    found = found.unionByName(_sorted_buckets(apart.where(F.col("m") <= CROWDED), window, max(1, -(-sorted_bytes // TOGETHER))))
    crowded = apart.where(F.col("m") > CROWDED)
    if crowded.limit(1).count():
        inner = crowded.select(F.col("key").alias("o1"), F.col("digest").alias("o2"), "text")
        found = found.unionByName(_repeats(inner, _split_pieces(crowded, window, gram), window, gram).withColumnsRenamed({"o1": "key", "o2": "digest"}))
    found = durable(found)
    return some.join(found, ["key", "digest"]).select("o1", "o2", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))


def repeated_bytes(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, copy, spans): the bytes of each text that lie in a window that also begins elsewhere.

    texts has doc_id (long, not null), copy (the text's digest) and text (not null), and may have more. spans are pairs (a, b), not
    merged. Of copies of a whole text only one is compared with other texts: all of each goes if it has a window.
    """
    own = durable(texts.select("doc_id", "copy", F.xxhash64("text", F.lit(1)).alias("check"), F.octet_length("text").cast("long").alias("b")))
    kinds = ["copy", "check"]
    many = sized(own.groupBy(*kinds).agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first")).where("_n > 1"))
    copies = own.join(many, kinds)
    again = sized(copies.where("doc_id != _first").select(F.col("doc_id").alias("o1"), F.col("copy").alias("o2")).distinct())
    source = texts.select(F.col("doc_id").alias("o1"), F.col("copy").alias("o2"), "text").join(again, ["o1", "o2"], "left_anti")
    spans = _repeats(source, _text_pieces(source, window, gram), window, gram).select(F.col("o1").alias("doc_id"), F.col("o2").alias("copy"), "a", "b")
    spans = spans.unionByName(copies.where(F.col("b") >= window).select("doc_id", "copy", F.lit(0).cast("long").alias("a"), "b").distinct())
    return spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("a", "b")).alias("spans"))  # of one text


def _merged(spans: list[dict] | None) -> list[list[int]]:
    """Overlapping and touching spans as one, in order."""
    merged: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def whole_words(blob: bytes, a: int, b: int) -> int:
    """How many words of blob lie in its bytes a to b with both ends."""
    words = len(blob[a:b].split())
    if words and a and not blob[a - 1 : a].isspace() and not blob[a : a + 1].isspace():
        words -= 1
    if words and b < len(blob) and not blob[b - 1 : b].isspace() and not blob[b : b + 1].isspace():
        words -= 1
    return words


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, words: int = 0, with_text: bool = False, also: tuple[str, ...] = (), passages: bool = False) -> DataFrame:
    """Remove every byte that lies in a string of window bytes which also begins anywhere else.

    "Elsewhere" is another place of the same or of another document; matches never cross
    documents; overlaps count; all copies go, the first one too. Strings are judged on the input. If words is given,
    removed runs with fewer whole words stay.

    docs needs doc_id (integer) and text; of other columns those named in also pass through. Returns doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256 and, with_text, kept (the remaining bytes; what is left of
    a character that was cut goes too). With passages, n_passage_bytes follows: bytes in repeated runs of more than PASSAGE_WORDS whole
    words, found by windows of PASSAGE_BYTES (at most window); they are only counted. Null texts count as empty; texts shorter than a window stay. Rows
    without doc_id take no part. Rows that share a doc_id are judged each by its own text. Empty tables give empty results.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), *also, F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.xxhash64("text"))
    if passages:
        fine = durable(repeated_bytes(texts, PASSAGE_BYTES, gram))
        # a repeated window is covered by repeated shorter ones, so no text with less than a window of these has one
        enough = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"]) >= window
        spans = repeated_bytes(texts.join(sized(fine.where(enough).select("doc_id", "copy")), ["doc_id", "copy"], "left_semi"), window, gram)
        spans = spans.join(fine.withColumnRenamed("spans", "fine"), ["doc_id", "copy"], "full")
    else:
        spans = repeated_bytes(texts, window, gram).withColumn("fine", F.lit(None).cast("array<struct<a:long,b:long>>"))
    schema = texts.select("doc_id", *also).schema
    for field in ("n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", *["kept string"] * with_text, *["n_passage_bytes long"] * passages):
        schema = schema.add(*field.split())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, fine, texts_ = batch.column(batch.num_columns - 3), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).cast(pa.binary())
            out = []
            for i in range(batch.num_rows):
                blob, merged = texts_[i].as_py(), _merged(found[i].as_py())
                if words:
                    merged = [s for s in merged if whole_words(blob, *s) >= words]
                edges = [0, *(e for s in merged for e in s), len(blob)]
                kept = b"".join(blob[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if merged else blob
                of_passages = sum(b - a for a, b in _merged(fine[i].as_py()) if whole_words(blob, a, b) > PASSAGE_WORDS)
                out.append((len(blob), len(blob) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None, of_passages))
            c = list(zip(*out, strict=True)) or [()] * 6
            arrays = [*batch.columns[:-3], *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()), *[pa.array(c[4], pa.string())] * with_text, *[pa.array(c[5], pa.int64())] * passages]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    joined = texts.join(spans, ["doc_id", "copy"], "left").select("doc_id", *also, "spans", "fine", "text")
    return joined.mapInArrow(finish, schema)
