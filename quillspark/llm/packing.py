"""Packing of tokenized documents into training sequences by best-fit decreasing."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import documents_of

#: Pieces that are packed together, about.
PACKED = 8192
#: Words, and texts between ASCII spaces, whose ids a task remembers, in each of two generations.
REMEMBERED = 400_000
#: Marks that often follow a word; a run of them is tokenized apart from the word.
TAIL = ",.;:!?*#$%&|-"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group_id long"


class Capacities:
    """A segment tree over 0..window: how many open windows have each remaining capacity.

    tightest(need) descends to the smallest capacity of at least need that some window has.
    """

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def put(self, capacity: int, number: int) -> None:
        self.open.setdefault(capacity, []).append(number)
        self._add(capacity, 1)

    def take(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.open[capacity].pop()

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        node = need + self.leaves
        if self.counts[node]:
            return need
        while node > 1:
            if not node & 1 and self.counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.counts[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """The window of each piece and its offset there; each piece is at most window long."""
    tree, used = Capacities(window), []
    number, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        capacity = tree.tightest(lengths[i])
        if capacity is None:
            w, capacity = len(used), window
            used.append(0)
        else:
            w = tree.take(capacity)
        number[i], offset[i] = w, used[w]
        used[w] += lengths[i]
        if capacity > lengths[i]:
            tree.put(capacity - lengths[i], w)
    return number, offset


class _Recent:
    """Ids met lately, in two generations; the elder is dropped when the younger is full."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that aren't known; the others are in young from here on, until the next call."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        new, old, young = [], self.old, self.young
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        return new


class _Ids:
    """Packed ids of what stands between ASCII spaces; the tokenizer drops white space and never joins across it.

    What was met lately is remembered, and so are words apart from their case and the marks behind them.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given each task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.chunks, self.words, self.tails = _Recent(), _Recent(), {"": b""}

    def of(self, chunks: set[str]) -> dict[str, bytes]:
        """A dictionary with all these chunks."""
        new = self.chunks.missing(chunks)
        young, tails = self.chunks.young, self.tails
        stems = [c.rstrip(TAIL) for c in new]
        lower = [s.lower() if s.isascii() else s for s in stems]
        missing = self.words.missing({s for s in lower if s.isalpha()})  # may begin a new young generation
        words = self.words.young
        words.update(self._words(missing))
        for c, stem, key in zip(new, stems, lower, strict=True):
            tail = c[len(stem) :]
            if key in words and "'" not in tail:
                if tail not in tails:
                    if len(tails) > REMEMBERED:
                        tails.clear()
                    tails[tail] = self._one(tail)
                young[c] = words[key] + tails[tail]
            else:
                young[c] = self._one(c)
        return young

    def _one(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters only, many in a text: each ends with a token that ends a word."""
        out = {}
        texts = [words[i : i + 256] for i in range(0, len(words), 256)]
        for some, e in zip(texts, self.tokenizer.encode_batch_fast([" ".join(t) for t in texts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                packed, cuts = ids.tobytes(), (4 * ends).tolist()
                for word, a, b in zip(some, [0, *cuts], cuts, strict=False):
                    out[word] = packed[a:b]
            else:  # a letter whose lower case isn't one letter
                for word in some:
                    out[word] = self._one(word)
        return out


_known: dict[str, _Ids] = {}


def _mixed(x: int) -> int:
    x = x * 0x9E3779B97F4A7C15 % (1 << 64)
    return (x ^ x >> 32) * 0xC2B2AE3D27D4EB4F % (1 << 64)


def tokenize_and_cut(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, groups: int = 1, with_ids: bool = False) -> DataFrame:
    """Token ids of every text, cut into full windows and a rest; a row for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _known:
            _known[tokenizer_path] = _Ids(tokenizer_path)  # a worker keeps it for its next tasks
        known = _known[tokenizer_path]
        end = np.array([end_id], "<u4").tobytes()
        task, times = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for rows, blobs in documents_of(batch):
                split = [b.decode().replace("\n", " ").split(" ") for b in blobs]
                ids = known.of(set().union(*split))
                out = []
                for (doc_id,), chunks in zip(rows, split, strict=True):
                    packed = b"".join(map(ids.__getitem__, chunks)) + end
                    total, at = len(packed) // 4, 0
                    while at < total:
                        n = min(window, total - at)
                        piece = packed[4 * at : 4 * (at + n)]
                        crc = zlib.crc32(piece)
                        same = (doc_id, at, crc, total)
                        # equal pieces of a task are told apart by their number, so that a repeated task deals the same pieces to the same groups
                        salt = crc + (times[same] << 32) + task * 0x165667B19E3779F9
                        times[same] += 1
                        group = (_mixed(_mixed((doc_id or 0) + at * 0xC2B2AE3D27D4EB4F) + salt)) >> 20
                        out.append((doc_id, at, n, crc, total, group % groups, piece))
                        at += n
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:6]]
                if with_ids:
                    arrays.append(pa.array(columns[6], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most window tokens.

    docs needs doc_id (integer) and text; other columns are ignored. A document is the ids of its text and
    then end_id. What is longer than a window is cut into full windows and a rest. Pieces are dealt
    by a hash to groups of about PACKED rows, and each group is packed by best-fit decreasing:
    longest first, each into the open window with the tightest remaining capacity.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (unique,
    not dense), offset; with_ids adds the ids (little-endian unsigned 32-bit).

    Null and empty texts are a document of end_id alone. Null or repeated doc_ids are packed row by
    row like any other. An empty table gives an empty result.
    """
    groups = max(1, -(-docs.count() // PACKED))
    pieces = tokenize_and_cut(docs, tokenizer_path, window, end_id, groups, with_ids)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        number, offset = best_fit_decreasing(rows["length"].tolist(), window)
        return rows.assign(sequence_id=rows["group_id"].to_numpy() * (1 << 31) + np.array(number, np.int64), offset=np.array(offset, np.int64)).drop(columns="group_id")

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    packed = pieces.groupBy("group_id").applyInPandas(pack, schema)
    if not with_ids:
        return packed
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("ids"))
