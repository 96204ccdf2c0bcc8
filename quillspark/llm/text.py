"""Word and n-gram hashes of whole texts, computed inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

U64 = np.uint64
MIX = U64(0x9E3779B97F4A7C15)
#: Words whose hashes a task remembers; beyond it words are hashed anew, with the same result.
REMEMBERED = 200_000
#: Bytes of text that a task turns into arrays at once (a longer text goes alone).
AT_ONCE = 1 << 20


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


_hashes = _Hashes()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def documents_of(batch: pa.RecordBatch, at_once: int = AT_ONCE) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of (other columns as rows, UTF-8 texts) of a batch whose last column is the text."""
    texts = batch.column(batch.num_columns - 1).cast(pa.binary())
    rest = [c.to_pylist() for c in batch.columns[:-1]]
    rows, blobs, size = [], [], 0
    for i in range(batch.num_rows):
        blob = texts[i].as_py() or b""
        if blobs and size + len(blob) > at_once:
            yield rows, blobs
            rows, blobs, size = [], [], 0
        rows.append(tuple(c[i] for c in rest))
        blobs.append(blob)
        size += len(blob)
    if blobs:
        yield rows, blobs


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one entry more than texts).

    Words are runs without the white space 0x20, 0x09-0x0D.
    """
    words: list[bytes] = []
    starts = np.zeros(len(blobs) + 1, np.int64)
    for i, blob in enumerate(blobs):
        words += blob.split()
        starts[i + 1] = len(words)
    return np.fromiter(map(_hashes.__getitem__, words), U64, len(words)), starts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive items that begin at each place (shorter than n: none)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = words[:m] * MIX
    for j in range(1, n):
        out ^= out >> U64(29)
        out += words[j : j + m]
        out *= MIX
    out ^= out >> U64(32)
    return out


def shingle_sets(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each text; a shorter text is one shingle, no word none."""
    words, starts = word_hashes(blobs)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else np.empty(0, U64))
    return out
