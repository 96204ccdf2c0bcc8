"""Secret scans: three patterns, and a linear-chain conditional random field that finds what they miss.

A text's tokens are runs of letters and digits and runs of other marks. The field tags each as the beginning of a secret, inside of one
or outside, by its shape, the words about it and the file around it, and by the tag before it. It is fitted to windows of
tokens about what the patterns found and to windows of texts where they found nothing. Viterbi decoding is exact but rarely needs the whole chain: a token
whose score for "outside" leads by more than any change of transitions could make up is outside on the best path, so only the short runs
between such tokens are decoded, many side by side.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.llm.text import documents_of
from quillspark.session import durable

# The patterns, in the order in which spans that begin together are listed.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_LEAST = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "field")

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: About so many documents are looked at for the fit; at most so many windows with a secret, and as many without; tokens of a window.
LOOKED_AT, WINDOWS, WIDTH = 60_000, 1500, 31
#: Steps of the fit, and its ridge.
STEPS, RIDGE = 100, 1e-3
#: How much more likely than "outside" a secret must be, in log-odds: windows hold far more secrets than texts.
CAUTION = 2.0
#: Bytes whose tokens are found at once.
AT_ONCE = 1 << 20
SPACE, WORD, MARK = 0, 1, 2
KIND = np.array([SPACE if b == 32 or 9 <= b <= 13 else WORD if chr(b).isalnum() and b < 128 or b >= 128 else MARK for b in range(256)], np.uint8)
DIGIT, LOWER, UPPER, HIGH, OTHER = range(5)
SHAPE = np.array([DIGIT if 48 <= b <= 57 else LOWER if 97 <= b <= 122 else UPPER if 65 <= b <= 90 else HIGH if b >= 128 else OTHER for b in range(256)], np.uint8)
IS_HEX = np.array([48 <= b <= 57 or 97 <= b <= 102 or 65 <= b <= 70 for b in range(256)])
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
LENGTHS = np.array([2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64])
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BUCKETS = 1 << 12
#: Values of each feature, in the order of _features: none, length, shape, changes, digits, file, gap, itself, the words about it.
SIZES = (1, 16, 64, 48, 16, 64, 4, BUCKETS, BUCKETS, BUCKETS, BUCKETS, BUCKETS)
OFFSETS = np.concatenate(([0], np.cumsum(SIZES)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE, AT_ONCE + (1 << 16)), _powers(INVERSE, AT_ONCE + (1 << 16))


def _pieces(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """(where, bytes): the text cut before white space, about AT_ONCE bytes each."""
    at = 0
    while at < len(blob):
        end = min(len(blob), at + AT_ONCE)
        while end < len(blob) and KIND[blob[end]] != SPACE:
            end += 1
        yield at, blob[at:end]
        at = end


class Tokens:
    """The tokens of texts and what features need of each."""

    def __init__(self, blobs: list[bytes]) -> None:
        found: list[list[np.ndarray]] = []
        text, chunk, size = [], [], 0
        for i, blob in enumerate(blobs):
            for at, piece in _pieces(blob):
                if size and size + len(piece) > AT_ONCE:
                    found.append(self._find(text, chunk))
                    text, chunk, size = [], [], 0
                text.append((i, at))
                chunk.append(piece)
                size += len(piece) + 1
        if chunk:
            found.append(self._find(text, chunk))
        empty = [np.empty(0, np.int64)] * 5 + [np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 2
        self.doc, self.start, self.end, self.shape, self.gap, self.hash, self.changes, self.digits = (np.concatenate(c) for c in zip(empty, *found, strict=True))
        self.size = self.end - self.start
        self.file = self._file(blobs)

    @staticmethod
    def _find(text: list[tuple[int, int]], chunk: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"\n".join([*chunk, b""]), np.uint8)
        kind = KIND[data]
        change = np.flatnonzero(np.diff(kind) != 0) + 1
        starts = np.concatenate(([0], change))
        ends = np.concatenate((change, [len(data)]))
        real = kind[starts] != SPACE
        gap_before = np.concatenate(([True], ~real[:-1]))[real]
        starts, ends = starts[real], ends[real]
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        before = np.concatenate(([0], ends[:-1]))
        gap = np.where(lines[starts] > lines[before], 2, gap_before.astype(np.int64))
        shape = SHAPE[data]
        counts = {k: np.concatenate(([0], np.cumsum(shape == k, dtype=np.int32))) for k in (DIGIT, LOWER, UPPER, HIGH)}
        inside = {k: c[ends] - c[starts] for k, c in counts.items()}
        hexes = np.concatenate(([0], np.cumsum(IS_HEX[data], dtype=np.int32)))
        changed = np.concatenate(([0, 0], np.cumsum(np.diff(shape) != 0, dtype=np.int32)))
        mask = sum((inside[k] > 0).astype(np.int64) << k for k in inside)
        mask += ((hexes[ends] - hexes[starts]) == ends - starts).astype(np.int64) * 16 + (kind[starts] == MARK) * 32
        up, down = (UP, DOWN) if len(data) < len(UP) else (_powers(BASE, len(data) + 1), _powers(INVERSE, len(data) + 1))
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((LOWERED[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
            hashes = (total[ends] - total[starts]) * down[starts]
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(BASE)
        begins = np.concatenate(([0], np.cumsum([len(c) + 1 for c in chunk])))
        piece = np.searchsorted(begins, starts, side="right") - 1
        doc, shift = (np.array([t[i] for t in text])[piece] for i in (0, 1))
        gap[np.concatenate(([True], np.diff(doc) != 0))[: len(doc)]] = 3
        shift = shift - begins[piece]
        return [doc, starts + shift, ends + shift, mask, gap, hashes, (changed[ends] - changed[starts + 1]).astype(np.int64), inside[DIGIT].astype(np.int64)]

    def _file(self, blobs: list[bytes]) -> np.ndarray:
        """Of each text: how long it is, its share of digits and of long tokens."""
        size = np.array([len(b) for b in blobs])
        digits = np.bincount(self.doc, weights=self.digits, minlength=len(blobs)) / np.maximum(size, 1)
        long_ = np.bincount(self.doc, weights=self.size >= 16, minlength=len(blobs)) / np.maximum(np.bincount(self.doc, minlength=len(blobs)), 1)
        length = np.minimum(3, np.log2(size + 1).astype(np.int64) // 4)
        return length * 16 + np.searchsorted([0.01, 0.05, 0.2], digits) * 4 + np.searchsorted([0.005, 0.02, 0.1], long_)

    def features(self) -> np.ndarray:
        """(tokens, features) numbers of weights."""
        length = np.searchsorted(LENGTHS, self.size, side="right")
        words = (self.hash >> np.uint64(52)).astype(np.int64)

        def near(step: int) -> np.ndarray:
            out, n = np.zeros(len(words), np.int64), len(words) - abs(step)
            if n > 0:
                here, there = (slice(step, None), slice(None, n)) if step > 0 else (slice(None, n), slice(-step, None))
                out[here] = np.where(self.doc[here] == self.doc[there], words[there], 0)
            return out

        share = np.searchsorted([0.01, 0.2, 0.4, 0.6, 0.8, 0.99], self.digits / np.maximum(self.size, 1), side="right")
        columns = [
            np.zeros(len(words), np.int64),
            length,
            self.shape,
            np.minimum(self.changes, 11) * 4 + np.searchsorted([6, 12, 20], self.size),
            share * 2 + (self.size >= 12),
            self.file[self.doc],
            self.gap,
            np.where((self.digits == 0) & (self.size < 16), words, 0),
            near(1),
            near(2),
            near(3),
            near(-1),
        ]
        return np.stack([c + o for c, o in zip(columns, OFFSETS[:-1].tolist(), strict=True)], axis=1).astype(np.int32)


def base_spans(blob: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the secret itself begins) in bytes, sorted, of what the patterns find."""
    out = [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(blob)]
    if b"AKIA" in blob:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(blob)]
    low = blob.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(blob) if len(m[2]) >= ASSIGN_LEAST]
    return sorted(out)


def _tags(tokens: Tokens, i: int, spans: list[tuple[int, int, int, int]], at: slice) -> np.ndarray:
    """Tags of the i-th text's tokens: those of each secret itself, its first one the beginning."""
    tags = np.zeros(at.stop - at.start, np.int64)
    start, end = tokens.start[at], tokens.end[at]
    for _, _, stop, begin in spans:
        a, b = np.searchsorted(end, begin, side="right"), np.searchsorted(start, stop)
        tags[a:b] = np.where(tags[a:b] == OUTSIDE, INSIDE, tags[a:b])
        if a < b and (a == 0 or tags[a] == INSIDE and start[a] >= begin):
            tags[a] = BEGIN
    return tags


def _minimum(loss: Callable, at: np.ndarray, steps: int, kept: int = 8) -> np.ndarray:
    """Where a smooth convex function, given with its gradient, is least: limited-memory quasi-Newton steps with backtracking."""
    value, slope = loss(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, parts = slope.copy(), []
        for s, y in reversed(moves):
            parts.append((s @ way) / (s @ y))
            way -= parts[-1] * y
        if moves:
            way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1])
        for (s, y), a in zip(moves, reversed(parts), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        down, size = slope @ way, 1.0 if moves else 1.0 / max(1.0, float(np.abs(slope).sum()))
        while size > 1e-10:
            new, new_slope = loss(at - size * way)
            if new <= value - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        moves = [*moves, (-size * way, new_slope - slope)][-kept:] if (new_slope - slope) @ -way > 1e-12 else moves
        at, gain, value, slope = at - size * way, value - new, new, new_slope
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return at


class Field:
    """A linear-chain conditional random field over three tags; chains begin and end outside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    @classmethod
    def fit(cls, x: np.ndarray, tags: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Field:
        """x: (windows, width, features), -1 where a window has no token any more; tags: (windows, width)."""
        n, width, _ = x.shape
        there = x[:, :, 0] >= 0
        flat, gold, number = x[there], tags[there], int(OFFSETS[-1])
        seen = np.zeros((number + 3, 3))
        np.add.at(seen, (flat.ravel(), np.repeat(gold, flat.shape[1])), 1)
        last = np.where(there, tags, OUTSIDE)
        before = np.concatenate((np.zeros((n, 1), np.int64), last[:, :-1]), axis=1)
        np.add.at(seen, (number + before[there], gold), 1)

        def loss(params: np.ndarray) -> tuple[float, np.ndarray]:
            params = params.reshape(seen.shape)
            expected, total = cls._expected(params, flat, there, n, width, number)
            value = (total - (seen * params).sum()) / n + ridge / 2 * (params**2).sum()
            return value, ((expected - seen) / n + ridge * params).ravel()

        params = _minimum(loss, np.zeros(seen.size), steps).reshape(seen.shape)
        return cls(params[:number].astype(np.float32), params[number:])

    @staticmethod
    def _expected(params: np.ndarray, flat: np.ndarray, there: np.ndarray, n: int, width: int, number: int) -> tuple[np.ndarray, float]:
        """How often each feature goes with each tag, and each tag follows each, in expectation (forward and backward sums); the log of all paths' sum."""
        moves = np.exp(params[number:])
        score = np.zeros((n, width, 3))
        score[there] = params[flat].sum(axis=1)
        highest = score.max(axis=2)
        score = np.exp(score - highest[:, :, None])
        total = highest[there].sum()
        ahead, back = np.empty((n, width, 3)), np.ones((n, width, 3))
        now = np.tile([1.0, 0.0, 0.0], (n, 1))
        for t in range(width):
            ahead[:, t] = (now @ moves) * score[:, t]
            sums = ahead[:, t].sum(axis=1, keepdims=True)
            total += np.log(sums[there[:, t]]).sum()
            ahead[:, t] /= sums
            now = ahead[:, t]
        for t in range(width - 2, -1, -1):
            back[:, t] = np.where(there[:, t + 1 : t + 2], (back[:, t + 1] * score[:, t + 1]) @ moves.T, 1.0)
            back[:, t] /= back[:, t].sum(axis=1, keepdims=True)
        chance = ahead * back
        chance /= chance.sum(axis=2, keepdims=True)
        out = np.zeros_like(params)
        own = chance[there]
        for k in range(3):
            out[:number, k] = np.bincount(flat.ravel(), weights=np.repeat(own[:, k], flat.shape[1]), minlength=number)
        start = np.concatenate((np.tile([1.0, 0.0, 0.0], (n, 1, 1)), ahead[:, :-1]), axis=1)
        both = start[:, :, :, None] * moves * (score * back)[:, :, None, :]
        both /= both.sum(axis=(2, 3), keepdims=True)
        out[number:] = both[there].sum(axis=0)
        return out, float(total)

    def emissions(self, x: np.ndarray, caution: float) -> np.ndarray:
        out = np.zeros((len(x), 3), np.float32)
        for column in x.T:
            out += self.weights[column]
        out[:, OUTSIDE] += caution
        return out.astype(float)

    def decode(self, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best tags of the tokens of each document (numbers rise); exact."""
        tags = np.zeros(len(scores), np.int64)
        sure = scores[:, OUTSIDE] - scores[:, 1:].max(axis=1) > 2 * (self.moves.max() - self.moves.min())
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return tags
        heads = np.flatnonzero(np.concatenate(([True], (np.diff(open_) != 1) | (np.diff(doc[open_]) != 0))))
        first, length = open_[heads], np.diff(np.append(heads, len(open_)))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        best = np.full((len(first), 3), -np.inf)
        best[:, OUTSIDE] = 0
        came = np.zeros((len(open_), 3), np.int8)  # tokens of runs, step by step
        active = [int(np.searchsorted(-length, -s)) for s in range(int(length[0]) + 1)]  # runs that are longer than s
        at = np.concatenate(([0], np.cumsum(active)))
        for s in range(int(length[0])):
            n = active[s]
            paths = best[:n, :, None] + self.moves
            came[at[s] : at[s] + n] = paths.argmax(axis=1)
            best[:n] = paths.max(axis=1) + scores[first[:n] + s]
        now = (best + self.moves[:, OUTSIDE]).argmax(axis=1)
        for s in range(int(length[0]) - 1, -1, -1):
            n = active[s]
            tags[first[:n] + s] = now[:n]
            now[:n] = came[at[s] + np.arange(n), now[:n]]
        return tags

    def spans(self, tokens: Tokens, caution: float = CAUTION) -> list[tuple[int, int, int]]:
        """(number of the text, start, end) in bytes of the secrets that the field finds."""
        tags = self.decode(self.emissions(tokens.features(), caution), tokens.doc)
        held = np.flatnonzero(tags)
        if not len(held):
            return []
        new = np.concatenate(([True], (tags[held[1:]] == BEGIN) | (np.diff(held) != 1) | (np.diff(tokens.doc[held]) != 0)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(held)) - 1
        return list(zip(tokens.doc[held[first]].tolist(), tokens.start[held[first]].tolist(), tokens.end[held[last]].tolist(), strict=True))


def windows(docs: DataFrame) -> DataFrame:
    """(order, found, at, x, tags): windows of tokens about each text's first three secrets, or one of a text without any; docs has order and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blobs in documents_of(batch):
                tokens, out = Tokens(blobs), []
                x, begins = tokens.features(), np.searchsorted(tokens.doc, np.arange(len(blobs) + 1))
                for i, ((order,), blob) in enumerate(zip(rows, blobs, strict=True)):
                    a, b = begins[i : i + 2].tolist()
                    if a == b:
                        continue
                    tags = _tags(tokens, i, base_spans(blob), slice(a, b))
                    places = np.flatnonzero(tags == BEGIN)[:3].tolist()
                    for p in places or [order % (b - a)]:
                        low = max(0, min(p - WIDTH // 2, b - a - WIDTH))
                        high = min(b - a, low + WIDTH)
                        out.append((order, bool(places), low, x[a + low : a + high].ravel().tolist(), tags[low:high].tolist()))
                c = list(zip(*out, strict=True)) or [()] * 5
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types, strict=True)], names=["order", "found", "at", "x", "tags"])

    return docs.select("order", "text").mapInArrow(run, "order long, found boolean, at long, x array<int>, tags array<int>")


def fit(docs: DataFrame, looked_at: int = LOOKED_AT, most: int = WINDOWS) -> Field | None:
    """The field, fitted to at most `most` windows with a secret and as many without, from about looked_at documents with the smallest hashes; None where no secret is found."""
    rows = docs.where("length(text) > 0").select(F.xxhash64("text").alias("order"), "text")

    def smallest(part: float) -> Column:
        return F.col("order") <= min(2**63 - 1, int(-(2**63) + part * 2**64))

    part = min(1.0, looked_at / max(1, rows.count()))
    found, some = durable(windows(rows.where(smallest(part)))), []
    for kind in (True, False):
        all_ = found.where(F.col("found") == kind)
        # each task hands over its share of the smallest hashes, not as many as the sample
        some += all_.where(smallest(part * min(1.0, 1.5 * most / max(1, all_.count())))).orderBy("order", "at", "tags").limit(most).collect()
    if not any(r["found"] for r in some):
        return None
    x, tags = np.full((len(some), WIDTH, len(SIZES)), -1), np.zeros((len(some), WIDTH), np.int64)
    for i, r in enumerate(some):
        n = len(r["tags"])
        x[i, :n], tags[i, :n] = np.array(r["x"]).reshape(n, -1), r["tags"]
    return Field.fit(x, tags)


def _joined(blob: bytes, spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of (start, kind, end), in code points."""
    out, byte, point, ends = [], 0, 0, {}
    for at in sorted({p for start, _, end in spans for p in (start, end)}):
        point += len(blob[byte:at].decode()) if not blob[byte:at].isascii() else at - byte
        byte, ends[at] = at, point
    for start, kind, end in spans:
        out.append(f"{KINDS[kind]}:{ends[start]}:{ends[end]}")
    return ",".join(out)


def scan_secrets(docs: DataFrame, field: Field | None = None, caution: float = CAUTION) -> DataFrame:
    """Secrets of every text: doc_id, n_assign, n_access, n_hex, n_field, base_sha256, spans, and the secrets themselves.

    Patterns, leftmost without overlap, each kind for itself: assign (ASSIGN, letters in either case of ASCII, the value of at least 12
    characters), access (AKIA and at least 14 of A-Z0-9) and hex (at least 16 of 0-9a-f). A span is the whole match. The field (fitted to
    docs unless given) adds spans of the kind "field" that overlap none of these. spans joins "kind:start:end" by commas, in code points, end exclusive, sorted
    by start, then in the order assign, access, hex, field; base_sha256 is the digest of the same of the patterns alone. secrets holds the texts of spans.

    docs needs doc_id and text; other columns are ignored. Null texts count as empty and have no spans. Rows with a null or repeated doc_id
    are scanned each. Empty tables give empty results.
    """
    docs = docs.select("doc_id", "text")
    field = fit(docs) if field is None else field
    schema = docs.select("doc_id").schema
    for name in ("n_assign", "n_access", "n_hex", "n_field"):
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("secrets", ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, ids = 0, batch.column(0)
            for rows, blobs in documents_of(batch):
                base = [base_spans(b) for b in blobs]
                spans = [[s[:3] for s in b] for b in base]
                for i, start, end in field.spans(Tokens(blobs), caution) if field else ():
                    if not any(start < s[2] and s[0] < end for s in base[i]):
                        spans[i].append((start, 3, end))
                out = []
                for blob, b, s in zip(blobs, base, spans, strict=True):
                    s.sort()
                    counts = [sum(k == kind for _, kind, _ in s) for k in range(4)]
                    out.append((*counts, hashlib.sha256(_joined(blob, [x[:3] for x in b]).encode()).hexdigest(), _joined(blob, s), [blob[x:y].decode(errors="replace") for x, _, y in s]))
                c = list(zip(*out, strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(rows)), *[pa.array(v, t) for v, t in zip(c, types, strict=True)]], names=schema.fieldNames())
                done += len(rows)

    return docs.mapInArrow(run, schema)
