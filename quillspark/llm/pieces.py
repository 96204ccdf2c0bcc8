"""SentencePiece segmentations, sampled without replacement by Gumbel top-k, and decoding.

A text's segmentations are the paths of a lattice whose edges are the model's pieces; a path is as likely as the product of
its pieces' weights. White space cuts the lattice into units, so backward sums are made once for each distinct unit, and
a path is a row of decisions: at each node one edge.

Sampling is an A-star search over sets of paths "begin with these decisions, then decide otherwise". Each set's
key is the largest of the Gumbel-perturbed log-probabilities of its paths: drawn for the whole, and for the sets that
a set is split into drawn on condition that it isn't exceeded. The best key is always that of a complete path, so the first
k that leave the heap are k distinct segmentations, sampled without replacement; the next key is the threshold from which
inclusion scores follow. All draws come from a hash of the row's key, the sample and the place, so a row always
gets the same result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from quillspark.llm.text import documents_of
from quillspark.llm.windows import Rolling

U64 = np.uint64
SPACE = "▁"
UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Marks before which a unit ends too, if no piece of the model has one behind a letter.
MARKS = ".,;:!?"
#: A word with the white space before it.
WORD = re.compile(" +[^ ]*")
#: Edges of units, and words, that a task remembers.
REMEMBERED, WORDS = 6_000_000, 300_000
#: A probability that counts as none.
NONE = 1e-12
#: Log-weight of a byte of a character that no piece has.
BYTE = -12.0

SAMPLES = "doc_id long, sample int, n_pieces long, ids array<int>, log_prob double, perturbed double, inclusion double"


def _chars(text: str) -> np.ndarray:
    """A hash for each code point."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64) + U64(1)
    x *= U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(29))


#: Low bits of a piece's hash that a first look goes by.
LOOK = U64((1 << 18) - 1)


class Pieces:
    """The model's pieces: ids, weights and bytes. A piece of rank r weighs (r + 2) ** -theta."""

    def __init__(self, path: str, theta: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(x[3:5], 16): i for i, x in enumerate(names) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.weight = {names[i]: (i, -theta * float(np.log(rank + 2))) for rank, i in enumerate(plain)}
        marks = "".join(m for m in MARKS if not any(a.isalpha() and b == m for x in self.weight for a, b in zip(x, x[1:], strict=False)))
        if marks:  # no path crosses from a letter to such a mark, so the lattice may be cut there
            inner = f"(?:[^{SPACE}\n{marks}]+|(?<![^\\W\\d_])[{marks}])"
            self.units = re.compile(f"{SPACE}*(?:[^{SPACE}\n{marks}]+(?:(?<![^\\W\\d_])[{marks}]{inner}*)?|[{marks}]{inner}*)|{SPACE}+|\n")
        else:
            self.units = UNITS
        self.by_length = {}  # hashes of the pieces of each length in order, with their ids and weights
        for n_chars in sorted({len(x) for x in self.weight}):
            some = [x for x in self.weight if len(x) == n_chars]
            h = Rolling(_chars("".join(some))).grams(n_chars)[::n_chars]
            order = np.argsort(h)
            ids, weights = (np.array([self.weight[some[i]][f] for i in order]) for f in (0, 1))
            look = np.zeros(int(LOOK) + 1, bool)
            look[h & LOOK] = True
            self.by_length[n_chars] = look, h[order], ids, weights
        self.bytes = [names[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.byte_id.items():
            self.bytes[i] = bytes([b])
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                self.bytes[i] = b""

    def decode(self, ids) -> bytes:
        joined = b"".join(map(self.bytes.__getitem__, ids))
        return joined[1:] if joined.startswith(b" ") else joined

    def decoded(self, ids: np.ndarray, ends: list[int]) -> Iterator[memoryview]:
        """What decode gives for the ids up to each end, from the end before it."""
        if not hasattr(self, "table"):
            self.table = pa.array(self.bytes, pa.large_binary())
        taken = self.table.take(pa.array(ids))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[[0, *ends]].tolist() if len(ids) else [0] * (len(ends) + 1)
        view = memoryview(data) if data is not None else memoryview(b"")
        for a, b in pairwise(at):
            yield view[a + (a < b and view[a] == 32) : b]


class _Column:
    """An array that grows at its end, with room to spare."""

    def __init__(self, kind: type) -> None:
        self.room, self.n = np.empty(1 << 16, kind), 0

    def extend(self, more: np.ndarray) -> np.ndarray:
        """All so far."""
        n = self.n + len(more)
        if n > len(self.room):
            room = np.empty(max(n, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = more
        self.n = n
        return self.room[:n]


class _Numbers(dict):
    """Numbers of words in the order in which they were first asked for; fresh: words since the last look."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Lattices:
    """Units met so far, as one table of nodes and edges, and words met so far as runs of units.

    Edges of a node stand together; share has their cumulated probability: a draw takes the first edge beyond it. log_p has an
    edge's log-probability at its node; to the node that it leads to, -1 at the unit's end; one its id, -1 if it is several bytes, whose ids many has.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.many: dict[int, np.ndarray] = {}
        kinds = {"share": np.float32, "log_p": float, "to": np.int32, "node_of": np.int32, "one": np.int32, "begin": np.int32}
        self.columns = {name: _Column(kind) for name, kind in kinds.items()}
        self._extend(**{name: np.empty(0, kind) for name, kind in kinds.items()})
        self._extend(begin=np.zeros(1, np.int64))
        self._forget_words()

    def _forget_words(self) -> None:
        self.number, self.word_columns = _Numbers(), (_Column(np.int32), _Column(np.int32))
        self.word_ends, self.word_roots = (c.extend(np.zeros(n, np.int64)) for c, n in zip(self.word_columns, (1, 0), strict=True))

    def roots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Roots of all units of all texts, and where each text's begin (one entry more than texts)."""
        if len(self.share) > REMEMBERED:
            self.clear()
        if len(self.number) > WORDS:
            self._forget_words()
        words, n_words = _words(texts)
        numbers = np.fromiter(map(self.number.__getitem__, words.dictionary.to_pylist()), np.int64)[words.indices.to_numpy()]
        if self.number.fresh:
            units = [[SPACE + w] if w.isalpha() else self.pieces.units.findall(SPACE + w.replace(" ", SPACE)) for w in self.number.fresh]
            self.number.fresh = []
            self.add(set().union(*units))
            ends = int(self.word_ends[-1]) + np.cumsum([len(u) for u in units])
            found = np.fromiter(map(self.root.__getitem__, chain.from_iterable(units)), np.int64)
            self.word_ends, self.word_roots = (c.extend(x) for c, x in zip(self.word_columns, (ends, found), strict=True))
        starts = self.word_ends[numbers].astype(np.int64)
        sizes = self.word_ends[numbers + 1] - starts
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return self.word_roots[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])].astype(np.int64), upto[np.concatenate(([0], np.cumsum(n_words)))]

    def _extend(self, **more: np.ndarray) -> None:
        for name, x in more.items():
            setattr(self, name, self.columns[name].extend(x))

    def add(self, units: set[str]) -> None:
        new = [u for u in units if u not in self.root]
        if not new:
            return
        nodes, edges = len(self.begin) - 1, len(self.share)
        text = "".join(new)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(sizes)
        self.root.update(zip(new, (nodes + ends - sizes).tolist(), strict=True))
        rest = np.repeat(ends, sizes) - np.arange(len(text))  # characters up to the unit's end
        at, length, piece, weight = self._edges(text, rest)  # by length
        order = np.argsort(at, kind="stable")
        at, length, piece, weight = at[order], length[order], piece[order], weight[order]
        # backward sums, nodes with one character left first
        left = rest[at]
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        a, to, w = at[order], at[order] + length[order], weight[order]
        new_node = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        level = rest[a[new_node]]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(level)) + 1, [len(level)]))
        bounds = np.append(new_node, len(a))
        after = np.zeros(len(text) + 1)
        inner = length[order] < rest[a]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = bounds[i], bounds[j]
            score = w[lo:hi] + np.where(inner[lo:hi], after[np.minimum(to[lo:hi], len(text))], 0.0)
            starts = bounds[i:j] - lo
            top = np.maximum.reduceat(score, starts)
            total = np.add.reduceat(np.exp(score - np.repeat(top, np.diff(np.append(starts, hi - lo)))), starts)
            after[a[bounds[i:j]]] = top + np.log(total)
        inner = length < left
        log_p = np.minimum(0.0, weight + np.where(inner, after[np.minimum(at + length, len(text))], 0.0) - after[at])
        n_edges = np.bincount(at, minlength=len(text))
        first = np.cumsum(n_edges) - n_edges
        mass = np.cumsum(np.exp(log_p))
        share = mass - np.repeat(np.concatenate(([0.0], mass))[first], n_edges)
        share[first + n_edges - 1] = 1.0
        raw = np.flatnonzero(piece < 0)
        one = piece.astype(np.int32)
        for e, i in zip(raw.tolist(), at[raw].tolist(), strict=True):
            ids = [self.pieces.byte_id[b] for b in text[i].encode()]
            if len(ids) == 1:
                one[e] = ids[0]
            else:
                self.many[edges + e] = np.array(ids, np.int32)
        self._extend(
            log_p=log_p,
            share=np.minimum(share, 1.0),
            to=np.where(inner, nodes + at + length, -1),
            node_of=nodes + at,
            one=one,
            begin=edges + first + n_edges,  # of the node after each
        )

    def _edges(self, text: str, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece, weight) of every piece in every unit, by length and place.

        Piece -1: a character's bytes, where no piece is that character.
        """
        rolling, found = Rolling(_chars(text)), []
        bare = np.ones(len(text), bool)
        for n, (look, hashes, ids, weights) in self.pieces.by_length.items():
            places = np.flatnonzero(rest >= n)
            if not len(places):
                continue
            h = rolling.at(places, n)
            maybe = look[h & LOOK]
            places, h = places[maybe], h[maybe]
            where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[where] == h
            places, where = places[hit], where[hit]
            found.append((places, np.full(len(places), n), ids[where], weights[where]))
            if n == 1:
                bare[places] = False
        places = np.flatnonzero(bare)
        sizes = np.array([len(text[i].encode()) for i in places.tolist()], np.int64)
        found.insert(0, (places, np.ones(len(places), np.int64), np.full(len(places), -1), BYTE * sizes))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def ids(self, path: np.ndarray) -> np.ndarray:
        """Ids of the edges of a path."""
        ids = self.one[path]
        if len(ids) and ids.min() < 0:
            ids = np.concatenate([self.many[e] if i < 0 else [i] for e, i in zip(path.tolist(), ids.tolist(), strict=True)]).astype(np.int32)
        return ids

    def paths(self, roots: np.ndarray, keys: np.ndarray, where: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """A path through each unit: all edges, where each unit's begin (one entry more than units), the edges' odds, and their units.

        Odds, a row each: the log-probability at the edge's node, and that of all other edges there together. where: the order of roots, if it is known.
        """
        if where is None:
            where = np.argsort(roots, kind="stable")  # neighbours search the same part of the table
        node = roots[where]
        chosen, owners, step = [], [], 0
        while len(node):
            edge, last = self.begin[node], self.begin[node + 1] - 1
            drawn = uniform(keys[where], step)
            on = np.flatnonzero((edge < last) & (self.share[edge] <= drawn))
            while len(on):  # a node has few edges: go on where the draw lies beyond
                e = edge[on] + 1
                edge[on] = e
                on = on[(e < last[on]) & (self.share[e] <= drawn[on])]
            chosen.append(edge)
            owners.append(where)
            node = self.to[edge]
            live = node >= 0
            node, where, step = node[live], where[live], step + 1
        sizes = np.zeros(len(roots), np.int64)
        for w in owners:
            sizes[w] += 1
        starts = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(starts[-1], np.int64)
        for s, (w, e) in enumerate(zip(owners, chosen, strict=True)):
            out[starts[w] + s] = e
        return out, starts, self.odds(out), np.repeat(np.arange(len(roots)), sizes)

    def odds(self, path: np.ndarray) -> np.ndarray:
        log_p = self.log_p[path]
        others = -np.expm1(log_p)
        return np.array((log_p, np.log(others, out=np.full(len(others), -np.inf), where=others > NONE)))


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from keys and a step."""
    x = keys + U64((step * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def _units(text: str, pattern: re.Pattern = UNITS) -> list[str]:
    return pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []


def _words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, whose units put together are the texts', and how many each text has; white space before a word but for one space belongs to it."""
    plain = np.array([t != "" and t[0] != " " and "  " not in t and SPACE not in t for t in texts], bool)
    split = pc.split_pattern(pa.array([texts[i] for i in np.flatnonzero(plain)], pa.string()), " ")
    others = [[w[1:] for w in WORD.findall(" " + texts[i].replace(SPACE, " "))] if texts[i] else [] for i in np.flatnonzero(~plain)]
    n_words = np.empty(len(texts), np.int64)
    n_words[plain], n_words[~plain] = split.value_lengths(), list(map(len, others))
    words = pa.concat_arrays([split.flatten(), pa.array(chain.from_iterable(others), pa.string())])
    if others:  # back to the order of texts
        order = np.argsort(~plain, kind="stable")
        begin = np.empty(len(texts), np.int64)
        begin[order] = np.cumsum(n_words[order]) - n_words[order]
        words = words.take(pa.array(np.repeat(begin - np.cumsum(n_words) + n_words, n_words) + np.arange(len(words))))
    return words.dictionary_encode(), n_words


def _segmentations(lat: Lattices, node_of: np.ndarray, drawn: list[tuple[np.ndarray, ...]], span: tuple[int, int], key: int, k: int) -> list[tuple[np.ndarray, float, float]]:
    """(edges, log-probability, perturbed) of up to k + 1 segmentations of a document, best perturbed first.

    drawn: for each sample fresh paths through all units of the batch; span: the units of the document.
    """
    a, b = span
    if a == b:
        return [(np.empty(0, np.int64), 0.0, 0.0)]
    rng = np.random.Generator(np.random.Philox(key=key))
    count = 0
    heap: list = [(float(np.log(rng.standard_exponential())), 0, None)]
    out = []
    while heap and len(out) <= k:
        minus, _, what = heapq.heappop(heap)
        g = -minus
        r = len(out)
        if r == k:  # only its key is wanted
            out.append((np.empty(0, np.int64), 0.0, g))
            break
        edges, starts, odds_of, unit_of = drawn[r]
        if what is None:
            path, odds, units, at, barred = edges[starts[a] : starts[b]], odds_of[:, starts[a] : starts[b]], unit_of[starts[a] : starts[b]], 0, frozenset()
        else:
            before, odds_before, units_before, at, barred = what
            node, unit = node_of[before[at]], int(units_before[at])
            rest = [e for e in range(int(lat.begin[node]), int(lat.begin[node + 1])) if e not in barred]
            likely = np.cumsum(np.exp(lat.log_p[rest]))
            e = rest[min(int(np.searchsorted(likely, rng.random() * likely[-1], "right")), len(rest) - 1)]
            tail = [e]
            while (node := int(lat.to[e])) >= 0:
                lo, hi = int(lat.begin[node]), int(lat.begin[node + 1])
                e = min(int(np.searchsorted(lat.share[lo:hi], rng.random(), "right")) + lo, hi - 1)
                tail.append(e)
            after = slice(starts[unit + 1], starts[b])
            path = np.concatenate((before[:at], tail, edges[after]))
            odds = np.concatenate((odds_before[:, :at], lat.odds(np.array(tail)), odds_of[:, after]), axis=1)
            units = np.concatenate((units_before[:at], np.full(len(tail), unit), unit_of[after]))
        log_p, left = odds
        upto = np.cumsum(log_p)
        out.append((path, float(upto[-1]), g))
        # what is left of the set: the same beginning, then another decision
        left = left[at:]
        if barred:
            left = left.copy()
            others = float(-np.expm1(log_p[at]) - np.exp(lat.log_p[list(barred)]).sum())
            left[0] = np.log(others) if others > NONE else -np.inf
        fresh = upto[at:] - log_p[at:] + left - np.log(rng.standard_exponential(len(left)))  # Gumbel about its log-probability
        want = k + 1 - len(out)
        if want == 1:
            best = np.array([fresh.argmax()])
        else:
            best = np.argpartition(-fresh, want - 1)[:want] if len(fresh) > want else np.arange(len(fresh))
        best = best[fresh[best] > -np.inf]
        keys = -np.logaddexp(-g, -fresh[best])
        for i, key_of in zip(best.tolist(), keys.tolist(), strict=True):
            count += 1
            place = at + i
            heapq.heappush(heap, (-key_of, count, (path, odds, units, place, (barred if i == 0 else frozenset()) | {int(path[place])})))
    return out


_loaded: dict[tuple, Lattices] = {}


@cache
def _pieces(path: str, theta: float = 1.0) -> Pieces:
    """A model's pieces, once a task's process."""
    return Pieces(path, theta)


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, theta: float = 1.0, seed: int = 0) -> DataFrame:
    """k distinct segmentations of every text, sampled without replacement.

    docs needs doc_id (integer) and text; other columns are ignored. model_path: a SentencePiece model whose pieces have
    white space at their beginning only. A segmentation is drawn in proportion to the product of its pieces' weights,
    (rank + 2) ** -theta. Characters that no piece has are bytes.

    Returns rows doc_id, sample (from 1, by falling perturbed log-probability), n_pieces, ids, log_prob, perturbed and
    inclusion: the probability that a segmentation is among the k, given the threshold; weights 1 / inclusion
    make sums over the sample unbiased. Texts with fewer than k segmentations have all of them, with inclusion 1. Null and
    empty texts have one, without pieces. Rows with the same doc_id and text get equal results; a null doc_id counts as 0. Empty
    tables give empty results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model_path, theta) not in _loaded:
            _loaded[model_path, theta] = Lattices(_pieces(model_path, theta))
        lat = _loaded[model_path, theta]
        for batch in batches:
            for rows, blobs in documents_of(batch):
                roots, first = lat.roots([b.decode() for b in blobs])
                sizes = np.diff(first)
                own = np.array([((r[0] or 0) * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F + xxh3_64_intdigest(b)) % (1 << 64) for r, b in zip(rows, blobs, strict=True)], U64)
                places = (np.arange(first[-1]) - np.repeat(first[:-1], sizes)).astype(U64)
                keys = np.repeat(own, sizes) + places * U64(0xD1B54A32D192ED03)
                order = np.argsort(roots, kind="stable")
                drawn = [lat.paths(roots, keys ^ U64(0xA0761D6478BD642F * (r + 1) % (1 << 64)), order) for r in range(k)]
                out = []
                for d, row in enumerate(rows):
                    found = _segmentations(lat, lat.node_of, drawn, (int(first[d]), int(first[d + 1])), int(own[d]), k)
                    threshold = found[k][2] if len(found) > k else -np.inf
                    for s, (path, lp, g) in enumerate(found[:k]):
                        ids = lat.ids(path)
                        inclusion = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(lp - threshold)))
                        out.append((row[0], s + 1, len(ids), ids, lp, g, inclusion))
                c = list(zip(*out, strict=True))
                offsets = np.concatenate(([0], np.cumsum(c[2])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(c[3]), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), lists, *(pa.array(x, pa.float64()) for x in c[4:])],
                    names=[f.split()[0] for f in SAMPLES.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SAMPLES)


def decode_pieces(encoded: DataFrame, model_path: str, digest_only: bool = False) -> DataFrame:
    """encoded with its ids column (array of int; null: no pieces) turned into text; digest_only: into ids_crc32 and text_crc32."""
    from pyspark.sql import functions as F

    others = [c for c in encoded.columns if c not in ("ids", "text", "ids_crc32", "text_crc32")]
    made = "ids_crc32 long, text_crc32 long" if digest_only else "text string"
    schema = encoded.select(*others).schema
    for field in made.split(", "):
        schema = schema.add(*field.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model_path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
            ids, ends = np.array(lists.flatten(), np.int64), np.cumsum(sizes).tolist()
            texts = pieces.decoded(ids, ends)
            if digest_only:
                raw = memoryview(ids.astype("<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise([0, *ends])]
                new = [pa.array(crcs, pa.int64()), pa.array(map(zlib.crc32, texts), pa.int64())]
            else:
                new = [pa.array([str(t, "utf-8", "replace") for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.fieldNames())

    return encoded.select(*others, F.col("ids")).mapInArrow(run, schema)
