"""N-gram Jaccard join with prefix trees.

1. One pass makes each document's set of n-gram hashes, the set's digest, and a sketch of
   fixed size that counts in how many documents the hashes of each cell occur. The order of all n-grams is
   (sketched count, hash): rare first, the same everywhere, whatever the sketch's error.
2. Sets that are similar enough share an n-gram in their prefixes. Each document's prefix is one row for each
   n-gram; those that no other set of a like size has are dropped. What meets at an n-gram is linked: at n-grams of few sets (counted exactly) only
   where the sets' parity sketches allow the similarity (they bound the sets' difference from below, so no link is lost), at others
   as stars about the smallest set of a like size. The components are the candidate groups.
3. Full sets travel once, to the task of their group. There they are stored in a prefix tree, most shared n-gram
   first, so that common beginnings are stored and intersected once; a walk with each set adds up its overlap and
   leaves a subtree as soon as the remaining lengths can't reach the threshold, or if all below
   is linked with it already.
4. Groups of more than BLOCK sets are split. All members are compared with one pivot in blocks; those that link with it
   need no comparison among themselves. The others meet all members, block against block.

Every comparison is of full sets, so links are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quillspark.llm.graph import components
from quillspark.llm.text import documents_of, shingle_sets
from quillspark.session import durable, sized, together

#: log2 of the sketch's cells, and cells that travel in a row: the sketch is 4 MB however large the input is.
CELLS, TOGETHER = 20, 1024
#: An n-gram comes last in the order, and its rows are spread, if its cell counts more than HOT documents and more than 8 times the mean cell;
#: at an n-gram of at most FEW sets they are compared by sketch, else they make stars.
HOT, FEW = 1000, 64
#: Sets that a prefix tree of a split group holds; n-grams of small groups that one task call gets, about.
BLOCK, CALL = 512, 1 << 20


def least_overlap(a: int, b: int, percent: int) -> float:
    """The overlap that sets of a and b members need."""
    return percent * (a + b) / (100 + percent)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


class _Node:
    __slots__ = ("below", "ends", "label", "last", "longest", "shortest", "steps")

    def __init__(self, steps: np.ndarray) -> None:
        self.steps, self.last = steps, int(steps[-1]) if len(steps) else -1
        self.below: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.shortest, self.longest, self.label = 1 << 60, 0, -2


class PrefixTree:
    """Sets as paths of n-gram ranks in ascending order; a node holds a run of ranks without a branch.

    label of a node: the common label of all sets below, -1 if they differ.
    """

    def __init__(self, size: int, percent: int) -> None:
        self.root, self.percent = _Node(np.empty(0, np.int64)), percent
        self.has = np.zeros(size, bool)

    def add(self, number: int, path: np.ndarray, label: int) -> None:
        node, at, n = self.root, 0, len(path)
        self._pass(node, n, label)
        while at < n:
            child = node.below.get(int(path[at]))
            if child is None:
                child = node.below[int(path[at])] = _Node(path[at:])
                at = n
            else:
                both = min(len(child.steps), n - at)
                differ = np.flatnonzero(child.steps[:both] != path[at : at + both])
                same = int(differ[0]) if len(differ) else both
                if same < len(child.steps):
                    upper = _Node(child.steps[:same])
                    upper.shortest, upper.longest, upper.label = child.shortest, child.longest, child.label
                    child.steps = child.steps[same:]
                    upper.below[int(child.steps[0])] = child
                    node.below[int(path[at])] = child = upper
                at += same
            self._pass(child, n, label)
            node = child
        node.ends.append(number)

    @staticmethod
    def _pass(node: _Node, n: int, label: int) -> None:
        node.shortest, node.longest = min(node.shortest, n), max(node.longest, n)
        node.label = label if node.label in (-2, label) else -1

    def walk(self, path: np.ndarray, linked) -> Iterator[int]:
        """The sets that are similar enough to path; linked(label or None, number or None) tells what needn't be looked at."""
        n, t = len(path), self.percent
        self.has[path] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if t * n > 100 * node.longest or t * node.shortest > 100 * n or (node.label >= 0 and linked(node.label)):
                continue
            overlap += int(np.count_nonzero(self.has[node.steps]))
            depth += len(node.steps)
            rest = n - int(np.searchsorted(path, node.last, "right"))
            best = min(max(depth + rest, node.shortest), node.longest)  # the length for which most is possible
            if overlap + min(best - depth, rest) < least_overlap(n, best, t) - 1e-9:
                continue
            if 100 * overlap >= t * (n + depth - overlap):
                yield from node.ends
            stack.extend((child, overlap, depth) for child in node.below.values())
        self.has[path] = False


class _Links:
    """Union-find over the sets of one call."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def linked_pairs(ids: np.ndarray, sets: list[np.ndarray], stored: np.ndarray, asking: np.ndarray, same: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets asking and sets stored that join what wasn't joined before: a forest with the same components as all links.

    same: sets that are equal in it (1 and up) are known to be linked already; 0 for none.
    """
    number = {int(i): k for k, i in reversed(list(enumerate(ids)))}
    first = [number[int(i)] for i in ids]
    links = _Links(len(ids))
    heads: dict[int, int] = {}
    for k, s in enumerate(same.tolist()):
        if s:
            a, b = links.find(first[k]), links.find(heads.setdefault(s, first[k]))
            links.up[max(a, b)] = min(a, b)
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(tokens))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    paths = [np.sort(p) for p in np.split(rank[inverse], cuts)]
    tree = PrefixTree(len(tokens), percent)
    both = bool(np.all(stored & asking))  # then each set asks for those stored before it
    out = []

    def ask(k: int) -> None:
        for other in list(tree.walk(paths[k], lambda label: links.find(label) == links.find(first[k]))):
            a, b = links.find(first[k]), links.find(other)
            if a != b:
                links.up[max(a, b)] = min(a, b)
                out.append((int(ids[k]), int(ids[other])))

    for k in range(len(ids)):
        if both:
            ask(k)
        if stored[k]:
            tree.add(first[k], paths[k], links.find(first[k]))
    if not both:
        for k in np.flatnonzero(asking).tolist():
            ask(k)
    return out


def parity_bits(grams: np.ndarray) -> bytes:
    """For each of a power of two of cells (at least half as many as grams) whether it has an odd number of grams.

    Two sets differ in at least as many members as their sketches differ in bits.
    """
    size = max(128, 1 << (len(grams) - 1).bit_length() >> 1)
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: int, size: int, to: int) -> int:
    """A parity sketch of size cells as one of fewer."""
    while size > to:
        size >>= 1
        bits = (bits >> size) ^ (bits & ((1 << size) - 1))
    return bits


def _sets_and_sketch(texts: DataFrame, words: int, lower: bool) -> DataFrame:
    """(doc_id, copy, n, set_id, bits) of each document, and (cell, counts) of each task's sketch of frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "copy", "n", "set_id", "bits", "cell", "counts"]
        sketch = np.zeros(1 << CELLS, np.uint32)
        for batch in batches:
            for rows, blobs in documents_of(batch):
                sets = shingle_sets([b.lower() for b in blobs] if lower else blobs, words)
                if any(map(len, sets)):
                    sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELLS)).astype(np.int64), minlength=1 << CELLS).astype(np.uint32)
                digests = [xxh3_64_intdigest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d if d is None else d - (1 << 63) for d in digests], pa.int64()),
                        pa.array([parity_bits(s) if len(s) else None for s in sets], pa.binary()),
                        pa.nulls(len(rows), pa.int32()),
                        pa.nulls(len(rows), pa.binary()),
                    ],
                    names=names,
                )
        parts = sketch.reshape(-1, TOGETHER)
        some = np.flatnonzero(parts.any(axis=1))
        nothing = pa.nulls(len(some), pa.int64())
        packed = [zlib.compress(parts[i].tobytes(), 1) for i in some.tolist()]
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return texts.select("doc_id", "copy", "text").mapInArrow(run, "doc_id long, copy long, n long, set_id long, bits binary, cell int, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sketch of all tasks together: 1 << CELLS counts, whatever the input."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(TOGETHER, np.uint64)
        for c in part["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    out = np.zeros(1 << CELLS, np.uint32)
    for r in rows.where("cell IS NOT NULL").select("cell", "counts").groupBy("cell").applyInPandas(add, "cell int, counts binary").collect():
        out[r["cell"] * TOGETHER : (r["cell"] + 1) * TOGETHER] = np.frombuffer(r["counts"], np.uint32)
    return out


def _prefixes(texts: DataFrame, words: int, lower: bool, percent: int, sketch, hot: float) -> DataFrame:
    """(token, set_id, n, hot): the prefix of each set in the common order, and the set's size; copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for batch in batches:
            for _, blobs in documents_of(batch):
                tokens, ids, sizes, often = [], [], [], []
                for s in shingle_sets([b.lower() for b in blobs] if lower else blobs, words):
                    if not len(s):
                        continue
                    digest = xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                    if digest in seen:
                        continue
                    if len(seen) < 100_000:
                        seen.add(digest)
                    found = counts[(s >> np.uint64(64 - CELLS)).astype(np.int64)]
                    order = np.argsort(found, kind="stable")[: prefix_length(len(s), percent)]
                    tokens.append(s[order])
                    ids.append(np.full(len(order), digest, np.int64))
                    sizes.append(np.full(len(order), len(s), np.int32))
                    often.append(found[order] > hot)
                if tokens:
                    columns = [np.concatenate(tokens).view(np.int64), *map(np.concatenate, (ids, sizes, often))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "set_id", "n", "hot"])

    return texts.select("text").mapInArrow(run, "token long, set_id long, n int, hot boolean")


def _shared(prefixes: DataFrame, percent: int) -> DataFrame:
    """(token, set_id, n) without rows whose token no other set of a like size has.

    Tokens come with rising sizes, so a set's neighbours are nearest in size; they are seen in order, a row at a time. Frequent tokens are
    spread over tasks and pass.
    """
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("set_id"), F.lit(64))).otherwise(F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row, and whether it has been passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            token, ids, n, hot = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if last is not None:
                token, ids, n, hot = np.append(last[0], token), np.append(last[1], ids), np.append(last[2], n), np.append(last[3], hot)
            new = np.append(True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1]))
            token, ids, n, hot = token[new], ids[new], n[new].astype(np.int64), hot[new].astype(bool)
            like = np.append(False, (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            passed = np.zeros(len(token), bool)
            passed[0] = last is not None and last[4]
            keep = (like | np.append(like[1:], False) | hot) & ~passed
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(ids[keep]), pa.array(n[keep])], names=["token", "set_id", "n"])
            last = (token[-1], ids[-1], n[-1], hot[-1], bool(keep[-1] or passed[-1]))

    return prefixes.repartition("token", spread).sortWithinPartitions("token", "n", "set_id").mapInArrow(run, "token long, set_id long, n long")


def _bands(n: Column, percent: int) -> Column:
    """Two classes of size of a set; sets of sizes that allow the similarity have one in common."""
    band = F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent) * 1.000001))
    return F.array(band, band + 1)


def _links_by_sketch(rare: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest over the sets that meet at a token of few sets and may be similar; edges may repeat."""
    rows = rare.join(sets, "set_id").select("token", "set_id", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, met, out = None, [], []

        def compare() -> None:
            up = list(range(len(met)))
            for j in range(1, len(met)):
                b, n, bits = met[j]
                for i in range(j):
                    a, m, other = met[i]
                    x, y = i, j
                    while up[x] != x:
                        x = up[x]
                    while up[y] != y:
                        y = up[y]
                    if x == y or 100 * min(m, n) < percent * max(m, n):
                        continue
                    size = min(len(bits), len(other))
                    differ = folded(int.from_bytes(bits, "little"), 8 * len(bits), 8 * size) ^ folded(int.from_bytes(other, "little"), 8 * len(other), 8 * size)
                    if differ.bit_count() * (100 + percent) <= (100 - percent) * (m + n):
                        up[y] = x
                        out.append((b, a))

        def edges() -> pa.RecordBatch:
            c = list(zip(*out, strict=True)) or [(), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["a", "b"])

        for batch in batches:
            for token, set_id, n, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if token != key:
                    compare()
                    key = token
                    met.clear()
                met.append((set_id, n, bits))
            if out:
                yield edges()
        compare()
        yield edges()

    return rows.repartition("token").sortWithinPartitions("token", "set_id").mapInArrow(run, "a long, b long")


def _stars(often: DataFrame, percent: int) -> DataFrame:
    """(a, b): stars of the sets that meet at a token and have like sizes; edges may repeat."""
    rows = often.select("token", F.explode(_bands(F.col("n"), percent)).alias("band"), "set_id")
    centers = durable(rows.groupBy("token", "band").agg(F.min("set_id").alias("b"), F.max("set_id").alias("_last")).where("b != _last").select("token", "band", "b"))
    return rows.join(centers, ["token", "band"]).where("set_id != b").select(F.col("set_id").alias("a"), "b")


def _full_sets(texts: DataFrame, words: int, lower: bool) -> DataFrame:
    """Rows with the n-gram hashes of the set in place of the text; rows that repeat within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows, blobs in documents_of(batch):
                new = [i for i, r in enumerate(rows) if not (r[0] in seen or seen.add(r[0]))]
                blobs = [blobs[i].lower() if lower else blobs[i] for i in new]
                c = list(zip(*[(*rows[i], s.tobytes()) for i, s in zip(new, shingle_sets(blobs, words), strict=True)], strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.binary())], names=["set_id", "comp", "members", "pivot", "grams"])

    return texts.mapInArrow(run, "set_id long, comp long, members long, pivot long, grams binary")


def _arrays(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(g, np.uint64) for g in rows["grams"]]


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, dtype="int64")


def _small_groups(sets: DataFrame, percent: int, grams: int) -> DataFrame:
    """Links within groups of at most BLOCK sets, which have so many n-grams in all; several groups in a call."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = []
        for _, group in rows.groupby("comp", sort=False):
            every = np.ones(len(group), bool)
            pairs += linked_pairs(group["set_id"].to_numpy(), _arrays(group), every, every, np.zeros(len(group), np.int64), percent)
        return _frame(pairs)

    calls = max(1, -(-grams // CALL))
    return sets.select(F.pmod(F.xxhash64("comp"), F.lit(calls)).alias("call"), "comp", "set_id", "grams").groupBy("call").applyInPandas(run, "a long, b long")


def _spread(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts)


def _large_groups(sets: DataFrame, percent: int) -> DataFrame:
    """Links within groups of more sets: a pivot's star, then those outside it against all, in blocks."""
    parts = F.ceil(F.col("members") / BLOCK)
    rows = sets.withColumn("part", _spread("set_id", parts))
    asked = sets.where("set_id = pivot").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    asked = asked.select("comp", "part", "set_id", "grams", F.lit(True).alias("is_pivot"))
    rows = rows.select("comp", "part", "set_id", "grams", F.lit(False).alias("is_pivot")).unionByName(asked)

    def star(rows: pd.DataFrame) -> pd.DataFrame:
        is_pivot = rows["is_pivot"].to_numpy()
        center = np.frombuffer(rows.loc[is_pivot, "grams"].iloc[0], np.uint64)
        found = []
        for g in _arrays(rows):
            place = np.searchsorted(center, g)
            place[place == len(center)] = 0
            both = int(np.count_nonzero(center[place] == g))
            found.append(100 * both >= percent * (len(center) + len(g) - both))
        out = pd.DataFrame({"comp": rows["comp"], "set_id": rows["set_id"], "pivot": rows.loc[is_pivot, "set_id"].iloc[0], "linked": found})
        return out[~is_pivot]

    stars = together(rows.groupBy("comp", "part").applyInPandas(star, "comp long, set_id long, pivot long, linked boolean"))
    outside = stars.groupBy("comp").agg(F.count_if(~F.col("linked")).alias("outside")).where("outside > 0")
    inside = sets.drop("pivot").join(sized(stars.join(outside, "comp").drop("comp").distinct()), "set_id")
    asks, holds = F.ceil(F.col("outside") / BLOCK), F.ceil(F.col("members") / BLOCK)
    columns = ["comp", "i", "j", "set_id", "grams", "pivot", "linked", "asking"]
    left = inside.where(~F.col("linked")).withColumn("i", _spread("set_id", asks)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), holds - 1))).withColumn("asking", F.lit(True))
    right = inside.withColumn("j", _spread("set_id", holds)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), asks - 1))).withColumn("asking", F.lit(False))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        asking = rows["asking"].to_numpy()
        return _frame(linked_pairs(rows["set_id"].to_numpy(), _arrays(rows), ~asking, asking, rows["linked"].to_numpy().astype(np.int64), percent))

    blocks = left.select(*columns).unionByName(right.select(*columns)).groupBy("comp", "i", "j").applyInPandas(meet, "a long, b long")
    return stars.where("linked AND set_id != pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b")).unionAll(blocks)


def _classes(docs: DataFrame, words: int, percent: int, lower: bool) -> DataFrame:
    """(doc_id, copy, n_shingles, first): the text's digest, the size of its set, and the least (doc_id, copy) of its class."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    first = _sets_and_sketch(texts, words, lower).persist(StorageLevel.MEMORY_AND_DISK)
    sketch = texts.sparkSession.sparkContext.broadcast(_sketch(first))
    own = durable(first.where("cell IS NULL").select("doc_id", "copy", "n", "set_id", "bits"))
    first.unpersist()
    me = F.struct("doc_id", "copy")
    classes = own.where("n > 0").groupBy("set_id").agg(F.min(me).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = durable(classes)

    hot = max(HOT, 8 * float(sketch.value.mean()))
    near = _shared(_prefixes(texts, words, lower, percent, sketch, hot), percent).persist(StorageLevel.MEMORY_AND_DISK)
    many = sized(near.groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") > FEW).select("token"))
    rare, often = near.join(many, "token", "left_anti"), near.join(many, "token", "left_semi")
    groups = components(_links_by_sketch(rare, classes.select("set_id", "bits"), percent).unionAll(_stars(often, percent)))
    groups = groups.select(F.col("id").alias("set_id"), F.col("root").alias("comp"))
    weights = near.groupBy("set_id").agg(F.count("*").alias("weight"))
    met = together(weights.join(groups, "set_id").join(classes.select("set_id", "rep", "n"), "set_id"))
    near.unpersist()

    members = met.groupBy("comp").agg(F.count("*").alias("members"), F.max(F.struct("weight", "set_id"))["set_id"].alias("pivot"))
    wanted = sized(met.join(members, "comp").select("set_id", "comp", "members", "pivot", "n", "rep.*"))
    grams = wanted.where(F.col("members") <= BLOCK).agg(F.sum("n")).first()[0] or 0
    sets = _full_sets(texts.join(wanted, ["doc_id", "copy"]).select("set_id", "comp", "members", "pivot", "text"), words, lower)
    sets = sets.persist(StorageLevel.MEMORY_AND_DISK)
    links = _small_groups(sets.where(F.col("members") <= BLOCK), percent, grams).unionAll(_large_groups(sets.where(F.col("members") > BLOCK), percent))
    roots = components(links).select(F.col("id").alias("set_id"), "root")
    sets.unpersist()
    sketch.unpersist()

    linked = together(classes.select("set_id", "rep").join(roots, "set_id"))
    smallest = linked.groupBy("root").agg(F.min("rep").alias("first"))
    class_of = sized(linked.join(smallest, "root").select("set_id", "first"))
    some = own.where("n > 0").join(classes.select("set_id", "rep"), "set_id").join(class_of, "set_id", "left")
    some = some.select("doc_id", "copy", F.col("n").alias("n_shingles"), F.coalesce("first", "rep").alias("first"))
    return some.unionAll(own.where("n = 0").select("doc_id", "copy", F.col("n").alias("n_shingles"), me.alias("first")))


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Class of each document under the links "Jaccard similarity of word n-gram sets is at least percent".

    Words are runs without the white space 0x20, 0x09-0x0D, with A-Z in lower case if lower. A text with fewer
    words than an n-gram has is one n-gram; one without words has an empty set and no link.

    docs needs doc_id (integer) and text; other columns are ignored. Returns doc_id, n_shingles (size of
    the set) and component_id (smallest doc_id reachable by links, itself included). Null texts count as
    empty. Rows without doc_id take no part; rows that share a doc_id each get a row, with the class of
    their own text. Equal sets are linked whatever their number. Empty tables give empty results.
    """
    return _classes(docs, words, percent, lower).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all columns, but only one text of each class, that of the smallest doc_id; rows without doc_id stay.

    Rows are told apart by doc_id and text: of rows that share their doc_id each stays or goes by its own text, and rows equal in both
    are one document, so they stay or go together.
    """
    other = _classes(docs, words, percent, True).where(F.struct("doc_id", "copy") != F.col("first")).select("doc_id", "copy").distinct()
    other = sized(other)
    return docs.join(other, (docs["doc_id"] == other["doc_id"]) & (F.xxhash64(docs["text"]) == other["copy"]), "left_anti")
