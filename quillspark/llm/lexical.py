"""Ranked lexical search over a clustered index whose documents recursive graph bisection has reordered.

Documents and the terms they hold form a bipartite graph. Bisection splits the documents in halves, swaps documents
between the halves as long as that lowers the cost of storing each half's terms, and goes on inside the halves. Its
upper levels are fitted to a bounded sample and become a tree, down which every document is routed; below, bundles of bounded
size are bisected in full. What is left are clusters of like documents: the shards of the index. The sum of the
highest contributions of a query's terms in a shard bounds the scores there. A query visits shards in the order of their bounds, in rounds of a
few more each, and stops when no shard that is left has a bound as high as its k-th score.
Positions in the new order are mapped back to doc_id, which decides ties.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quillspark.llm.text import documents_of, word_hashes
from quillspark.session import durable, remove, shared_folder

#: Other bytes end terms; A-Z become a-z.
TERMS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Documents, terms of each, and different terms (the most frequent) to which the upper levels are fitted; how many levels.
SAMPLE, SAMPLE_TERMS, TREE_TERMS, LEVELS = 4096, 1024, 8192, 6
#: Documents and postings of a bundle; documents of a cluster; rounds of swaps at each level.
BUNDLE, BUNDLE_POSTINGS, CLUSTER, SWAPS = 4096, 1 << 20, 64, 8
#: Slots of the filter of query terms; (query, term) pairs of queries worked on together.
SLOTS, ASKED = 1 << 20, 1 << 18
#: Shards of the first round, and how many times as many each next round ends with; steps of bounds that are told apart.
FIRST, MORE, STEPS = 8, 8, 256
WIDE = 1 << 53


def with_terms(df: DataFrame, *keys: str, slots: np.ndarray | None = None) -> DataFrame:
    """keys, n (terms with repeats), terms (hashes of the distinct ones that the filter lets through, sorted) and tfs of each row."""
    schema = df.select(*keys).schema.add("n", "long").add("terms", ArrayType(LongType())).add("tfs", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blobs in documents_of(batch):
                hashes, starts = word_hashes([b.translate(TERMS) for b in blobs])
                doc, hashes = np.repeat(np.arange(len(blobs)), np.diff(starts)), hashes.view(np.int64)
                if slots is not None:
                    wanted = slots[hashes & (SLOTS - 1)]
                    doc, hashes = doc[wanted], hashes[wanted]
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                at = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(hashes) != 0)))[: len(doc)])
                offsets = np.searchsorted(doc[at], np.arange(len(blobs) + 1)).astype(np.int32)
                tfs = np.diff(np.append(at, len(doc))).astype(np.int32)
                arrays = [pa.array(c, schema_of[k]) for k, c in enumerate(zip(*rows, strict=True))]
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (hashes[at], tfs)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.diff(starts)), *lists], names=[*keys, "n", "terms", "tfs"])

    schema_of = [pa.int64()] * len(keys)
    return df.select(*[F.col(k).cast("long").alias(k) for k in keys], "text").mapInArrow(run, schema)


def bisect(doc: np.ndarray, term: np.ndarray, docs: int, levels: int, split: Callable | None = None) -> np.ndarray:
    """The part, 0 to 2**levels - 1, of each of `docs` documents; doc and term are the postings. split is told of each level's halves.

    Parts of a level are as large as each other, give or take one.
    """
    first = np.full(docs, np.iinfo(np.int64).max)
    np.minimum.at(first, doc, (term.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF)
    place = np.empty(docs, np.int64)
    place[np.argsort(first, kind="stable")] = np.arange(docs)
    part = np.zeros(docs, np.int64)
    width = int(term.max()) + 1 if len(term) else 1
    for _ in range(levels):
        sizes = np.bincount(part)
        begins = np.cumsum(sizes) - sizes
        order = np.lexsort((place, part))
        rank = np.empty(docs, np.int64)
        rank[order] = np.arange(docs) - begins[part[order]]
        side = (rank >= (sizes[part] + 1) // 2).astype(np.int64)
        cells, cell = np.unique(part[doc] * width + term, return_inverse=True)
        n_left, n_right = (np.bincount(part, weights=s, minlength=len(sizes))[cells // width] for s in (1 - side, side))

        def cost(left: np.ndarray, right: np.ndarray, n_left: np.ndarray = n_left, n_right: np.ndarray = n_right) -> np.ndarray:
            return left * np.log2(np.maximum(n_left, 1) / (left + 1)) + right * np.log2(np.maximum(n_right, 1) / (right + 1))

        for _ in range(SWAPS):
            left = np.bincount(cell, weights=1 - side[doc], minlength=len(cells))
            right = np.bincount(cell, weights=side[doc], minlength=len(cells))
            now = cost(left, right)
            to_right, to_left = now - cost(np.maximum(left - 1, 0), right + 1), now - cost(left + 1, np.maximum(right - 1, 0))
            gain = np.bincount(doc, weights=np.where(side[doc] == 0, to_right[cell], to_left[cell]), minlength=docs)
            order = np.lexsort((-gain, side, part))
            half = part[order] * 2 + side[order]
            begins = np.searchsorted(half, np.arange(2 * len(sizes) + 1))
            lefts, rights = begins[:-1:2], begins[1::2]
            pairs = np.minimum(rights - lefts, begins[2::2] - rights)
            which = np.repeat(np.arange(len(sizes)), pairs)
            step = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            a, b = order[lefts[which] + step], order[rights[which] + step]
            better = gain[a] + gain[b] > 1e-9
            if not better.any():
                break
            side[a[better]], side[b[better]] = 1, 0
        if split:
            split(part, side)
        part = part * 2 + side
    return part


class Tree:
    """The upper levels of a bisection of a sample, as weights of terms: documents of both halves are told apart by them."""

    def __init__(self, rows: list[np.ndarray], levels: int = LEVELS) -> None:
        sizes = [len(r) for r in rows]
        doc, all_ = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.empty(0, np.int64), *rows])
        terms, term, count = np.unique(all_, return_inverse=True, return_counts=True)
        kept = np.sort(np.argsort(-count, kind="stable")[:TREE_TERMS])
        self.terms, self.levels = terms[kept], []
        new = np.full(len(terms), -1)
        new[kept] = np.arange(len(kept))
        doc, term = doc[new[term] >= 0], new[term[new[term] >= 0]]

        def split(part: np.ndarray, side: np.ndarray) -> None:
            halves = 2 * (int(part.max()) + 1)
            half = part * 2 + side
            held = np.bincount(half[doc] * len(kept) + term, minlength=halves * len(kept)).reshape(halves, -1)
            share = np.log((held + 0.5) / (np.bincount(half, minlength=halves)[:, None] + 1.0))
            self.levels.append((share[1::2] - share[::2]).astype(np.float32))

        if len(rows) and len(kept):
            bisect(doc, term, len(rows), levels, split)

    def leaves(self, doc: np.ndarray, terms: np.ndarray, docs: int) -> np.ndarray:
        """The leaf of each document."""
        part = np.zeros(docs, np.int64)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            known = self.terms[at] == terms
            doc, at = doc[known], at[known]
            for weights in self.levels:
                score = np.bincount(doc, weights=weights[part[doc], at], minlength=docs)
                part = part * 2 + (score > 0)
        return part


def _postings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of the row, value) of all entries of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False)


def _with_leaves(index: DataFrame, tree: Tree) -> DataFrame:
    schema = StructType([*index.schema.fields, StructField("leaf", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, terms = _postings(batch.column("terms"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.leaves(doc, terms, batch.num_rows))], names=schema.fieldNames())

    return index.mapInArrow(run, schema)


SHARDS = "shard long, ids array<long>, terms array<long>, best array<long>, counts array<int>, docs array<int>, parts array<long>"


def _shards(bundle: pa.Table) -> pa.Table:
    """A bundle's clusters: document ids, and for each term the highest part of a score and all (document, part)."""
    ids, m = (bundle.column(c).to_numpy() for c in ("doc_id", "m"))
    doc, terms = _postings(bundle.column("terms"))
    tf = _postings(bundle.column("tfs"))[1].astype(np.int64)
    parts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    distinct, term = np.unique(terms, return_inverse=True)
    levels = max(0, int(np.ceil(np.log2(max(1, len(ids)) / CLUSTER))))
    cluster = bisect(doc, term, len(ids), levels)
    order = np.argsort(cluster, kind="stable")
    sizes = np.bincount(cluster, minlength=1 << levels)
    inside = np.empty(len(ids), np.int64)
    inside[order] = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    entry = np.lexsort((inside[doc], term, cluster[doc]))
    key = cluster[doc][entry] * len(distinct) + term[entry]
    at = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0))[: len(key)])
    best = np.maximum.reduceat(parts[entry], at) if len(at) else np.empty(0, np.int64)
    number = np.arange(1 << levels)
    cut = lambda where, values: pa.ListArray.from_arrays(np.searchsorted(where, np.arange((1 << levels) + 1)).astype(np.int32), values)
    of_term, of_entry = cluster[doc][entry][at], cluster[doc][entry]
    first = bundle.column("bundle")[0].as_py() << 20
    lists = [cut(cluster[order], ids[order]), cut(of_term, distinct[term[entry][at]]), cut(of_term, best), cut(of_term, np.diff(np.append(at, len(key))).astype(np.int32))]
    lists += [cut(of_entry, inside[doc][entry].astype(np.int32)), cut(of_entry, parts[entry])]
    return pa.Table.from_arrays([pa.array(first + number), *lists], names=["shard", "ids", "terms", "best", "counts", "docs", "parts"])


def clustered_index(index: DataFrame, path: str, sample: int = SAMPLE) -> DataFrame:
    """Write the shards of an index (doc_id, m, terms, tfs; durable) to path and return them.

    The upper levels are fitted to the `sample` documents with the smallest hashes; every document with a term is in one shard.
    """
    held = index.where("size(terms) > 0")
    # each task hands over its share of the smallest hashes, not as many as the sample
    low = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 1.5 * sample / max(1, held.count()))))
    some = held.select(F.slice("terms", 1, SAMPLE_TERMS).alias("terms"), F.xxhash64("doc_id", "terms").alias("_h")).where(F.col("_h") <= low).orderBy("_h", "terms").limit(sample).collect()
    leaved = durable(_with_leaves(held.select("doc_id", "m", "terms", "tfs"), Tree([np.array(r["terms"], np.int64) for r in some])))
    sizes = leaved.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("p")).collect()  # a row a leaf
    bundles, before = {}, 0
    for r in sorted(sizes):
        bundles[r["leaf"]] = (before, max(-(-r["n"] // BUNDLE), -(-r["p"] // BUNDLE_POSTINGS)))
        before += bundles[r["leaf"]][1]
    if bundles:
        begin, many = (F.create_map(*[F.lit(x) for leaf, v in bundles.items() for x in (leaf, v[i])])[F.col("leaf")] for i in (0, 1))
        leaved = leaved.withColumn("bundle", (begin + F.pmod(F.xxhash64(F.monotonically_increasing_id()), many)).cast("long"))
    else:
        leaved = leaved.withColumn("bundle", F.col("leaf"))
    leaved.groupBy("bundle").applyInArrow(_shards, SHARDS).where("size(ids) > 0").write.parquet(path)
    return index.sparkSession.read.parquet(path)


class Block:
    """Queries worked on together: the weights of each one's terms, terms sorted."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows)
        self.items, begins = np.unique(np.array([r[0] for r in rows], np.int64), return_index=True)
        cuts = begins[1:]
        self.terms = np.split(np.array([r[1] for r in rows], np.int64), cuts)
        self.weights = np.split(np.array([r[2] for r in rows], np.int64), cuts)

    def scores(self, items: np.ndarray, shard: dict) -> np.ndarray:
        """Scores (queries by documents) in a shard."""
        terms = shard["terms"]
        weights = np.zeros((len(items), len(terms)), np.int64)
        for i, k in enumerate(np.searchsorted(self.items, items).tolist()):
            at = np.minimum(np.searchsorted(terms, self.terms[k]), len(terms) - 1)
            known = terms[at] == self.terms[k]
            weights[i, at[known]] = self.weights[k][known]
        parts = np.zeros((len(terms), len(shard["ids"])), np.int64)
        parts[np.repeat(np.arange(len(terms)), shard["counts"]), shard["docs"]] = shard["parts"]
        if float((weights.astype(float) @ shard["best"].astype(float)).max()) < WIDE:  # doubles add such integers exactly
            return (weights.astype(float) @ parts.astype(float)).astype(np.int64)
        return weights @ parts


def _visit(todo: DataFrame, shards: DataFrame, block: Block, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of each shard for its queries; todo has item, shard and kth, below which no score counts."""
    asked = todo.groupBy("shard").agg(F.collect_list(F.struct("item", "kth")).alias("asks"))  # of one block of queries
    rows = shards.join(asked, "shard").select("asks.item", "asks.kth", "ids", "terms", "best", "counts", "docs", "parts")
    shared = todo.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                shard = {name: column[i].values.to_numpy(zero_copy_only=False) for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                ids = shard["ids"]
                for item, kth, score in zip(shard["item"], shard["kth"], block.scores(shard["item"], shard), strict=True):
                    rows = np.flatnonzero(score >= kth)
                    rows = rows[np.lexsort((ids[rows], -score[rows]))[:k]]
                    out.append((np.full(len(rows), item), ids[rows], score[rows]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """(item, shard, bound, round): what no score in the shard exceeds, and the round in which the query would visit it."""
    parts = shards.select("shard", F.explode(F.arrays_zip("terms", "best")).alias("t")).select("shard", F.col("t.terms").alias("term"), F.col("t.best").alias("best"))
    bounds = durable(parts.join(F.broadcast(asked), "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("best")).alias("bound")))
    top = bounds.groupBy("item").agg(F.max("bound").alias("top"))
    stepped = bounds.join(F.broadcast(top), "item").withColumn("step", F.expr(f"bound * {float(STEPS)} / top").cast("int"))
    # rounds are cut between steps: a query's steps are few, however many shards it has
    above = Window.partitionBy("item").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = stepped.groupBy("item", "step").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
    rounds = steps.select("item", "step", F.when(F.col("before") < FIRST, 0).otherwise(F.floor(F.log(F.col("before") / FIRST) / F.log(F.lit(float(MORE)))) + 1).cast("int").alias("round"))
    return durable(stepped.join(rounds, ["item", "step"]).select("item", "shard", "bound", "round"))


def _search(shards: DataFrame, asked: list, k: int) -> tuple[DataFrame, list[int]]:
    """The k best of each query of a block, asked: (item, term, weight); and how many (query, shard) were visited in each round."""
    spark = shards.sparkSession
    bounds = _bounds(shards, spark.createDataFrame(asked, "item long, term long, weight long"))
    rounds = sorted(r["round"] for r in bounds.select("round").distinct().collect())
    block, best, visited = Block(asked), spark.createDataFrame([], "item long, doc_id long, score long"), []
    for now in rounds:
        full = best.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        open_ = bounds.where(F.col("round") >= now).join(F.broadcast(full), "item", "left").select("item", "shard", "round", "bound", F.coalesce("least", F.lit(1)).alias("kth"))
        open_ = open_.where("bound >= kth")  # equal: a smaller doc_id may still come in
        todo = open_.where(F.col("round") == now)
        left = open_.agg(F.count("*").alias("all"), F.count(F.when(F.col("round") == now, 1)).alias("now")).first()
        visited.append(left["now"])
        if not left["all"]:
            break
        if left["now"]:
            best = durable(_ranked(best.unionByName(_visit(todo, shards, block, k)), k).select("item", "doc_id", "score"))
    return best, visited


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, sample: int = SAMPLE, asked: int = ASKED) -> DataFrame:
    """Each item's k highest-scoring documents: item_id, rank (from 1), doc_id, score.

    Terms are maximal runs of 0-9, A-Z (lower-cased), a-z and all code points from U+0080 on; hashes of 64 bits stand for them. With N documents
    that have terms, L terms in all of them, n in one, df documents that hold a term, tf times in one of them, a term weighs w = floor(1000 *
    ln((2N + 2) / (2df + 1))), m is 25 + (75nN) div L, and a score is the sum of w * ((10**9 tf) div (1000tf + 8m)) over the
    terms of the item, repeats included. Only scores above 0 count; equal ones go by ascending doc_id.

    docs needs doc_id and text, items item_id and text (ids integers); other columns are ignored. Rows without an id take no part and are not in N or
    L; null and empty texts have no terms. Documents that share a doc_id are ranked each; items that share an item_id have ranks of their own each, equal ones once. A
    table without rows or terms gives no ranks. Queries are worked on in blocks of about `asked` (item, term) pairs.
    """
    spark = docs.sparkSession
    asks = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).distinct()
    asks = asks.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text")
    asks = durable(with_terms(asks, "item_id", "item").select("item_id", "item", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item_id", "item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times")))
    slots = np.zeros(SLOTS, bool)
    slots[[r[0] for r in asks.select((F.col("term").bitwiseAND(SLOTS - 1)).cast("int")).distinct().collect()]] = True  # SLOTS at most
    index = durable(with_terms(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id", slots=slots).where("n > 0"))
    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    N, L = total["docs"], total["terms"] or 1
    df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * N + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighted = durable(asks.join(df, "term").select("item_id", "item", "term", (weight * F.col("times")).cast("long").alias("weight")).where("weight > 0"))
    blocks = max(1, -(-weighted.count() // asked))
    path, found = shared_folder(spark, "shards"), []
    try:
        shards = clustered_index(index.withColumn("m", F.expr(f"25 + (75 * n * {N}L) div {L}L")), path, sample)
        for i in range(blocks):
            block = weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).select("item", "term", "weight").collect()  # about `asked` rows
            if block:
                found.append(_search(shards, [tuple(r) for r in block], k)[0])
    finally:
        remove(spark, path)  # what was found is durable
    best = spark.createDataFrame([], "item long, doc_id long, score long")
    for df in found:
        best = best.unionByName(df)
    return _ranked(best.join(weighted.select("item_id", "item").distinct(), "item"), k).select("item_id", "rank", "doc_id", "score")
