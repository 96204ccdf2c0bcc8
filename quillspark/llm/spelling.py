"""Spelling variants: a self-join of the vocabulary in prefix-partitioned tries, by active-node sets.

Two words at distance one part at one place. If that place lies in the second half of the shorter word, both begin with its
first half; else both end with its second half. So every word goes to the partitions of its halves, once as it is and
once reversed, and each partition is a trie whose words share their beginning. Down a trie every node
keeps the set of nodes at distance one from it, made from its parent's set; words that end
at a node and in its set are near. A partition of too many letters is split where its words part first: pairs that part
there share what is left without that letter, all other pairs stay together below.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillspark.session import durable, sized

#: A word has at least so many code points and occurrences.
LETTERS, OCCURRENCES = 5, 3
#: A form is at least so many times as frequent as its word.
RATIO = 2
#: Occurrences whose crc32 this number divides lose a code point.
NOISE = 97
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Code points of all words of a partition that one task makes a trie of; larger partitions are split first.
TRIE = 1 << 18
KEY = ["side", "least", "head"]


def word_counts(docs: DataFrame, letters: int = LETTERS, noise: int = NOISE) -> DataFrame:
    """(word, n): runs of a-z and U+00C0 to U+00FF, A-Z lower-cased first, of at least `letters` code points, and their occurrences.

    Where noise divides h, the crc32 of "<doc_id>:<run>", the run loses code point h % length first (0: never). Runs of rows
    without doc_id stay as they are.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % max(letters, 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for i, doc_id in enumerate(ids):
                text = (texts[i].as_py() or b"").lower().decode()
                begun = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(map(re.Match.group, runs.finditer(text))).items():
                    if noise and doc_id is not None and (h := zlib.crc32(run.encode(), begun)) % noise == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < letters:
                            continue
                    counts[run] += n
                if len(counts) >= COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    parts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def near_in_trie(words: list[str], depth: int) -> Iterator[tuple[int, int]]:
    """Ordered pairs (i, j) of distinct words that share their first depth code points and are at distance one."""
    children: list[dict] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        node = 0
        for letter in word[depth:]:
            below = children[node].get(letter)
            if below is None:
                below = children[node][letter] = len(children)
                children.append({})
                ends.append(-1)
            node = below
        ends[node] = i
    # active: the nodes at distance one; the node itself is the only one at distance zero
    open_ = [(0, set(children[0].values()))]
    while open_:
        node, active = open_.pop()
        if ends[node] >= 0:
            yield from ((ends[node], ends[v]) for v in active if ends[v] >= 0)
        for letter, child in children[node].items():
            below = {w for v in active if (w := children[v].get(letter)) is not None}  # the same letter on both sides
            below.add(node)  # child's letter is left out
            below.update(children[node].values())  # replaced
            below.update(children[child].values())  # one more inserted
            below.discard(child)
            open_.append((child, below))


def _trie_pairs(rows: DataFrame) -> DataFrame:
    """(word, near, near_n) of all partitions; rows: KEY, depth, word (reversed on side R), n."""

    def pairs(key: tuple, words: list[str], counts: list[int], depth: int) -> Iterator[tuple[str, str, int]]:
        side, least, _ = key
        for i, j in near_in_trie(words, depth):
            a, b = words[i], words[j]
            if min(len(a), len(b)) == least and (side == "F" or a[: -(least // 2) - 1 : -1] != b[: -(least // 2) - 1 : -1]):
                yield (a, b, counts[j]) if side == "F" else (a[::-1], b[::-1], counts[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            c = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64())], names=["word", "near", "near_n"])

        key, words, counts, depth = None, [], [], 0
        for batch in _ended(batches):
            for *now, d, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else [(None, 0, "", 0)]:
                if now != key:
                    if len(words) > 1 and key[1] in map(len, words):
                        found += pairs(key, words, counts, depth)
                        if len(found) >= 20_000:
                            yield out()
                            found.clear()
                    key, words, counts, depth = now, [], [], d
                words.append(word)
                counts.append(n)
        yield out()

    return rows.select(*KEY, "depth", "word", "n").mapInArrow(run, "word string, near string, near_n long")


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _partitions(words: DataFrame, letters: int) -> DataFrame:
    """KEY, depth, word, n: each word as the shorter (or equal) one and as the longer one of a pair, as it is and reversed."""
    size = F.length("word")
    roles = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), (size - less).alias("least")) for side in "FR" for less in (0, 1)])).alias("r")
    rows = words.select("word", "n", roles).select("word", "n", "r.*").where(F.col("least") >= letters)
    half = F.expr("least div 2")
    turned = F.when(F.col("side") == "F", F.col("word")).otherwise(F.reverse("word"))
    rows = rows.select("side", "least", F.when(F.col("side") == "F", half).otherwise(F.col("least") - half).cast("int").alias("depth"), turned.alias("word"), "n")
    return rows.select("side", "least", F.expr("left(word, depth)").alias("head"), "depth", "word", "n")


@F.udf(IntegerType(), useArrow=True)
def _shared(a: str, b: str) -> int:
    """How many code points two different words share at their beginning."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _forward(c: Column) -> Column:
    return F.when(F.col("side") == "F", c).otherwise(F.reverse(c))


def _parting(rows: DataFrame) -> DataFrame:
    """(word, near, near_n): pairs of rows that part at depth; what is left of both is equal without one letter there."""
    rows = rows.withColumn("rest", F.concat(F.expr("left(word, depth)"), F.expr("substring(word, depth + 2)"))).withColumn("letter", F.expr("substring(word, depth + 1, 1)"))
    short = F.length("word") == F.col("least")
    a = rows.where(short).select(*KEY, "depth", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"), F.col("letter").alias("a_letter"))
    b = rows.withColumnsRenamed({"word": "b", "n": "b_n"})
    same = a.where("a_letter != ''").withColumnRenamed("a_rest", "rest").join(b.where(F.length("b") == F.col("least")).drop("depth"), [*KEY, "rest"]).where("a_letter != letter")
    more = a.drop("a_rest").withColumn("rest", F.col("a")).join(b.where(F.length("b") > F.col("least")).drop("depth"), [*KEY, "rest"]).where("a_letter != letter")
    half = F.expr("least div 2")
    kept = (F.col("side") == "F") | (F.left(F.reverse("a"), half) != F.left(F.reverse("b"), half))
    both = [df.where(kept).select(_forward(F.col("a")).alias("a"), _forward(F.col("b")).alias("b"), "a_n", "b_n") for df in (same, more)]
    there = [df.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")) for df in both]
    return there[0].unionAll(there[1]).unionAll(both[1].select("b", "a", "a_n"))


def near_pairs(words: DataFrame, letters: int = LETTERS, trie: int = TRIE) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words (word distinct, n) that differ by exactly one inserted, deleted or replaced code point.

    Words of fewer than `letters` code points take no part. Partitions of more than trie code points are split.
    """
    rows, found = _partitions(words, letters), []
    hot = sized(_large(rows, trie))
    while hot.limit(1).count():
        crowded = durable(rows.join(hot, KEY).withColumn("depth", F.col("parts_at")).drop("parts_at"))
        rows = rows.join(hot.select(*KEY), KEY, "left_anti")
        found += [rows, _parting(crowded)]
        below = F.col("depth") + 1
        rows = crowded.where(F.length("word") > F.col("depth")).select("side", "least", F.expr("left(word, depth + 1)").alias("head"), below.alias("depth"), "word", "n")
        hot = sized(_large(rows, trie))
    tries = rows
    for df in found[::2]:
        tries = tries.unionByName(df)
    out = _trie_pairs(tries.repartition(*KEY).sortWithinPartitions(*KEY, "word"))
    for df in found[1::2]:
        out = out.unionByName(df)
    return out


def _large(rows: DataFrame, trie: int) -> DataFrame:
    """KEY and parts_at, where the words of the partition part first, of partitions that are to be split."""
    sizes = rows.groupBy(*KEY).agg(F.sum(F.length("word") - F.col("depth")).alias("letters"), F.min("word").alias("low"), F.max("word").alias("high"))
    return sizes.where((F.col("letters") > trie) & (F.col("low") != F.col("high"))).select(*KEY, _shared("low", "high").alias("parts_at"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one, by pointer doubling. Forms must not lead back to a word."""
    state = durable(forms.select("word", F.col("form").alias("root")))
    moved = state.limit(1).count()
    while moved:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        state = durable(state.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")))
        moved = state.where("moved").limit(1).count()
        state = state.select("word", "root")
    return state


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, noise: int = NOISE, trie: int = TRIE) -> DataFrame:
    """The words of docs, each with the frequent word that it is likely a variant of: word, form, root, n, n_near, form_n.

    Words are those of word_counts that occur at least `occurrences` times (n). n_near counts words at
    distance one, form is the most frequent of them (ties: the smallest in code-point order; form_n its n) if it is
    at least ratio times (2 or more, so that forms never lead back) as frequent as the word, else null; root is where following forms ends.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no words. Rows
    without doc_id count unchanged, rows that share one count each. Empty tables give empty results.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = durable(word_counts(docs, letters, noise).where(F.col("n") >= occurrences))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words, letters, trie).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("best"))
    known = durable(known.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.n")).alias("form_n")))
    last = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
