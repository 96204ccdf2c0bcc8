"""The numbered operators against brute force on small made-up tables with nulls, ties, repeats, long texts and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark import session
from quillspark.llm import fingerprint, graph, line_dedup, ngram_join, packing, pieces, quality, sharding, substring_index, suffix_dedup, topk, windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rank int, canonical_id long, key string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, None, None, None, 7, 8, 9, "k") for i, t in rows], SCHEMA)


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def corpus(seed=1, n=40, length=160):
    """Fresh texts, copies, near copies, shared passages, repeats within a text, empty, null and short ones."""
    rng = random.Random(seed)
    rows, base = [], [words(rng, length, 10_000) for _ in range(6)]
    passage = words(rng, 70, 10_000)
    for i in range(n):
        kind = i % 8
        w = list(base[i % len(base)]) if kind < 3 else words(rng, rng.randrange(1, length), 10_000)
        if kind == 1:
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if kind == 4:
            at = rng.randrange(len(w))
            w[at:at] = passage
        if kind == 5:
            w = w + w + ["é"] * rng.randrange(4)
        rows.append((i * 3, (" " if kind != 6 else "\n\t ").join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, "   "), (1003, "one"), (1004, "one"), (1005, "aa " * 900), (1006, None), (1007, "ÀB " * 300)]


EMPTY = [
    lambda d: ngram_join.ngram_components(d),
    lambda d: sharding.shard_documents(d),
    lambda d: substring_index.dedup_substrings(d),
    lambda d: suffix_dedup.dedup_suffixes(d),
    lambda d: fingerprint.edited_fingerprints(d),
    lambda d: line_dedup.dedup_lines(d),
    lambda d: fingerprint.fingerprints(d),
]


@pytest.mark.parametrize("f", EMPTY)
def test_empty_tables(spark, f):
    assert f(frame(spark, [])).count() == 0


@pytest.mark.parametrize("f", EMPTY[:4] + EMPTY[5:])
def test_rows_that_repeat_and_lack_ids_do_not_break(spark, f):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y z"), (2, None), (1, "other text")]
    assert f(frame(spark, rows)).count() >= 4


def jaccard_classes(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(3)
    rows = corpus(2)
    base = words(rng, 120, 10_000)
    for i in range(25):  # a large group of near copies, not all linked with each other
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(w)))
    got = {tuple(r) for r in ngram_join.ngram_components(frame(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == jaccard_classes(rows, 4, 85)


def test_prefix_tree_finds_all_similar_sets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = rng.choice(60, 20, replace=False)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(12, 20)], rng.integers(60, 80, rng.integers(0, 4))])) for _ in range(15)]
        for t in (60, 80):
            tree = ngram_join.PrefixTree(80, t)
            for i, s in enumerate(sets):
                tree.add(i, s, i)
            for s in sets:
                expected = {i for i, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= t * len(np.union1d(s, o))}
                assert set(tree.walk(s, lambda label: False)) == expected


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in up)


def test_few_edges_are_joined_without_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "_large_star", lambda edges: pytest.fail("a round for a few edges"))
    path = [(i + 1, i) for i in range(300)] + [(1001, 1000), (1002, 1000), (1002, 1001)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(path, "a long, b long").repartition(16)).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 1002: 1000}


def test_few_rows_are_read_by_few_tasks(spark):
    df = session.sized(spark.range(100).repartition(64, "id"))
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and df.count() == 100
    assert session.sized(spark.range(100).repartition(8, "id"), 99).count() == 100


def test_few_rows_are_grouped_without_exchange(spark, monkeypatch):
    df = session.together(spark.range(100).repartition(64, "id"))
    assert df.groupBy("id").count().join(df, "id").count() == 100
    assert df.rdd.getNumPartitions() == 1
    monkeypatch.setattr(session, "TASK_ROWS", 99)
    assert session.together(spark.range(100).repartition(8, "id")).rdd.getNumPartitions() > 1


def test_components_in_few_rounds(spark, monkeypatch):
    """What tasks join by themselves takes no round, and rounds end as soon as all are stars: the driver keeps something of every job."""
    rounds, large_star = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda edges: rounds.append(1) or large_star(edges))
    stars = [(9 + i, i % 3) for i in range(3, 300)]
    got = graph.components(spark.createDataFrame(stars, "a long, b long").repartition(16)).collect()
    assert sorted((r.id, r.root) for r in got) == sorted({(i, i) for i in range(3)} | set(stars)) and not rounds
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    path = [(ids[i], ids[i + 1]) for i in range(999)] + [(ids[500], i) for i in range(2000, 2300)] + [(7, 7), (None, 3), (5000, 5001), (5001, 5000)]
    monkeypatch.setattr(graph, "AT_ONCE", 20)
    got = graph.components(spark.createDataFrame(path, "a long, b long").repartition(16)).collect()
    assert sorted((r.id, r.root) for r in got) == sorted([(i, 0) for i in [*range(1000), *range(2000, 2300)]] + [(5000, 5000), (5001, 5000)])
    assert 0 < len(rounds) <= 5


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    out = quality.classify(docs, fitted).select("doc_id", F.col("quality").alias("p"), "toxicity", "keep").join(held, "doc_id").cache()
    assert out.where((F.col("p") >= 0.5) == (F.col("quality") == 1)).count() >= 0.97 * held.count() > 97
    assert out.where("keep != (p >= 0.5 AND toxicity < 0.5)").count() == 0
    toxic, clean = out.where("toxic = 1"), out.where("toxic = 0")
    assert toxic.where("toxicity >= 0.5").count() >= 0.7 * toxic.count() > 10  # the rest are in languages with a handful of toxic labels, or too short
    assert clean.where("toxicity >= 0.5").count() <= 0.01 * clean.count()


def plain_strength(groups):
    groups = [g for g in groups if g[0] >= 2]
    if len(groups) < 2:
        return 1e6
    n = sum(g[0] for g in groups)
    mean = min(max(sum(g[1] for g in groups) / n, 1e-6), 1 - 1e-6)
    between = sum(g[0] * (g[1] / g[0] - mean) ** 2 for g in groups)
    spread = (between - (len(groups) - 1) * mean * (1 - mean)) / (n - sum(g[0] ** 2 for g in groups) / n)
    return min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6


def test_posteriors_equal_a_plain_version(spark):
    """Given each row's evidence: hosts shrink to the corpus, paths to their hosts, each row left out of its own site."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    where = {r.doc_id: (r.source or "", r.lang or "") for r in docs.collect()}
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(where)
    paths, hosts = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
    for r in out:
        for group in (paths[where[r.doc_id]], hosts[where[r.doc_id][0]]):
            group[0] += 1
            group[1] += r.evidence
    mean = sum(r.evidence for r in out) / len(out)
    k_host, k_path = plain_strength(hosts.values()), plain_strength(paths.values())
    for r in out:
        (n, s), (hn, hs) = paths[where[r.doc_id]], hosts[where[r.doc_id][0]]
        host = (hs - r.evidence + k_host * mean) / (hn - 1 + k_host)
        path = (s - r.evidence + k_path * host) / (n - 1 + k_path)
        assert r.host_posterior == pytest.approx(host, rel=1e-4) and r.path_posterior == pytest.approx(path, rel=1e-4)
        odds = [math.log(x / (1 - x)) for x in (min(max(y, 1e-9), 1 - 1e-9) for y in (r.evidence, path, mean))]
        assert r.quality == pytest.approx(1 / (1 + math.exp(-(odds[0] + odds[1] - odds[2]))), abs=1e-4) and r.keep == (r.quality >= 0.5 and r.toxicity < 0.5)


def plain_telling(texts):
    """Weights of words and beginnings of (toxic, text) rows, none of them near copies."""
    bad, total = sum(y for y, _ in texts), len(texts)
    a, n = collections.Counter(), collections.Counter()
    for y, t in texts:
        found = {w.lower() for w in re.findall(r"[A-Za-z\x80-\uffff]+", t)}
        for f in found | {f"{w[:k]}*" for w in found for k in quality.BEGINNINGS if len(w) >= k}:
            n[f] += 1
            a[f] += y
    seen = [f for f in n if n[f] >= quality.SEEN]
    out = {}
    for f in seen:
        score = sum(c * math.log(c / n[f] / p) for c, p in ((a[f], bad / total), (n[f] - a[f], 1 - bad / total)) if c)
        weight = round(1000 * (math.log((a[f] + 0.5) / (bad + 1)) - math.log((n[f] - a[f] + 0.5) / (total - bad + 1))))
        if a[f] > n[f] * bad / total and score >= math.log(len(seen)) + quality.BEYOND_CHANCE and weight > 0:
            out[f] = weight
    return out


def toxic_corpus():
    """Rows (toxic, text): "vileness" in half of the toxic texts, "grub" with changing ends in the others."""
    rng = random.Random(31)
    rows = [(0, " ".join(words(rng, 60, 400))) for _ in range(120)]
    rows += [(1, " ".join([*words(rng, 30, 400), "Vileness", *words(rng, 30, 400)])) for _ in range(25)]
    rows += [(1, " ".join([*words(rng, 50, 400), *(f"grub{rng.choice('abcdefgh')}{i}x" for i in "éöü")])) for _ in range(25)]
    return rows


def test_telling_words_equal_a_plain_version(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (y, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    expected = plain_telling(rows)
    assert {"vileness", "vile*", "grub*"} <= set(expected)
    assert quality.telling_words(quality.labelled(docs, labels, 1000)) == expected


def test_toxic_texts_are_rejected_and_copies_of_one_teach_nothing(spark):
    rng = random.Random(37)
    rows = toxic_corpus()
    group = words(rng, 60, 400) + [f"harmless{w}" for w in "abcd"]
    known = rows + [(1, " ".join(group))] * 40
    new = [" ".join(words(rng, 60, 400)), " ".join([*words(rng, 60, 400), "VILENESS!"]), " ".join([*words(rng, 60, 400), "grubzé grubzö grubzü"]), " ".join([*words(rng, 60, 400), "harmlessa"]), "", None, "vileness " + "x" * 1_000_000]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*(t for _, t in known), *new])], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, y) for i, (y, _) in enumerate(known)] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id - len(known): r.toxicity >= 0.5 for r in quality.classify(docs, labels).collect()}
    assert [got[i] for i in range(len(new))] == [False, True, True, False, False, False, True]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id - len(known) for r in kept.collect()} & {0, 1, 2, 3} == {0, 3}
    for other in (labels.drop("toxic"), labels.where("toxic = 0"), labels.limit(0)):
        assert quality.classify(docs, other).where("toxicity != 0").count() == 0


def test_sparse_sites_shrink_to_the_corpus(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(words(rng, 80)), "p", "good.example") for i in range(60)] + [(100 + i, "!!!! #### " * 40, "p", "bad.example") for i in range(60)]
    rows += [(300, " ".join(words(rng, 80)), "p", "one.example"), (301, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in (*range(0, 40), *range(100, 140))] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) and got[1].keep and not got[101].keep
    assert got[101].host_posterior < got[300].host_posterior < got[1].host_posterior
    without = quality.classify(docs, labels.limit(0)).collect()
    assert len(without) == len(rows)


def test_shards(spark):
    rng = random.Random(1)
    rows = corpus(4, 200) + [(5000 + i, "copy " * 50) for i in range(150)] + [(None, "no id"), (3, "other")]
    out = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by_text, load, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i, zlib.crc32((t or "").encode())].append(t)
    for r in out:
        t = texts[r.doc_id, r.text_crc32][0] or ""
        assert r.size == len(t.encode()) + 8 and r.law == "bytes" and r.grown_shard is None
        by_text[t].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = sharding.shard_documents(spark.createDataFrame([(i, " ".join(words(rng, rng.randrange(5, 60)))) for i in range(6000)], "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r.s for r in whole]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 0.01 * max(sizes)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring_dedup_equals_brute_force(spark, batches):
    rows = corpus(6)
    first = {}
    expected = set()
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            if first.setdefault(k, i) < i:
                gone.update(range(s, s + 50))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        expected.add((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = {tuple(r) for r in substring_index.dedup_substrings(frame(spark, rows), batches=batches).collect()}
    assert got == expected and any(e[2] for e in expected)


def test_index_compacts_and_finds_history(spark):
    index = substring_index.FingerprintIndex(spark, buckets=4)
    found = []
    for b in range(5):
        rows = spark.createDataFrame([(h, 10 * b + h) for h in range(b, b + 3)], "hash long, copy long")
        found.append({r.hash for r in index.add(rows).collect()})
    assert found == [set(), {1, 2}, {2, 3}, {3, 4}, {4, 5}]
    assert len(index.runs) == 2
    again = substring_index.FingerprintIndex(spark, index.name + "_b", 4, index.runs)
    assert {r.hash for r in again.add(spark.createDataFrame([(0, 99), (77, 99)], "hash long, copy long")).collect()} == {0}
    again.drop()
    index.drop()


@pytest.mark.parametrize("crowded", [512, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rows = corpus(7)
    rng = random.Random(70)
    shared = " ".join(words(rng, 80))  # many distinct surroundings of one passage
    rows += [(2000 + i, f"{' '.join(words(rng, 20))} {shared} {' '.join(words(rng, 20))}") for i in range(12)]
    blobs = {i: (t or "").encode() for i, t in rows}
    count = collections.Counter(b[s : s + 400] for b in blobs.values() for s in range(len(b) - 399))
    expected = set()
    for i, b in blobs.items():
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 399):
            if count[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        expected.add((i, len(b), int(gone.sum()), int(np.count_nonzero(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if b else 0, hashlib.sha256(kept).hexdigest()))
    got = {tuple(r) for r in suffix_dedup.dedup_suffixes(frame(spark, rows)).collect()}
    assert got == expected and any(e[2] for e in expected)


def test_refinement_equals_direct_comparison():
    rng = np.random.default_rng(1)
    for q, length in ((3, 10), (4, 16), (5, 5)):
        text = rng.integers(0, 3, 400).astype(np.uint8)
        wanted = np.sort(rng.choice(400 - length, 150, replace=False))
        count = collections.Counter(text[w : w + length].tobytes() for w in wanted)
        expected = [count[text[w : w + length].tobytes()] > 1 for w in wanted]
        assert suffix_dedup.refine(windows.BYTE_HASHES[text], wanted, length, q).tolist() == expected


def test_anchors_cover_every_window_once():
    rng = np.random.default_rng(2)
    starts = np.array([0, 120, 130, 400, 400, 471])
    grams = windows.Rolling(windows.BYTE_HASHES[rng.integers(0, 4, 471)]).grams(5)
    doc, place, first, last = windows.anchors(grams, starts, 50, 5)
    at, which = windows.ranges(first, last)
    assert at.tolist() == [s for a, b in zip(starts[:-1], starts[1:], strict=True) for s in range(a, b - 49)]
    assert all(p - 45 <= s <= p for s, p in zip(at, place[which], strict=True))


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(8)
    rows = corpus(9) + [(7000, " ".join(words(rng, 9000))), (7001, "it's Don't x ΣΑΣ İx é́ <|endoftext|> a'b,' 12,5!!"), (None, "no id")]
    out = packing.pack_documents(frame(spark, rows), path, with_ids=True).collect()
    made, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        made[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
    for i, t in rows:
        p = sorted(made[i], key=lambda r: r.start)
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert [r.start for r in p] == [sum(x.length for x in p[:k]) for k in range(len(p))] and all(r.doc_tokens == len(ids) for r in p)
        assert np.frombuffer(b"".join(r.ids for r in p), "<u4").tolist() == ids
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 4096
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_best_fit_takes_the_tightest_window():
    number, offset = packing.best_fit_decreasing([6, 5, 4, 3, 2], 10)
    assert number == [0, 1, 0, 1, 1] and offset == [0, 0, 6, 5, 8]
    rng = random.Random(0)
    lengths = [rng.randrange(1, 101) for _ in range(500)]
    number, _ = packing.best_fit_decreasing(lengths, 100)
    free, expected = [], []
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - lengths[i])
        else:
            free.append(100 - lengths[i])
        expected.append(len(free))
    assert len(set(number)) == len(free)


def test_line_dedup(spark):
    a, b = "l1\nl2\nl3\nl4", "x\nl2\nl3\nl4\ny\nl1\nl2"
    rows = [(1, a), (2, b), (3, a), (4, "q\nq\nq\nq"), (5, None), (6, ""), (7, "l1\nl2"), (None, a)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_deleted, r.n_runs) for r in line_dedup.dedup_lines(frame(spark, rows)).where("doc_id IS NOT NULL").collect()}
    assert got[1] == (a, 4, 0, 0) and got[2] == ("x\ny\nl1\nl2", 7, 3, 1) and got[3] == ("", 4, 4, 1)
    assert got[4] == ("q", 4, 3, 1)  # its second window repeats the first
    assert got[5] == (None, 0, 0, 0) and got[6] == ("", 1, 0, 0) and got[7][2] == 0


def test_piece_samples_are_distinct_and_decode(spark):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = corpus(11, 16) + [(7000, "  two  spaces\nand a line "), (7001, "日本 ‍ ☃ 😀"), (None, "no id"), (3, "again")]
    docs = frame(spark, rows)
    encoded = pieces.sample_segmentations(docs, model, k=3)
    got = collections.defaultdict(list)
    for r in pieces.decode_pieces(encoded, model).collect():
        got[r.doc_id].append(r)
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    assert set(got) == set(texts)
    assert all({r.text for r in got[i]} == texts[i] for i in texts)
    seen = collections.defaultdict(set)
    for r in encoded.collect():
        if r.doc_id != 3:
            assert tuple(r.ids) not in seen[r.doc_id] and 0 <= r.inclusion <= 1
            seen[r.doc_id].add(tuple(r.ids))
    one = {(r.doc_id, r.sample): r.ids for r in encoded.where("doc_id = 0").collect()}
    alone = {(r.doc_id, r.sample): r.ids for r in pieces.sample_segmentations(docs.where("doc_id = 0"), model, k=3).collect()}
    assert one == alone
    assert pieces.sample_segmentations(frame(spark, []), model).count() == 0


def test_words_of_texts_are_cut_once_into_the_same_units(monkeypatch):
    """Each distinct word is cut into units once, however often it occurs, and its units are those of the whole text; ids of many lists are decoded at once."""
    import public_tokenizers

    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    texts = ["the cat, the cat.the", "  two  spaces\nand a line ", "", " ", "a▁ b▁", "▁x", "\n\n a. b.c, d.", "日本 ☃ 😀", "   ", "the cat"]
    lat = pieces.Lattices(model)
    for words, edges in ((1000, 10**6), (3, 10**6), (1000, 50)):  # also when words or all are forgotten in between
        monkeypatch.setattr(pieces, "WORDS", words)
        monkeypatch.setattr(pieces, "REMEMBERED", edges)
        for some in (texts, texts[::-1], texts[:1] * 3):
            roots, first = lat.roots(some)
            name = {n: u for u, n in lat.root.items()}
            assert [[name[r] for r in roots[a:b].tolist()] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] == [pieces._units(t, model.units) for t in some]
    lat = pieces.Lattices(model)
    lat.roots(["the cat the cat"] * 5)
    assert list(lat.number) == ["the", "cat"]
    lists = [np.arange(300), np.empty(0, np.int64), np.arange(5000, 5100), np.arange(3)]
    assert [bytes(x) for x in model.decoded(np.concatenate(lists), np.cumsum([len(x) for x in lists]).tolist())] == [model.decode(x.tolist()) for x in lists]
    assert [bytes(x) for x in model.decoded(np.empty(0, np.int64), [0, 0])] == [b"", b""]


def test_samples_follow_the_lattice():
    import public_tokenizers

    lat = pieces.Lattices(pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.0))
    units = pieces._units("the at")
    lat.add(set(units))
    n, first, weight = 6000, collections.Counter(), collections.Counter()
    roots = np.array([lat.root[u] for u in units] * n)
    keys = np.arange(len(roots), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = [lat.paths(roots, keys ^ np.uint64(r + 1)) for r in range(2)]
    node_of = np.repeat(np.arange(len(lat.begin) - 1), np.diff(lat.begin))
    prob = {}
    for d in range(n):
        found = pieces._segmentations(lat, node_of, drawn, (len(units) * d, len(units) * (d + 1)), d + 1, 2)
        first[tuple(found[0][0].tolist())] += 1
        for path, lp, _ in found[:2]:
            prob[tuple(path.tolist())] = np.exp(lp)
            weight[tuple(path.tolist())] += 1 / -np.expm1(-np.exp(lp - found[2][2]))
    likely = sorted(prob, key=prob.get)[-2:]
    assert all(abs(first[p] / n - prob[p]) < 0.03 for p in likely)
    assert all(abs(weight[p] / n - 1) < 0.05 for p in likely)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 300)
    monkeypatch.setattr(topk, "FEW", 12)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], 1) for i in range(900)]
    rows += [(900 + i, rows[50][1], 1) for i in range(5)]  # ties
    rows += [(2000, None, 1), (2050, [1.0, None] + [0.0] * 6, 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 1), (None, [0.0] * 8, 1), (2200, [1.0, 2.0], 1), (2201, [0.5, 1.0], 1), (2250, [], 1)]
    got = {tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), F.col("vec_id") % 50 == 0).collect()}
    fine = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for q in (i for i in fine if i % 50 == 0):
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:5]
        expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == expected
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_with_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (7, [0.1, 0.0]), (7, [0.9, 0.0]), (8, [0.5, 0.0]), (8, [0.5, 0.0]), (50, [0.0, 1.0])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    one = [(7, 58880), (8, 32768), (8, 32768), (7, 6400)]
    assert sorted(tuple(r) for r in got) == sorted([(50, k + 1, i, s) for k, (i, s) in enumerate(one)] + [(50, k + 1, i, 0) for k, i in enumerate([7, 7, 8, 8])])


def kept(text):
    """Shingle hashes below the threshold, as Spark's xxhash64 gives them."""

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    w = [signed(xxh64_intdigest(x, 42)) for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x]
    out = set()
    for i in range(max(len(w) - 4, 1 if w else 0)):
        seed = 42
        for h in w[i : i + 5]:
            seed = xxh64_intdigest((h & (1 << 64) - 1).to_bytes(8, "little"), seed)
        if signed(seed) < -(1 << 63) + (1 << 64) // 4:
            out.add(signed(seed))
    return out


def test_fingerprints_equal_brute_force(spark):
    rows = corpus(12, 30)
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(frame(spark, rows)).collect()}
    assert set(got) == set(texts)
    for place, i in enumerate(order):
        t, following = texts[i], texts[order[(place + 1) % len(order)]]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, value in ((edited, got[i].near_edited), (following, got[i].near_next)):
            a, b = kept(t), kept(other)
            assert value == pytest.approx(1.0 if t == other else len(a & b) / len(a | b) if a | b else 0.0)
    assert len({got[i].fingerprint for i in order}) == len(set(texts.values()))


@pytest.mark.parametrize("low, high, parts", [(-1000, 10**6, 16), (-(2**63), 2**63, 5), (0, 3, 7), (5, 6, 3)])
def test_next_ids(spark, low, high, parts):
    rng = random.Random(2)
    ids = sorted({rng.randrange(low, high) for _ in range(300)})
    got = {r.doc_id: r.next_id for r in fingerprint.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long"), parts).collect()}
    assert got == {i: ids[k - 1] for k, i in enumerate(ids)}


def test_sketches_merge_and_contain(spark):
    rng = random.Random(5)
    w = [words(rng, 300, 10_000) for _ in range(3)]
    rows = [(1, " ".join(w[0])), (2, " ".join(w[1])), (3, " ".join(w[0] + w[1])), (4, " ".join(w[2])), (5, "")]
    got = {r.doc_id: r.sketch for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    sketches = spark.createDataFrame(list(got.items()), "doc_id long, sketch array<long>")
    assert sketches.where("doc_id < 3").agg(fingerprint.merge("sketch").alias("m")).first().m == sorted({*got[1], *got[2]})
    both = sketches.alias("a").join(sketches.alias("b"), F.lit(True)).select("a.doc_id", F.col("b.doc_id").alias("other"), fingerprint.containment(F.col("a.sketch"), F.col("b.sketch")).alias("c"))
    share = {(r.doc_id, r.other): r.c for r in both.collect()}
    assert share[1, 3] == share[2, 3] == 1.0 and share[4, 3] == 0.0 and share[5, 3] is None
    assert share[3, 1] == pytest.approx(len(set(got[3]) & set(got[1])) / len(got[3]))


def without_repeated_lines(rows):
    first, gone = {}, collections.defaultdict(set)
    for i, t in sorted(rows):
        lines = t.split("\n")
        for at in range(len(lines) - 2):
            if first.setdefault(tuple(lines[at : at + 3]), (i, at)) != (i, at):
                gone[i].update(range(at, at + 3))
    out = [(i, [x for n, x in enumerate(t.split("\n")) if n not in gone[i]]) for i, t in rows]
    return {(i, "\n".join(x)) for i, x in out if x}


def without_near_copies(rows):
    kept = {i for i, _, c in jaccard_classes(rows, 5, 80) if i == c}
    return {(i, t) for i, t in rows if i in kept}


def without_repeated_passages(rows):
    """Without repeated runs of over 50 whole words, found by windows of 200 bytes."""
    blobs = {i: t.encode() for i, t in rows}
    count = collections.Counter(b[s : s + 200] for b in blobs.values() for s in range(len(b) - 199))
    out = set()
    for i, b in blobs.items():
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s + 1 : s + 201] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        for x, y in zip(edges[::2], edges[1::2], strict=True):
            words = sum(x <= m.start() and m.end() <= y for m in re.finditer(rb"[^ \t-\r]+", b))
            if words <= 50:
                gone[x + 1 : y + 1] = False
        if not len(b) or not gone[1:-1].all():
            out.add((i, bytes(x for x, g in zip(b, gone[1:], strict=False) if not g).decode(errors="ignore")))
    return out


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    brute = [None, without_repeated_lines, without_near_copies, without_repeated_passages]
    sizes = [docs.count()]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, brute, strict=False):
        out = stage(spark, docs.withColumn("extra", F.lit(1)), sf)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        rows = out.collect()
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        if expected:
            assert {(r.doc_id, r.text or "") for r in rows} == expected([(r.doc_id, r.text) for r in docs.collect()]), name
        docs = spark.createDataFrame(rows, out.schema)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.classify(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    known = [i for i in labels if labels[i] is not None]
    assert sum((i in kept) == (labels[i] == 1) for i in known) >= 0.97 * len(known)


def test_pipeline_on_empty_and_odd_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = [(1, None, None, None, None), (1, "", None, None, 0), (None, "no id " * 30, "en", "s", 1), (2, "a", None, "s", 1), (2, "a", None, "s", 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert tuple(out.columns) == corpus_pipeline.COLUMNS and out.count() <= max(len(rows), 0), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)]))
        bits = [ngram_join.parity_bits(x) for x in (a, b)]
        size = min(map(len, bits)) * 8
        x, y = (ngram_join.folded(int.from_bytes(s, "little"), 8 * len(s), size) for s in bits)
        assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("name", ["HOT", "FEW"])
def test_ngram_join_with_frequent_tokens(spark, monkeypatch, name):
    monkeypatch.setattr(ngram_join, name, 1)
    rows = corpus(13)
    got = {tuple(r) for r in ngram_join.ngram_components(frame(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == jaccard_classes(rows, 4, 85)


def test_pipeline_takes_passages_of_51_words_under_400_bytes(spark):
    import corpus_pipeline

    rng = random.Random(21)

    def fresh(n):
        return " ".join(f"{rng.randrange(36**4):04x}" for _ in range(n))

    passage, shorter = "\n".join(fresh(17) for _ in range(3)), fresh(50)
    assert len(passage) < 400
    heads = [fresh(40) for _ in range(4)]
    rows = [(1, f"{heads[0]}\n{passage} end\nof 1"), (2, f" {heads[1]}\n\n{passage}\tfin  de\n2"), (3, f"{heads[2]} {shorter} 3"), (4, f"{heads[3]} {shorter} 4"), (5, passage), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], PIPELINE_ROWS)
    got = {r.doc_id: r.text or "" for r in corpus_pipeline.dedup_passages(spark, docs, "").collect()}
    want = {**dict(rows), 1: f"{heads[0]} end\nof 1", 2: f" {heads[1]}\n\tfin  de\n2", 6: ""}
    del want[5]
    assert got == want


PIPELINE_ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_rows_that_share_an_id(spark):
    rng = random.Random(23)
    a, b, c = (" ".join(words(rng, 60, 10_000)) for _ in range(3))
    rows = [(5, a), (5, b), (1, a), (None, c), (None, None), (7, c)]
    names = "__other bigint, __id bigint, __deleted bigint, deleted bigint, key_a bigint, key_b bigint, lines bigint, spans bigint, copy bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *[1] * 9) for i, t in rows], f"{PIPELINE_ROWS}, {names}")
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(5, b), (1, a), (0, c), (0, ""), (7, c)])
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == [*docs.columns, "n_lines", "n_deleted", "n_runs"] and lines.count() == len(rows)
    junk = "#### !!!! $$$$ " * 40
    mixed = spark.createDataFrame([(i, " ".join(words(rng, 80)), "en", "s", 0, *[1] * 9) for i in range(40)] + [(100 + i, f"{junk}{i}", "en", "s", 0, *[1] * 9) for i in range(40)] + [(3, junk, "en", "s", 0, *[1] * 9), (None, junk, "en", "s", 0, *[1] * 9)], f"{PIPELINE_ROWS}, {names}")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in (*range(5, 30), *range(105, 130))], "doc_id long, quality int")
    good = quality.keep_good(mixed, labels)
    assert good.columns == mixed.columns and {r.doc_id for r in good.collect()} == set(range(40)) and good.count() == 40
    twice = suffix_dedup.dedup_suffixes(spark.createDataFrame([(5, f"{a} {b}"), (5, f"{b} {c}"), (6, "short"), (6, "short")], "doc_id long, text string"), 200, with_text=True)
    assert sorted((r.doc_id, r.n_removed > 0) for r in twice.collect()) == [(5, True), (5, True), (6, False), (6, False)]


def test_passages_are_counted_beside_the_windows(spark):
    rng = random.Random(24)
    passage, long = (" ".join(f"{rng.randrange(36**4):04x}" for _ in range(n)) for n in (52, 120))
    own = [" ".join(words(rng, 30, 10_000)) for _ in range(5)]
    rows = [(1, f"{own[0]} {passage} {own[1]}"), (2, f"{passage} {own[2]}"), (3, f"{own[3]} {long}"), (4, f"{long} {own[4]}"), (5, own[0][:150])]
    plain = {tuple(r) for r in suffix_dedup.dedup_suffixes(frame(spark, rows)).collect()}
    both = suffix_dedup.dedup_suffixes(frame(spark, rows), passages=True).collect()
    assert {tuple(r)[:-1] for r in both} == plain
    got = {r.doc_id: (r.n_removed, r.n_passage_bytes) for r in both}
    assert all(got[i][0] == 0 and got[i][1] >= len(passage) for i in (1, 2)) and all(got[i][0] == got[i][1] >= len(long) for i in (3, 4)) and got[5] == (0, 0)


def test_packing_spreads_null_and_repeated_ids(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "PACKED", 100)
    rows = [(None, f"text {i}") for i in range(800)] + [(None, None)] * 800 + [(7, "same")] * 800
    out = packing.pack_documents(frame(spark, rows), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(out) == 2400 and max(collections.Counter(r.sequence_id >> 31 for r in out).values()) < 300
