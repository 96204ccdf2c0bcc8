"""Ranked search against scores of all documents, and the reordering under it."""

import collections
import math
import random
import re

import numpy as np
import pytest

from quillspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(i, collections.Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    N, L = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if i is not None}:
        scores = []
        for doc_id, c in docs:
            m = 25 + (75 * sum(c.values()) * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, doc_id))
        out += [(item_id, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(seed=1, n=700):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["É", "é", "naïve", "x-y", "日本", "1984"]
    rows = []
    for i in range(n):
        topic = (i % 9) * 30
        rows.append((3 * i - 50, rng.choice([" ", ", ", "\n"]).join(words[min(int(rng.expovariate(0.08)) + topic, len(words) - 1)] for _ in range(rng.randrange(1, 120)))))
    rows += [(9000 - i, rows[5][1]) for i in range(70)]  # copies: ties by doc_id
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[0][1]), (6001, None), (6002, ""), (6003, "--- !!!"), (6004, "W1 " * 40_000)]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 12)))) for i in range(30)]
    items += [(100, rows[5][1]), (101, rows[11][1].upper()), (102, "w1 w1 w1 W2"), (103, ""), (104, None), (None, "w1"), (105, "unknown words"), (106, "unknown w7"), (107, "w3"), (107, "w4"), (108, "w5"), (108, "w5"), (109, "é naïve 日本")]
    return rows, items


def frames(spark, rows, items):
    return spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, rank string, score int").repartition(4), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize(("sample", "asked"), [(4096, 1 << 18), (40, 60), (0, 1 << 18)])
def test_equals_all_scores(spark, sample, asked):
    """Whatever the sample that the tree is fitted to and the blocks of queries."""
    rows, items = corpus()
    docs, asks = frames(spark, rows, items)
    got = sorted(tuple(r) for r in lexical.ranked_search(docs, asks, sample=sample, asked=asked).collect())
    assert got == brute(rows, items)


def test_nothing_to_search(spark):
    rows, items = corpus(n=20)
    docs, asks = frames(spark, rows, items)
    assert lexical.ranked_search(docs.where("false"), asks).count() == 0
    assert lexical.ranked_search(docs, asks.where("false")).count() == 0
    assert lexical.ranked_search(docs.where("doc_id IN (6001, 6002, 6003)"), asks).count() == 0


def test_queries_stop_before_all_shards(spark, tmp_path):
    """Topics of their own words: bounds rule out other topics' shards."""
    rng = random.Random(2)
    rows = [(i, [i % 10 * 1000 + rng.randrange(40) for _ in range(30)]) for i in range(3000)]
    index = spark.createDataFrame([(i, 100, sorted(set(t)), [1] * len(set(t))) for i, t in rows], "doc_id long, m long, terms array<long>, tfs array<int>")
    shards = lexical.clustered_index(index, str(tmp_path / "shards"))
    held = shards.collect()
    assert sorted(i for r in held for i in r.ids) == list(range(3000)) and all(len(r.ids) <= 64 for r in held)
    asked = [(i, i % 10 * 1000 + t, 1000) for i in range(20) for t in range(i % 7, 40, 6)]
    best, visited = lexical._search(shards, asked, 10)
    assert best.count() == 200 and sum(visited) < 0.5 * 20 * len(held)


def test_bisection_keeps_sizes_and_parts_topics():
    rng = np.random.default_rng(3)
    topic = rng.permutation(np.arange(200) % 2)
    doc = np.repeat(np.arange(200), 12)
    term = rng.integers(0, 50, len(doc)) + 50 * topic[doc]
    part = lexical.bisect(doc, term, 200, 1)
    assert np.bincount(part).tolist() == [100, 100] and len(set(zip(part.tolist(), topic.tolist(), strict=True))) == 2
    assert sorted(np.bincount(lexical.bisect(doc[:60], term[:60], 7, 2), minlength=4).tolist()) == [1, 2, 2, 2]
    assert sorted(lexical.bisect(doc[:0], term[:0], 4, 2).tolist()) == [0, 1, 2, 3]
