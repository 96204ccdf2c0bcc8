"""Spelling variants against all pairs of a small vocabulary."""

import collections
import random
import re
import zlib

import pytest

from quillspark.llm import spelling


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        if vs and words[best := min(vs, key=lambda v: (-words[v], v))] >= 2 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé×") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "ababab", "x" * 40, "x" * 41, "y" + "x" * 40]
    rows = []
    for i in range(300):
        w = [rng.choice(stems[: rng.randrange(1, len(stems))]) for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "-", "\n", "1"]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    return [*rows, (None, "ababab aaaaa" * 3), (7, None), (8, ""), (8, "aaaaa " * 4), (9, "ÀÉÎÖÜ àéîöü ÀÉÎÖÜ ÀÉÎÖÜ αβγδε " * 3), (10, ("long" * 5000 + " ") * 3), (11, ("long" * 4999 + "lond ") * 7)]


@pytest.mark.parametrize("trie", [1 << 18, 200, 10])
def test_equals_all_pairs_of_the_vocabulary(spark, trie):
    """Small tries are split again and again, with the same result."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = [tuple(r) for r in spelling.spelling_variants(df, trie=trie).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    expected = brute(rows)
    assert set(got) == expected and any(r[1] != r[2] for r in expected if r[1]) and len(expected) > 60


def test_pairs_at_distance_one_in_a_trie():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(60)})
    got = list(spelling.near_in_trie(words, 0))
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if distance_one(a, b)}


def test_one_long_word_and_nothing(spark):
    df = spark.createDataFrame([(1, "z" * 1_000_000), (2, "z" * 1_000_000), (3, "z" * 1_000_000), (4, "z" * 999_999 + " " + "z" * 999_999 + " " + "z" * 999_999)], "doc_id long, text string")
    got = {(len(r.word), r.n, r.n_near, r.form) for r in spelling.spelling_variants(df, noise=0).collect()}
    assert got == {(1_000_000, 3, 1, None), (999_999, 3, 1, None)}
    assert spelling.spelling_variants(df.where("false")).count() == 0
