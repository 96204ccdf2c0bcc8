"""Rows that share a doc_id lose only what was found for their own text; intermediate tables stay in the shared folder; texts of megabytes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import fingerprint, line_dedup, ngram_join, sharding, substring_index, suffix_dedup

A, B = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")


def test_substring_dedup_tells_rows_apart_by_their_texts(spark):
    rows = [(1, A), (5, A), (5, B), (5, B + " " + A), (7, B)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_index.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 60, 0), (5, 60, 0), (5, 60, 60), (5, 120, 60), (7, 60, 60)]


def test_line_dedup_tells_rows_apart_by_their_texts(spark):
    one, other = "a\nb\nc\nd", "u1\nu2\nu3\nu4"
    rows = [(1, one), (5, one), (5, other), (5, one)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), 0, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copy int, `of` int")
    got = sorted((r.doc_id, r.text, r.n_deleted) for r in line_dedup.dedup_lines(df).collect())
    assert got == [(1, one, 0), (5, "", 4), (5, "", 4), (5, other, 0)]
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_lines(spark, df, "").collect())
    assert kept == [(1, one), (5, other)]


def test_runs_of_the_index_are_in_the_shared_folder_and_go(spark):
    index = substring_index.FingerprintIndex(spark, buckets=2)
    for b in range(3):
        index.add(spark.createDataFrame([(h, 10 * b + h) for h in range(b, b + 3)], "hash long, copy long"))
    warehouse = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    folder = Path(index.folder.removeprefix("file:"))
    assert len(list(folder.glob("*/*.parquet"))) > 1 and not list(warehouse.rglob("*.parquet"))
    assert len(list(folder.iterdir())) == len(index.runs)
    index.drop()
    assert not list(folder.iterdir())


LONG = " ".join(f"word{i % 9973}" for i in range(250_000))


@pytest.mark.parametrize(
    "f",
    [
        lambda d: ngram_join.ngram_components(d).where("n_shingles > 0"),
        lambda d: sharding.shard_documents(d),
        lambda d: substring_index.dedup_substrings(d).where("n_words >= 1"),
        lambda d: line_dedup.dedup_lines(d),
        lambda d: fingerprint.edited_fingerprints(d),
        lambda d: suffix_dedup.dedup_suffixes(d).where("n_bytes > 0"),
    ],
)
def test_texts_of_megabytes_and_single_words_of_a_million_letters(spark, f):
    rows = [(1, LONG), (2, LONG + " end"), (3, "x" * 1_000_000), (4, "short text of a few words")]
    assert f(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.count("*")).first()[0] == 4
