"""A corpus pipeline over documents: reject junk, drop repeated lines, near-duplicates and repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns of
documents (doc_id, text, lang, source, n_chars), n_chars being kept in step with text. Documents
that a stage leaves without any text go. Extra columns of docs are not carried on. Rows without doc_id
pass the stages that compare documents by their ids; packing takes them too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import line_dedup, ngram_join, packing, quality, suffix_dedup
from quillspark.llm.registry import tokenizer_file
from quillspark.session import remove, shared_folder, ship
from quillspark.sources import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to labels, doesn't reject."""
    ship(spark)
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines go; so do documents that consisted of nothing else."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _documents(out.where("n_deleted = 0 OR n_deleted < n_lines"))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each class of near-duplicates."""
    ship(spark)
    return ngram_join.keep_one_of_each(docs.select(*COLUMNS))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur elsewhere too go; so do documents that consisted of nothing else.

    Passages are found by windows of 200 bytes, less than the operator's own query has: 50 words of
    these texts take about 310 bytes. Repeats of fewer words stay, and so do passages of over 50 words in less than 200 bytes.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    out = suffix_dedup.dedup_suffixes(docs, suffix_dedup.PASSAGE_BYTES, words=suffix_dedup.PASSAGE_WORDS + 1, with_text=True, also=("lang", "source"))
    # a null text is an empty one from here on
    out = out.where("n_removed = 0 OR n_removed < n_bytes").withColumnRenamed("kept", "text")
    return _documents(out).unionByName(docs.where("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its place in a sequence."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_near),
    ("suffix_array_dedup", dedup_passages),
    ("packing", pack),
]

#: SQL can't express the classifier, the byte-wise dedup and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What each but the last returns is written to the shared folder and read again; then what it was made of goes."""
    folder, docs, before = shared_folder(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
