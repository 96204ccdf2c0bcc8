"""Line dedup by hashes of windows of lines, in DataFrame functions only.

The smallest line hash of each window of `lines` consecutive lines is a fingerprint, so any run of
that many equal lines shares one with every copy. Windows around fingerprints that occur at
more than one place are matched with the earliest place that has the same lines; matched windows
that touch or overlap are one run; runs that aren't the earliest are deleted. Positions of fingerprints
are not joined and matches not extended: fingerprints only drop windows that can't repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import unused

#: A repeated run has at least so many lines.
LINES = 3


def line_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, copy, at, place, mark, key_a, key_b): windows of lines of a text (copy: its digest), where their fingerprint stands, its hash, and the hash of all their lines."""
    df = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("copy"), F.split("text", "\n").alias("_lines"))
    df = df.select(
        "doc_id",
        "copy",
        F.transform("_lines", lambda x: F.xxhash64(x)).alias("_h"),
        F.transform("_lines", lambda x: F.xxhash64(x, F.lit(1))).alias("_g"),
    ).where(F.size("_h") >= lines)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_h") - lines),
        lambda i: F.struct(
            i.alias("at"),
            F.array_min(F.slice("_h", i + 1, lines)).alias("mark"),
            F.array_position(F.slice("_h", i + 1, lines), F.array_min(F.slice("_h", i + 1, lines))).cast("int").alias("step"),
            F.xxhash64(F.slice("_h", i + 1, lines)).alias("key_a"),
            F.xxhash64(F.slice("_g", i + 1, lines)).alias("key_b"),
        ),
    )
    return df.select("doc_id", "copy", F.explode(windows).alias("w")).select("doc_id", "copy", "w.at", (F.col("w.at") + F.col("w.step") - 1).alias("place"), "w.mark", "w.key_a", "w.key_b")


def repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, copy, deleted): the numbers, from 0, of the lines of later repeated runs, sorted; only documents that have any."""
    windows = line_windows(docs, lines)
    place = F.struct("doc_id", "copy", "place")
    marks = windows.groupBy("mark").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a != _b").select("mark")
    near = windows.join(marks, "mark").select("doc_id", "copy", "at", "key_a", "key_b")
    at = F.struct("doc_id", "copy", "at")
    first = near.groupBy("key_a", "key_b").agg(F.min(at).alias("first"), F.max(at).alias("_last")).where("first != _last").select("key_a", "key_b", "first")
    later = near.join(first, ["key_a", "key_b"]).where(at > F.col("first"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda i: F.sequence(i, i + (lines - 1))))))
    return later.groupBy("doc_id", "copy").agg(covered.alias("deleted"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with the lines of later repeated runs taken out of text; adds n_lines, n_deleted and n_runs.

    A line goes if it lies in a run of at least `lines` lines (separated by a line feed; compared as
    they are) that also begins at an earlier place: in a document with a smaller doc_id, or
    further up in the same one. Runs are judged on the input. Documents with fewer lines stay as they are.

    docs needs doc_id and text; all other columns pass through, whatever their names. A null text
    stays null and has no lines; an empty text has one. Rows without doc_id pass unchanged. Rows that share a doc_id
    are told apart by their texts (in the order of their digests); equal rows count once and lose the same lines. An empty table gives an empty result.
    """
    return without_lines(docs, repeated_lines(docs, lines))


def without_lines(docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """docs without the lines whose numbers deleted (doc_id, copy, deleted: sorted) has; adds n_lines, n_deleted and n_runs."""
    doc_id, copy, numbers, lines = unused(docs, "of", "copy_of", "deleted", "lines")
    gone, text = F.col(numbers), F.col("text")
    found = deleted.select(F.col("doc_id").alias(doc_id), F.col("copy").alias(copy), F.col("deleted").alias(numbers))
    out = docs.join(found, (F.col("doc_id") == F.col(doc_id)) & (F.xxhash64("text") == F.col(copy)), "left")
    out = out.withColumn(lines, F.when(gone.isNotNull(), F.split(text, "\n")))
    stays = F.array_except(F.sequence(F.lit(0), F.size(F.col(lines)) - 1), gone)
    new = {
        "text": F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col(lines), i)), "\n")),
        "n_lines": F.when(text.isNull(), 0).otherwise(F.coalesce(F.size(F.col(lines)), F.size(F.split(text, "\n")))).cast("long"),
        "n_deleted": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        # a run begins where the number before isn't the one below
        "n_runs": F.coalesce(F.size(F.filter(gone, lambda x, i: (i == 0) | (x != F.get(gone, i - 1) + 1))), F.lit(0)).cast("long"),
    }
    names = [c for c in docs.columns if c not in new or c == "text"]
    return out.select(*[new["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in names], *[new[c].alias(c) for c in ("n_lines", "n_deleted", "n_runs")])
