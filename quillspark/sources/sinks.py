"""Sinks that can be run again: one output a page, with a manifest of what was written.

`split_pages` gives each page a folder of its own, for some thousands of pages; `split_bundles` puts many pages into a file, for any number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _digest(content: list[str]) -> Column:
    """The sum over a page's rows of their checksums."""
    return F.sum(F.crc32(F.to_json(F.struct(*content)).cast("binary")) if content else F.lit(0).cast("long"))


def split_pages(pages: DataFrame, path: str, document: str, page: str = "page_index") -> DataFrame:
    """Write each page to a folder of its own under path/pages, and return the manifest, which is kept under path/manifest.

    Folders are partitions (document, page): a second run replaces those of the pages that it has, in whole, and leaves the others. Rows are dealt by a hash of both, so a
    document's pages are written by many tasks and each folder gets one file. The manifest (document, page, n_rows, digest of the rows) is read from what was
    written, partitioned by document, and replaced in the same way; so a run that was cut off is mended by running it again.
    """
    where = f"{path}/pages"
    dealt = pages.where(F.col(document).isNotNull() & F.col(page).isNotNull()).repartition(document, page)
    dealt.write.partitionBy(document, page).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(where)
    spark = pages.sparkSession
    touched = pages.select(document, page).where(F.col(document).isNotNull()).distinct()
    content = [c for c in pages.columns if c not in (document, page)]
    kinds = {c: pages.schema[c].dataType for c in (document, page)}
    written = spark.read.parquet(where).withColumns({c: F.col(c).cast(t) for c, t in kinds.items()})
    documents = touched.select(document).distinct()
    manifest = written.join(documents, document, "left_semi").groupBy(document, page).agg(F.count("*").alias("n_rows"), _digest(content).alias("digest"))
    manifest.repartition(document).write.partitionBy(document).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest").withColumn(document, F.col(document).cast(kinds[document])).select(document, page, "n_rows", "digest")


def split_bundles(pages: DataFrame, path: str, document: str, page: str = "page_index") -> DataFrame:
    """Write all pages, many to a file, and return the manifest: (document, page, n_rows, digest, run, file).

    A page's rows lie together in one file, in order of document and page, and the manifest names it; so files are as many as the data needs, not as many as pages. A run writes files of its
    own under path/pages/run=n, reads them again for its manifest, and counts once that is moved to path/manifest/run=n. Nothing is replaced in place: of a page that several runs
    have, the last one's rows stand, in whole, and pages that a run doesn't have stay. A run that was cut off counts for nothing and is mended by running it again. One run at a time.
    """
    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at(f"{path}/manifest"))] if files.exists(at(f"{path}/manifest")) else []
    run = 1 + max((int(n.removeprefix("run=")) for n in names if n.startswith("run=")), default=0)
    rows = pages.where(F.col(document).isNotNull() & F.col(page).isNotNull()).repartition(document, page).sortWithinPartitions(document, page)
    rows.write.mode("overwrite").parquet(f"{path}/pages/run={run}")
    content = [c for c in pages.columns if c not in (document, page)]
    written = spark.read.schema(rows.schema).parquet(f"{path}/pages/run={run}")
    manifest = written.groupBy(document, page).agg(F.count("*").alias("n_rows"), _digest(content).alias("digest"), F.min(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("file"))
    made = f"{path}/made-{uuid.uuid4().hex}"
    manifest.write.parquet(made)
    files.mkdirs(at(f"{path}/manifest"))
    if not files.rename(at(made), at(f"{path}/manifest/run={run}")):
        raise OSError(f"could not put the manifest of run {run} in place")
    return bundle_manifest(spark, path, document, page)


def bundle_manifest(spark: SparkSession, path: str, document: str, page: str = "page_index") -> DataFrame:
    """(document, page, n_rows, digest, run, file) of all pages that split_bundles wrote to path; file lies in path/pages/run=run."""
    all_runs = spark.read.parquet(f"{path}/manifest")
    last = all_runs.groupBy(document, page).agg(F.max_by(F.struct("n_rows", "digest", F.col("run").cast("long").alias("run"), "file"), "run").alias("_last"))
    return last.select(document, page, "_last.*")


def bundled_pages(spark: SparkSession, path: str, document: str, page: str = "page_index") -> DataFrame:
    """The rows of all pages that split_bundles wrote to path."""
    stands = bundle_manifest(spark, path, document, page).select(document, page, "run")
    rows = spark.read.parquet(f"{path}/pages").withColumn("run", F.col("run").cast("long"))
    return rows.join(stands, [document, page, "run"], "left_semi").drop("run")
