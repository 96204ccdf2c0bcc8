"""What keeps work in proportion to large tables: files of the split sink, rows of a task."""

from pyspark.sql import functions as F

from quillspark import session
from quillspark.operators import graph, intervals, layout
from quillspark.plans import structure
from quillspark.sources import sinks


def test_a_split_into_bundles_can_run_again(spark, tmp_path):
    df = spark.createDataFrame([(d, p, f"{d}.{p}.{k}") for d in range(50) for p in range(3) for k in range(1 + p)] + [(None, 0, "x"), (4, None, "y")], "doc long, page_index long, text string")
    path = str(tmp_path / "out")
    columns = ("doc", "page_index", "n_rows", "digest")
    first = sorted(map(tuple, sinks.split_bundles(df, path, "doc").select(*columns).collect()))
    assert first == sorted(map(tuple, sinks.split_pages(df, str(tmp_path / "folders"), "doc").collect())) and len(first) == 150
    assert len(list((tmp_path / "out" / "pages").glob("**/*.parquet"))) <= 4
    for r in sinks.bundle_manifest(spark, path, "doc").where("doc = 7").collect():
        rows = spark.read.parquet(f"{path}/pages/run={r.run}/{r.file}").where((F.col("doc") == 7) & (F.col("page_index") == r.page_index))
        assert rows.count() == r.n_rows
    (tmp_path / "out" / "pages" / "run=2").mkdir()  # a run that was cut off
    df.where("doc = 2").write.mode("overwrite").parquet(f"{path}/pages/run=2")
    assert sorted(map(tuple, sinks.bundle_manifest(spark, path, "doc").select(*columns).collect())) == first
    assert sinks.bundled_pages(spark, path, "doc").count() == 300
    new = df.where("doc = 2 AND page_index = 1").limit(1).withColumn("text", F.lit("new"))
    changed = sinks.split_bundles(new, path, "doc").select(*columns).collect()
    assert len(changed) == 150 and sorted(tuple(r) for r in changed if r[:2] != (2, 1)) == [x for x in first if x[:2] != (2, 1)]
    assert [r.text for r in sinks.bundled_pages(spark, path, "doc").where("doc = 2 AND page_index = 1").collect()] == ["new"]
    assert sinks.bundled_pages(spark, path, "doc").count() == 299


def test_the_split_query_has_fewer_files_than_pages(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(30) for t in range(3)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "in" / "conversations.parquet"))
    monkeypatch.setattr(structure, "shared_folder", lambda spark, kind: str(tmp_path / kind))
    monkeypatch.setattr(structure, "remove", lambda spark, folder: None)
    got = structure.split_outputs(spark, str(tmp_path / "in")).collect()
    assert len(got) == 90 and {r.n_rows for r in got} == {1}
    assert len(list((tmp_path / "split").glob("**/*.parquet"))) < 20


def tasks(df):
    """How many tasks the rows of df come from."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_byte_ranges_go_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    ranges = spark.range(2000).select((F.col("id") % 500).alias("file"), (F.col("id") * 7).alias("start"), F.lit(10).alias("length"))
    sizes = spark.range(500).select(F.col("id").alias("file"), F.lit(9000).alias("size"))
    got = intervals.integrity_findings(ranges, sizes, ["file"])
    assert tasks(got) >= 20 and got.where("finding = 'head'").count() == 499


def test_reachability_goes_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    edges = spark.range(3000).select((F.col("id") % 30).alias("src"), (F.col("id") + 100).alias("dst"))
    edges = edges.unionAll(edges)
    found = graph.hops(edges, spark.range(30), 1).where("hop = 1")
    assert found.count() == 3000 and tasks(found) >= 20
    met = graph.unreachable(spark.range(5000), edges, spark.range(30))
    assert met.count() == 5000 - 3030


def test_chains_go_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    nodes = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") - 1).alias("parent"))
    found = graph.qualified_names(nodes.withColumn("name", F.lit("n"))).where("path = 'n.n'")
    assert found.count() == 1000 and tasks(found) >= 20


def test_columns_are_cut_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    k = F.col("id") % 10
    elements = spark.range(3000).select((F.col("id").cast("long") / 10).cast("int").alias("page"), "id", (k % 2 * 300.0).alias("x"), (F.floor(k / 2) * 20.0).alias("y"), F.lit(10.0).alias("font_size"))
    got = layout.cut_columns(elements, ["page"])
    assert tasks(got) >= 20 and got.where((F.col("band") == "1") == (F.col("x") == 300)).count() == 3000
