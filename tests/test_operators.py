"""Invariants of the operators on small made-up tables."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import graph, groups, lookups, pages, rules, search


def test_phrase_offsets_overlap_and_count_code_points(spark):
    df = spark.createDataFrame([(1, "elele"), (2, "😀ele"), (3, ""), (4, None), (5, "xx")], "id int, text string")
    got = {(r.id, r.start, r.end) for r in search.phrase_fragments(df, "ele", ["id"]).collect()}
    assert got == {(1, 0, 3), (1, 2, 5), (2, 1, 4)}
    with pytest.raises(ValueError):
        search.phrase_fragments(df, "", ["id"])


def test_phrase_without_case(spark):
    df = spark.createDataFrame([(1, "aBc abC")], "id int, text string")
    assert {r.start for r in search.phrase_fragments(df, "ABC", ["id"], case_sensitive=False).collect()} == {0, 4}


def test_fragments_are_substrings(spark):
    df = spark.createDataFrame([(1, "  a b \n\n c9 10\t"), (2, "7")], "id int, text string")
    for found in (search.line_fragments(df, ["id"]), search.regex_fragments(df, "[0-9]+", ["id"])):
        rows = found.join(df, "id").withColumn("cut", F.expr("substring(text, int(start) + 1, int(end - start))")).collect()
        assert rows and all(r.cut == r.txt for r in rows)


def test_quota_is_spent_in_page_order(spark):
    df = spark.createDataFrame([(1, 0, "a.a"), (1, 1, "aa"), (1, 2, "a"), (2, 0, "b")], "d int, p int, text string")
    got = {(r.d, r.p): (r.text, r.n_replaced) for r in search.replace_with_quota(df, "a", "X", 3, ["d"], "p").collect()}
    assert got == {(1, 0): ("X.X", 2), (1, 1): ("Xa", 1), (1, 2): ("a", 0), (2, 0): ("b", 0)}


def test_pages_stay_without_gaps(spark):
    df = spark.createDataFrame([(d, i, f"{d}{i}") for d, n in ((1, 5), (2, 1)) for i in range(n)], "doc_id int, page_index long, text string")
    new = spark.createDataFrame([(1, "n"), (2, "n")], "doc_id int, text string")
    for out in (pages.delete_pages(df, ["doc_id"], [2, 9]), pages.insert_pages(df, new, 3, ["doc_id"]), pages.extract_range(df, ["doc_id"], 2, 3), pages.move_page(df, ["doc_id"], 0, 2), pages.append_blank(df, ["doc_id"])):
        for d in (1, 2):
            found = sorted(r.page_index for r in out.where(F.col("doc_id") == d).collect())
            assert found == list(range(len(found)))
    assert [r.text for r in pages.move_page(df, ["doc_id"], 0, 2).where("doc_id = 1").orderBy("page_index").collect()] == ["11", "12", "10", "13", "14"]


def test_range_lookup_takes_the_first_layer(spark):
    codes = spark.createDataFrame([(5.0,), (15.0,), (99.0,)], "code double")
    ranges = spark.createDataFrame([(2, 0.0, 20.0), (1, 10.0, 30.0)], "layer int, lo double, hi double")
    assert {(r.code, r.layer) for r in lookups.range_lookup(codes, ranges, "code", 7.0).collect()} == {(5.0, 2), (15.0, 1), (99.0, None)}


def test_chains_and_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (8, 9, "x"), (9, 8, "y")], "id long, parent long, name string")
    assert {(r.id, r.root, r.depth) for r in graph.chain_depths(nodes).collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2)}
    assert {r.path for r in graph.qualified_names(nodes.where("id < 8")).collect()} == {"a", "a.b", "a.b.c"}


def test_chains_of_100_steps_and_cycles(spark):
    chain = [(i, i - 1 if i else None, str(i)) for i in range(101)] + [(200, 201, "x"), (201, 200, "y"), (202, 201, "z"), (300, 999, "orphan")]
    nodes = spark.createDataFrame(chain, "id long, parent long, name string")
    assert {(r.id, r.depth) for r in graph.chain_depths(nodes).collect()} == {(i, i) for i in range(101)}
    paths = {r.id: r.path for r in graph.qualified_names(nodes).collect()}
    assert paths[100] == ".".join(map(str, range(101))) and paths[300] == "orphan" and set(paths) == {*range(101), 300}
    links = nodes.where("id < 299").select(F.col("parent").alias("id"), F.col("id").alias("next")).where("id IS NOT NULL")
    assert {(r.id, r.head, r.place) for r in graph.walk_chains(links).collect()} == {(i, 0, i) for i in range(101)}
    assert {r.id for r in graph.unreachable(nodes.select("id"), links.select(F.col("id").alias("src"), F.col("next").alias("dst")), nodes.where("id = 50").select("id")).collect()} == {*range(50), 200, 201, 202, 300}


def test_offsets_of_rows_with_equal_keys_do_not_mix(spark):
    text = "\n".join(f"line {i}" for i in range(700))
    df = spark.createDataFrame([(1, text), (1, "x\n" + text), (1, None), (1, "")], "id int, text string")
    found = sorted((r.start, r.end, r.txt) for r in search.line_fragments(df, ["id"]).collect())
    expected = sorted((t.index(f"line {i}\n") if i < 699 else len(t) - 8, (t.index(f"line {i}\n") if i < 699 else len(t) - 8) + len(f"line {i}"), f"line {i}") for t in (text, "x\n" + text) for i in range(700))
    assert found == sorted([*expected, (0, 1, "x")])


def test_visibility(spark):
    states = spark.createDataFrame([(1, None)], "g int, on boolean")
    assert all(states.groupBy("g").agg(rules.visible(p, "on").alias("v")).first().v for p in ("AllOn", "AnyOn", "AnyOff", "AllOff"))
    nodes = [(1, None, 0, "Not", None), (2, 1, 0, "And", None), (3, 2, 0, None, True), (4, 2, 1, None, None), (5, None, 0, "And", None), (6, None, 0, "Nor", None), (7, 6, 0, None, True)]
    got = {r.id: r.value for r in graph.expression_values(spark.createDataFrame(nodes, "id long, parent long, place long, op string, value boolean")).collect()}
    assert got == {1: False, 5: None, 6: None}


def test_medians_are_exact(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 5.0), ("a", 7.0), ("b", 2.0), ("b", None)], "g string, v double")
    assert {(r.g, r.median) for r in groups.exact_medians(df, "g", "v").collect()} == {("a", 3.0), ("b", 2.0)}


def test_tiers_are_relative_to_their_head(spark):
    df = spark.createDataFrame([([24.0, 23.5, 18.0, 12.0],)], "s array<double>")
    out = df.select(groups.head_relative_tiers(F.col("s"), 1.05, 3).alias("t")).first().t
    assert [(r["size"], r["tier"]) for r in out] == [(24.0, 1), (23.5, 1), (18.0, 2), (12.0, 3)]


def test_limits(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "id int, n int")
    found = rules.limit_violations(df, ["id"], {"max_chars": F.col("n")}, rules.Limits(max_chars=5)).collect()
    assert [(r.id, r.value, r.cap) for r in found] == [(2, 6, 5)]
    assert rules.limit_violations(df, ["id"], {"max_chars": F.col("n")}, rules.Limits.unlimited()).count() == 0
    with pytest.raises(ValueError):
        rules.Limits(max_chars=True)


def test_dates_and_octal(spark):
    df = spark.createDataFrame([("D:2024",), ("D:20240203040506Z",), ("D:20240203040506+01'30",), ("x",)], "d string")
    assert [r[0] for r in df.select(scalars.tagged_date_to_iso(F.col("d"))).collect()] == ["2024-01-01", "2024-02-03T04:05:06Z", "2024-02-03T04:05:06+01:30", ""]
    df = spark.createDataFrame([("17",), ("8",), ("",)], "o string")
    assert [r[0] for r in df.select(scalars.from_octal(F.col("o"))).collect()] == [15, None, None]
