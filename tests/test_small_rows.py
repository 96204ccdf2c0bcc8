"""Search without case, quotas, dates, names, operands, aliases, pages and nested operators on made-up rows."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars
from quillspark.operators import graph, lookups, pages, runs, search


def test_phrases_of_all_scripts_without_case(spark):
    texts = ["xé É e", "ΣΑΣ σας", "ПРИВЕТ привет", "İi", "a.B+c A.b+C", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for phrase in ("é", "σα", "привет", "a.b+c"):
        got = {(r.id, r.start, r.end) for r in search.phrase_fragments(df, phrase, ["id"], case_sensitive=False).collect()}
        assert got == {(i, m.start(), m.start() + len(phrase)) for i, t in enumerate(texts) for m in re.finditer(f"(?=({re.escape(phrase)}))", t or "", re.I)}
    assert {r.txt for r in search.regex_fragments(df, "é+", ["id"], case_sensitive=False).collect()} == {"é", "É"}


def test_replace_and_redact_without_case_and_with_quotas(spark):
    rows = [(1, 0, "Éa éa x"), (1, 1, "ÉAéa"), (1, 2, "éa"), (2, 0, None), (2, 1, "ea $1 ÉA")]
    df = spark.createDataFrame(rows, "d int, p int, text string")
    all_ = {(r.d, r.p): (r.text, r.n_replaced) for r in search.replace_text(df, "éA", r"$0\1", case_sensitive=False).collect()}
    assert all_ == {(1, 0): (r"$0\1 $0\1 x", 2), (1, 1): (r"$0\1$0\1", 2), (1, 2): (r"$0\1", 1), (2, 0): (None, None), (2, 1): (r"ea $1 $0\1", 1)}
    few = {(r.d, r.p): (r.text, r.n_replaced) for r in search.redact_text(df.where("d = 1"), "ÉA", case_sensitive=False, max_count=3, document=["d"], page="p").collect()}
    assert few == {(1, 0): ("  x", 2), (1, 1): ("éa", 1), (1, 2): ("éa", 0)}
    with pytest.raises(ValueError):
        search.redact_text(df, "x", max_count=1)


def test_dates_in_parts_and_with_offsets(spark):
    cases = {
        "D:20240203040506+0130": "2024-02-03T04:05:06+01:30", "20240203": "2024-02-03", "d:2024020304": "2024-02-03T04:00:00", "D:202402030405Z00'00'": "2024-02-03T04:05:00Z", "D:20240203040506-05": "2024-02-03T04:05:06-05:00",
        "D:20240203040506+01'30'": "2024-02-03T04:05:06+01:30", "  D:2024  ": "2024-01-01", "D:20": "", "": "", "x2024": "", "D:20240203040506 rest": "2024-02-03T04:05:06", "D:202402031": "2024-02-03",
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert [r[0] for r in df.select(scalars.tagged_date_to_iso(F.col("d"))).collect()] == list(cases.values())
    back = {"2024-02-03T04:05:06+01:30": "D:20240203040506+01'30'", "2024": "D:20240101", "2024-02-03 04:05": "D:20240203040500", "2024-02T04:05Z": "D:20240201040500Z", "2024-02-03T04:05:06-0530 x": "D:20240203040506-05'30'", "24": "", "": ""}
    df = spark.createDataFrame([(k,) for k in back], "d string")
    assert [r[0] for r in df.select(scalars.iso_text_to_tagged(F.col("d"))).collect()] == list(back.values())
    df = spark.createDataFrame([("D:20240203040506+0130",), ("D:2024",), ("no",)], "d string")
    assert [str(r[0]) for r in df.select(scalars.date_of(F.col("d")).cast("string")).collect()] == ["2024-02-03 02:35:06", "2024-01-01 00:00:00", "None"]


def test_names_of_code_points(spark):
    names = {"uni0041": "A", "uni00410042": "AB", "u1F600": "😀", "u0041": "A", "A_uni0042.alt": "AB", "uniD800": None, "u110000": None, "uni004": None, "u041": None, "A__A": None, "u00E9_A": "éA", "uni00e9": "é"}
    df, table = spark.createDataFrame(list(enumerate(names)), "id int, name string"), spark.createDataFrame([("A", "A")], "part string, value string")
    assert {r.id: r.value for r in lookups.resolve_names(df, table, "id", "name").collect()} == dict(enumerate(names.values()))


def test_ranges_of_rows_with_nulls(spark):
    codes = spark.createDataFrame([(None, 5.0), (1, 5.0), (2, None), (3, 50.0)], "id int, code double")
    ranges = spark.createDataFrame([(1, 0.0, 10.0, "x")], "layer int, lo double, hi double, name string")
    assert {(r.id, r.code, r.name) for r in lookups.range_lookup(codes, ranges, "code", 7.0).collect()} == {(None, 5.0, "x"), (1, 5.0, "x"), (2, None, None), (3, 50.0, None)}


def test_several_inserted_pages_and_pages_from_the_end(spark):
    df = spark.createDataFrame([(d, i, f"{d}{i}") for d, n in ((1, 3), (2, 1)) for i in range(n)], "doc int, page_index long, text string")
    new = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (3, 1, "d")], "doc int, n int, text string")
    for position, expected in ((1, ["10", "a", "b", "11", "12"]), (-5, ["a", "b", "10", "11", "12"]), (9, ["10", "11", "12", "a", "b"])):
        out = pages.insert_pages(df, new, position, ["doc"], "n").collect()
        for d in (1, 2, 3):
            found = sorted((r.page_index, r.text) for r in out if r.doc == d)
            assert [i for i, _ in found] == list(range(len(found)))
            if d == 1:
                assert [t for _, t in found] == expected
    for index in (-4, -3, -2, -1, 0, 2, 3):
        texts = {1: ["10", "11", "12"], 2: ["20"]}
        there = {d: t[index] for d, t in texts.items() if -len(t) <= index < len(t)}
        assert {r.doc: r.text for r in pages.page_at(df, index, ["doc"]).collect()} == there
        left = {d: [x for x in t if x != there.get(d)] for d, t in texts.items()}
        got = pages.delete_at(df, ["doc"], index).collect()
        assert {d: [r.text for r in sorted((r for r in got if r.doc == d), key=lambda r: r.page_index)] for d in (1, 2)} == left
    for s in (slice(-2, 9), slice(0, -1), slice(-9, -1, 2), slice(1, 3)):
        got = pages.slice_pages(df, s.start, s.stop, s.step or 1, ["doc"]).collect()
        assert sorted(r.text for r in got) == sorted(["10", "11", "12"][s] + ["20"][s])


def test_seventeen_nested_operators_have_a_value(spark):
    for depth, value in ((17, False), (18, None)):
        nodes = [(i, i - 1 if i else None, 0, "Not", None) for i in range(depth)] + [(depth, depth - 1, 0, None, True)]
        df = spark.createDataFrame(nodes, "id long, parent long, place long, op string, value boolean")
        assert [(r.id, r.value) for r in graph.expression_values(df).collect()] == [(0, value)]


def test_aliases_end_where_they_come_back(spark):
    aliases = {"a": "b", "b": "c", "x": "y", "y": "x", "z": "x", "s": "s"}
    df = spark.createDataFrame(list(aliases.items()), "name string, target string")
    names = spark.createDataFrame([(n,) for n in [*aliases, "c", "other"]], "name string")

    def plain(n):
        seen = set()
        while n in aliases and n not in seen:
            seen.add(n)
            n = aliases[n]
        return n

    assert {r.name: r.target for r in graph.resolve_aliases(names, df).collect()} == {n: plain(n) for n in [*aliases, "c", "other"]}
    assert graph.resolve_aliases(names, df.where("false")).where("name != target").count() == 0


def test_operands_and_appearances(spark):
    raws = [b"plain (x) \\", b"\n\r\t\b\f", b"\x00\x1f\x7f\xff", "﻿dé日".encode("utf-16-be"), b""]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "id int, raw binary")
    got = df.orderBy("id").select(scalars.literal_operand(F.col("raw")).alias("l"), scalars.decode_operand(F.col("raw")).alias("t"), scalars.hex_literal(F.col("raw")).alias("h")).collect()
    assert [r.l for r in got] == ["(plain \\(x\\) \\\\)", "(\\n\\r\\t\\b\\f)", "(\\000\\037\\177\\377)", "(\\376\\377\\000d\\000\\351e\\345)", "()"]
    assert [r.t for r in got] == ["plain (x) \\", "\n\r\t\b\f", "\x00\x1f\x7fÿ", "dé日", ""] and got[0].h == "<" + raws[0].hex().upper() + ">"
    texts = {None: (None, 0.0, "0 g"), "": (None, 0.0, "0 g"), "/Helv 12 Tf 0 0 1 rg": ("Helv", 12.0, "0 0 1 rg"), "Helv 12 Tf": (None, 12.0, "0 g"), "/A x Tf 1 G 0.5 g": ("A", 0.0, "0.5 g"), "1 2 rg": (None, 0.0, "0 g"), "9 0 1 1 rg\n/B -1.5e1 Tf": ("B", -15.0, "0 1 1 rg"), "a 1 g /C 1 Tf 7 scn 2 k": ("C", 1.0, "1 g")}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [tuple(r.a) for r in df.orderBy("id").select(scalars.default_appearance(F.col("t")).alias("a")).collect()] == list(texts.values())


def test_runs_join_where_the_pen_is(spark):
    shows = [(1, 0, 0.0, 5.0, 10.0, 10.0, False, "a"), (1, 1, 10.5, 5.2, 5.0, 10.0, None, "b"), (1, 2, 18.0, 5.0, None, 10.0, False, "c"), (1, 3, 19.0, 5.0, 1.0, 10.0, False, "d"), (1, 4, 40.0, 5.0, 1.0, 10.0, False, "e"), (1, 5, 41.0, 7.0, 1.0, 10.0, False, "f"), (1, 6, 42.0, 7.0, 1.0, 10.0, True, "g"), (1, 7, 43.0, 7.0, 1.0, 10.0, False, None)]
    df = spark.createDataFrame(shows, "page int, n int, x double, y double, width double, size double, vertical boolean, text string")
    assert [(r.text, r.n_pieces) for r in runs.logical_runs(df, ["page"], "n").orderBy("run").collect()] == [("ab c", 3), ("d", 1), ("e", 1), ("f", 1), ("g", 1), ("", 1)]


def test_marked_content_replaces_and_hides(spark):
    tokens = [("Tj", "a", None, None), ("BDC", None, "X", False), ("Tj", "b", None, None), ("BDC", None, "Y", None), ("EMC", None, None, None), ("EMC", None, None, None), ("BDC", None, None, True), ("Tj", "c", None, None), ("BMC", None, "no", None), ("EMC", None, None, None), ("EMC", None, None, None), ("EMC", None, None, None), ("Tj", "d", None, None)]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(tokens)], "page int, n int, op string, text string, actual string, hidden boolean")
    shown = [r.shown for r in runs.marked_text(df, ["page"], "n").orderBy("n").collect()]
    assert [x for x in shown if x] == ["a", "X", "d"]
    assert df.groupBy("page").agg(runs.has_marks(F.col("op")).alias("m")).first().m is True


def test_metadata_and_namespaces(spark):
    info = [(1, "Title", "t"), (1, "CreationDate", "D:2024"), (1, "ModDate", "soon"), (1, "Author", "a, b"), (1, "Other", "o"), (1, "Subject", ""), (2, "Producer", "p")]
    df = spark.createDataFrame(info, "doc int, name string, value string")
    props = lookups.info_to_properties(df, ["doc"])
    assert {(r.prefix, r.property, r["items"][0].lang, r["items"][0].value) for r in props.where("doc = 1").collect()} == {("dc", "title", "x-default", "t"), ("xmp", "CreateDate", None, "2024-01-01"), ("xmp", "ModifyDate", None, "soon"), ("dc", "creator", None, "a, b")}
    assert {tuple(r) for r in lookups.properties_to_info(props, ["doc"]).collect()} == {(1, "Title", "t"), (1, "CreationDate", "D:20240101"), (1, "ModDate", "soon"), (1, "Author", "a, b"), (2, "Producer", "p")}
    seq = [(1, 1, "a:", "u"), (1, 2, "b", "u"), (1, 3, "b", "v"), (1, 4, "", "w"), (1, 5, "c", None)]
    got = lookups.namespaces(spark.createDataFrame(seq, "doc int, seq int, prefix string, uri string"), ["doc"])
    assert {tuple(r) for r in got.collect()} == {(1, "a", "u", False), (1, "b", "v", True)}
