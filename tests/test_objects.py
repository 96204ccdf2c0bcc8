"""Named parts of files, samples of pictures, and reachability over long paths."""

import random

from pyspark.sql import functions as F

from quillspark.operators import graph, objects, search


def test_attachments_put_and_removed(spark):
    rng = random.Random(1)
    base = [(d, n, f"{d}{n}") for d in (1, 2) for n in "ab"]
    log = [(rng.randrange(1, 4), s, rng.choice(["put", "remove", "other"]), rng.choice("abc"), f"v{s}") for s in range(60)]
    state, removed = {(d, n): v for d, n, v in base}, []
    for d, s, op, n, v in log:
        if op == "put":
            state[(d, n)] = v
        elif op == "remove":
            removed.append((d, n, s, state.pop((d, n), None) is not None))
    b, e = spark.createDataFrame(base, "doc int, name string, v string"), spark.createDataFrame(log, "doc int, seq int, op string, name string, v string").repartition(3)
    assert {(r.doc, r["name"]): r.v for r in objects.keyed_replay(b, e, ["doc", "name"]).collect()} == state
    assert sorted(tuple(r) for r in objects.removals(b, e, ["doc", "name"]).collect()) == sorted(removed)


def test_layers_hide_what_is_on_them(spark):
    layers = spark.createDataFrame([(1, True), (2, False), (3, None), (4, False)], "layer int, visible boolean")
    toggles = spark.createDataFrame([(1, 1, True), (1, 2, False), (4, 1, True), (9, 1, False)], "layer int, seq int, visible boolean")
    states = objects.layer_states(layers, toggles, ["layer"])
    assert {(r.layer, r.visible) for r in states.collect()} == {(1, False), (2, False), (3, True), (4, True)}
    content = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4, 5)] + [(6, None)], "id int, layer int")
    assert {r.id for r in objects.visible_content(content, states, ["layer"]).collect()} == {3, 4, 5, 6}


def test_values_that_fields_take(spark):
    fields = [("t", "Tx", "old", None, 0), ("ro", "Tx", "old", None, 1), ("c", "Ch", "x", ["x", "y"], 0), ("e", "Ch", "x", ["x"], 1 << 18), ("b", "Btn", "Off", ["On"], None), ("s", "Sig", None, None, 0), ("n", "Tx", "old", None, 0)]
    changes = [("t", 1, "new"), ("t", 2, None), ("ro", 1, "new"), ("c", 1, "y"), ("c", 2, "z"), ("e", 1, "free"), ("b", 1, "On"), ("b", 2, "Maybe"), ("b", 3, None), ("s", 1, "x"), ("gone", 1, "x")]
    df, log = spark.createDataFrame(fields, "name string, kind string, value string, options array<string>, flags int"), spark.createDataFrame(changes, "name string, seq int, value string")
    got = {r["name"]: (r.value, r.refused) for r in objects.set_field_values(df, log, ["name"]).collect()}
    assert got == {"t": (None, 0), "ro": ("old", 1), "c": ("y", 1), "e": ("free", 0), "b": ("Off", 1), "s": (None, 1), "n": ("old", 0)}


def test_unsigned_parts_and_distinct_fonts(spark):
    parts = spark.createDataFrame([(1, 1, True, None), (1, 2, False, True), (1, 3, None, True), (1, 4, None, False), (1, 5, None, None)], "doc int, id int, is_signed boolean, signed boolean")
    got = objects.unsigned_content(parts, parts.where("id > 4"), parts.where("id = 1").select("doc", "id"), ["doc"]).collect()
    assert sorted((r.part, r.id) for r in got) == [("annotation", "5"), ("field", "2"), ("field", "4"), ("field", "5"), ("page", "1")]
    fonts = spark.createDataFrame([(1, "A", "t", 0, 1), (2, "a", "t", None, 5), (3, "a", "t", 1, 1), (4, "a", "o", 0, 1), (5, "A", "t", 0, 5)], "id int, name string, type string, face int, priority int")
    assert {r.id for r in objects.distinct_fonts(fonts, "priority", "id").collect()} == {2, 3, 4}


def test_samples_of_padded_rows(spark):
    def plain(data, bits, width, height, parts):
        of_row = width * parts
        row_bytes = (of_row * bits + 7) // 8
        data = data + bytes(row_bytes * height + 2)
        out = []
        for y in range(height):
            row = data[y * row_bytes : (y + 1) * row_bytes]
            number = int.from_bytes(row, "big")
            out += [(number >> (row_bytes * 8 - bits * (i + 1))) & ((1 << bits) - 1) for i in range(of_row)]
        return out

    rng = random.Random(2)
    rows = [(rng.randbytes(rng.randrange(0, 30)), bits, rng.randrange(1, 6), rng.randrange(0, 4), rng.randrange(1, 4)) for bits in (1, 2, 4, 8, 16) for _ in range(6)] + [(b"abc", 3, 1, 1, 1)]
    df = spark.createDataFrame([(i, bytearray(d), *r) for i, (d, *r) in enumerate(rows)], "id int, data binary, bits int, width int, height int, parts int")
    got = {r.id: r.s for r in df.select("id", objects.samples(F.col("data"), F.col("bits"), F.col("width"), F.col("height"), F.col("parts")).alias("s")).collect()}
    assert got == {i: plain(*r) if r[1] != 3 else None for i, r in enumerate(rows)}
    colours = spark.createDataFrame([(bytearray(b"abcdef"), [0, 1, 2])], "p binary, s array<int>").select(objects.palette_colours(F.col("s"), F.col("p")).alias("c")).first().c
    assert [tuple(c) for c in colours] == [(97, 98, 99), (100, 101, 102), (0, 0, 0)]


def test_entries_gaps_boxes_and_numbers(spark):
    df = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, {"b": None}), (3, {"a": None})], "id int, m map<string,string>")
    value, rest = objects.popped(F.col("m"), "a", F.lit("none"))
    assert [(r.v, r.r) for r in df.orderBy("id").select(value.alias("v"), rest.alias("r")).collect()] == [("x", {"b": "y"}), ("none", {"b": None}), (None, {})]
    points = spark.createDataFrame([(1, 1.0, 2.0), (1, 5.0, -1.0), (1, 9.0, None), (1, float("nan"), 0.0), (2, 3.0, 3.0)], "g int, x double, y double")
    assert {tuple(r) for r in objects.bounding_boxes(points, ["g"], "x", "y").collect()} == {(1, 1.0, -1.0, 5.0, 2.0), (2, 3.0, 3.0, 3.0, 3.0)}
    assert {tuple(r) for r in objects.widest_gaps(points.where("NOT isnan(x)"), ["g"], "x", 4.0).collect()} == {(1, 4.0, 5.0)}
    assert sorted(r.object_id for r in objects.register_objects(points, ["g"], ["x"], 7).collect()) == [7, 7, 8, 9, 10]


def test_long_paths_are_few_rounds(spark):
    path = [(i, i + 1) for i in range(3000)]
    branch = [(2500, 9000), (9000, 9001), (9001, 9000), (20000, 20001), (20001, 20000), (20000, 5)]
    edges = spark.createDataFrame([*path, *branch], "src long, dst long")
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    for first in (0, 4):
        assert {r.id for r in graph.unreachable(ids, edges, ids.where("id = 1000"), first).collect()} == {*range(1000), 20000, 20001}
    few = edges.where("src < 12 OR src >= 9000")
    assert {r.id for r in graph.unreachable(ids.where("id < 14"), few, ids.where("id = 10")).collect()} == {*range(10), 13}


def test_offsets_of_many_lines(spark):
    for n in (1, 15, 16, 17, 1023, 1024, 1025, 5000):
        text = "\n".join("x" * (i % 7 + 1) for i in range(n))
        found = search.line_fragments(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("line_no").collect()
        at = 0
        for r, line in zip(found, text.split("\n"), strict=True):
            assert (r.start, r.txt) == (at, line)
            at += len(line) + 1
