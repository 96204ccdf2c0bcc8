"""Trees, code tables, layout, variants and intervals against plain versions on random small tables."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quillspark.operators import codes, intervals, layout, scan, tree, variants


def test_attributes_from_the_nearest_node_above(spark):
    rng = random.Random(1)
    nodes = [(i, i - 1 if i else None, "m" if i == 0 else None, f"c{i}" if i in (30, 64) else None, 450 if i == 7 else None, None) for i in range(101)]
    nodes += [(200 + i, rng.randrange(200, 200 + i) if i else None, *(rng.choice([None, None, f"v{i}"]) for _ in range(2)), rng.choice([None, -90, 180]), None) for i in range(120)]
    nodes += [(500, 502, None, "x", None, None), (501, 500, None, None, None, None), (502, 501, None, None, None, None), (503, 502, "own", None, None, None), (600, 999, None, None, 90, "r")]
    df = spark.createDataFrame(nodes, "id long, parent long, media_box string, crop_box string, rotation int, resources string")
    parent = {n[0]: n for n in nodes}

    def up(i, k):
        seen = set()
        while i in parent and i not in seen:
            seen.add(i)
            if parent[i][k] is not None:
                return parent[i][k], i
            i = parent[i][1]
        return None, None

    for r in tree.inherited(df, ["media_box", "crop_box", "rotation"]).collect():
        assert (r.media_box, r.from_media_box) == up(r.id, 2) and (r.crop_box, r.from_crop_box) == up(r.id, 3) and r.rotation == up(r.id, 4)[0], r
        assert r.endless == (500 <= r.id < 504)
    leaves = {r.id: r for r in tree.page_attributes(df).collect()}
    assert set(leaves) == {n[0] for n in nodes} - {n[1] for n in nodes}
    assert leaves[100].rotation == 90 and leaves[100].crop_box == "c64" and leaves[600].crop_box is None and leaves[503].crop_box == "x"


def test_fields_of_a_form(spark):
    nodes = [(1, None, "a", "Tx", None, 1), (2, 1, "b", None, "v", None), (3, 1, None, None, None, None), (4, 2, None, None, None, None), (5, 1, "c", "Btn", None, 4), (6, 1, "b", "Ch", "w", None), (7, None, "alone", None, None, None)]
    df = spark.createDataFrame(nodes, "id long, parent long, name string, kind string, value string, flags int")
    from quillspark.operators import graph

    names = graph.qualified_names(df.where("name IS NOT NULL"))
    assert {tuple(r) for r in tree.form_fields(df, names).collect()} == {("a.b", 6, "Ch", "w", 1), ("a.c", 5, "Btn", None, 4), ("alone", 7, None, None, 0)}


def test_layers_cut_holes_into_what_they_inherit(spark):
    rng = random.Random(2)
    tables = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("lost", "nowhere"), ("p", "q"), ("q", "p"), ("r", "q")]
    ranges = [(rng.choice("abcd") if i % 5 else "p", 1 + i % 2, lo := rng.randrange(200), lo + rng.randrange(-1, 60), rng.randrange(1000), i) for i in range(60)]
    ranges += [("a", 4, 0, 2**32 - 1, 7, 100), ("d", 4, 2**31, 2**31, 0, 101), ("lost", 1, 5, 5, 50, 102)]
    t, r = spark.createDataFrame(tables, "name string, base string"), spark.createDataFrame(ranges, "name string, length int, lo long, hi long, first long, place int")
    got = codes.overlaid(t, r).collect()
    base = dict(tables)

    def number(name, length, code):
        while name in base:
            own = [x for x in ranges if x[0] == name and x[1] == length and x[2] <= code <= x[3]]
            if own:
                best = max(own, key=lambda x: x[5])
                return best[4] + code - best[2]
            name = base[name]
        return None

    for name in ("a", "b", "c", "d", "lost"):
        for length in (1, 2):
            table = {c: x.first + c - x.lo for x in got if x["name"] == name and x.length == length for c in range(x.lo, x.hi + 1)}
            assert table == {c: n for c in range(300) if (n := number(name, length, c)) is not None}
    assert sorted((x["name"], x.lo, x.hi, x.first) for x in got if x.length == 4 and x["name"] in "ad") == [("a", 0, 2**32 - 1, 7), ("d", 0, 2**31 - 1, 7), ("d", 2**31, 2**31, 0), ("d", 2**31 + 1, 2**32 - 1, 2**31 + 8)]
    assert {x["name"] for x in codes.table_layers(t)[1].collect()} == {"p", "q", "r"}


def test_first_range_by_order(spark):
    ranges = spark.createDataFrame([("x", 0, 10**9, 5), ("x", 10, 20, 1), ("x", 15, 15, 0), ("x", 9, 8, -1)], "k string, lo long, hi long, rank int")
    points = spark.createDataFrame([("x", 0), ("x", 12), ("x", 15), ("x", 21), ("x", 10**9), ("x", 10**9 + 1), ("y", 5), ("x", None), ("x", 15)], "k string, p long")
    assert {(r.k, r.p, r.hit["rank"]) for r in codes.first_range(points, ranges, ["k"], "p", ["rank"]).collect()} == {("x", 0, 5), ("x", 12, 1), ("x", 15, 0), ("x", 21, 5), ("x", 10**9, 5)}
    assert codes.first_range(points, ranges.where("false"), ["k"], "p", ["rank"]).count() == 0


def test_codes_to_text(spark):
    asked = [("t", 1, 65, "r", "o"), ("t", 1, 66, "r", "o"), ("t", 1, 70, "r", "o"), ("t", 1, 99, "r", "o"), ("t", 1, 65, "r", "other")]
    got = codes.decode_codes(
        spark.createDataFrame(asked, "name string, length int, code long, registry string, ordering string"),
        spark.createDataFrame([("t", 1, 65, 70, 100)], "name string, length int, lo long, hi long, first long"),
        spark.createDataFrame([("t", "r", "o")], "name string, registry string, ordering string"),
        spark.createDataFrame([("o", 100, 100, 0x1F600), ("o", 105, 105, 0xD800)], "ordering string, lo long, hi long, first long"),
        spark.createDataFrame([("o", 101, "two"), ("o", 100, "no")], "ordering string, number long, text string"),
    )
    assert {(r.code, r.ordering, r.number, r.text) for r in got.collect()} == {(65, "o", 100, "😀"), (66, "o", 101, "two"), (70, "o", 105, None), (99, "o", None, None), (65, "other", None, None)}


# Plain versions of the layout rules, for pages of (id, x, y, font_size) -------------------------------------------


def plain_bands(page):
    sizes = [e[3] for e in page if e[3] > 0]
    font = statistics.median(sizes) if sizes else 10.0
    out = {}

    def cut(elements, band):
        xs = sorted(e[1] for e in elements)
        gaps = [(b - a, -b, (a + b) / 2) for a, b in zip(xs, xs[1:], strict=False)]
        if len(band) < 3 and len(elements) >= 4 and max(gaps)[0] >= max(18.0, 3 * font):
            at = max(gaps)[2]
            left, right = [e for e in elements if e[1] < at], [e for e in elements if e[1] >= at]
            spans = [(min(e[2] for e in s), max(e[2] for e in s)) for s in (left, right)]
            shared = min(s[1] for s in spans) - max(s[0] for s in spans)
            least = min(s[1] - s[0] for s in spans)
            if min(len(left), len(right)) >= 2 and shared > 0 and least >= 0.5 * font and shared >= 0.5 * least:
                cut(left, band + "0")
                cut(right, band + "1")
                return
        out.update({e[0]: band for e in elements})

    cut(page, "")
    return out


def plain_rows(elements):
    rows = []
    for e in sorted(elements, key=lambda e: (-e[2], e[1], e[0])):
        if rows and abs(e[2] - rows[-1][0][2]) <= max(1.0, 0.35 * (rows[-1][0][3] or e[3] or 10.0)):
            rows[-1].append(e)
        else:
            rows.append([e])
    return rows


def plain_segments(rows):
    xs, fonts = [sorted(e[1] for e in r) for r in rows], [statistics.median([e[3] for e in r if e[3] > 0] or [10.0]) for r in rows]
    out, i = [], 0
    while i < len(rows):
        j = i + 1
        near = max(4.0, 0.6 * fonts[i])
        while len(xs[i]) >= 2 and j < len(rows) and len(xs[j]) == len(xs[i]) and all(abs(a - b) <= near for a, b in zip(xs[i], xs[j], strict=True)):
            j += 1
        if j - i >= 2:
            out.append(("table", i, j - 1, len(xs[i])))
        elif out and out[-1][0] == "flow":
            out[-1] = ("flow", out[-1][1], i, None)
        else:
            out.append(("flow", i, i, None))
        i = j
    return out


def pages(seed, n=40):
    rng = random.Random(seed)
    out = {}
    for p in range(n):
        columns = rng.sample([50, 140, 230, 330, 420], rng.randrange(1, 5))
        out[p] = [(i, rng.choice(columns) + rng.choice([0, 0, 0, 3, 5, 8]), 700 - 14 * rng.randrange(8) - rng.choice([0, 0, 1, 4]), float(rng.choice([0, 8, 12, 12, 24]))) for i in range(rng.randrange(1, 40))]
    e = lambda x, y: (x, y, 12.0)
    cases = [[e(72, y) for y in (700, 686, 672)] + [e(320, y) for y in (700, 686, 672)], [e(72, y) for y in (700, 686, 672, 658)], [e(72, y) for y in (700, 686, 672)] + [e(320, y) for y in (300, 286, 272)], [e(72, 700), e(84, 686), e(72, 672), e(72, 658)], [e(72, 700), e(72, 686), e(320, 700), e(320, 686)]]
    for k, case in enumerate(cases):
        out[1000 + k] = [(i, float(x), float(y), f) for i, (x, y, f) in enumerate(case)]
    return out


def test_columns_rows_order_and_tables_equal_plain_versions(spark):
    all_ = pages(3)
    df = spark.createDataFrame([(p, e[0], float(e[1]), float(e[2]), e[3]) for p, es in all_.items() for e in es], "page long, id long, x double, y double, font_size double").repartition(7)
    got = layout.reading_order(df, ["page"]).collect()
    for p, es in all_.items():
        bands = plain_bands(es)
        assert {r.id: r.band for r in got if r.page == p} == bands
        order = [e[0] for b in sorted(set(bands.values())) for row in plain_rows([e for e in es if bands[e[0]] == b]) for e in sorted(row, key=lambda e: (e[1], -e[2], e[0]))]
        assert [r.id for r in sorted((r for r in got if r.page == p), key=lambda r: r.place)] == order
    assert {len({r.band for r in got if r.page == 1000 + k}) for k in (0, 4)} == {2} and {len({r.band for r in got if r.page == 1000 + k}) for k in (1, 2, 3)} == {1}
    assert max(len(r.band) for r in got) >= 2
    segments = layout.table_segments(layout.rows_of(layout.number_rows(df, ["page"]), ["page"]), ["page"]).collect()
    for p, es in all_.items():
        found = sorted((r.segment, r.kind, r["first"], r["last"], r.n_cells) for r in segments if r.page == p)
        assert found == [(k, *s) for k, s in enumerate(plain_segments(plain_rows(es)))]
    assert {r.kind for r in segments} == {"table", "flow"}


def test_scans_of_many_batches_and_groups(spark):
    from pyspark.sql.types import LongType

    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), "id")
    out = scan.ordered_scan(df, ["g"], ["id"], ["id"], lambda r: (r[0], r[0]), lambda s, r: (s + r[0], s + r[0]), "sum", LongType())
    got = {r.g: r.sum for r in out.groupBy("g").agg(F.max("sum").alias("sum")).collect()}
    assert got == {g: sum(range(g, 30_000, 3)) for g in range(3)}


def test_actions_of_many_shapes(spark):
    rows = [
        ('{"S": "GoTo", "D": [3, "XYZ", 1, null, 2.5]}', [0, 0, 10, 10], False),
        ('[0, "/FitR", 1, 2, 3, 4]', [10, 10, 0, 0], False),
        ('[5, "Fit"]', [0, 0, 1, 1], True),
        ('[-1, "Fit"]', [0, 0, 1, 1], True),
        ('[1, "FitH", 1, 2]', [0, 0, 1, 1], True),
        ('[1, "Zoom"]', [0, 0, 1, 1], True),
        ('{"S": "URI", "URI": "u"}', [0, 0, 1], True),
        ('{"S": "URI"}', [0, 0, 1, 1], True),
        ('{"S": "Launch", "F": "f"}', [0, 0, 0, 1], True),
        ('{"S": "JavaScript", "JS": "j"}', [0, 0, 1, None], True),
        ('{"S": 5}', [0, 0, 1, 1], True),
        ("no json", [0, 0, 1, 1], True),
        (None, None, True),
        ('{"S": "GoToR", "F": "f", "D": [900, "FitV", 7]}', [0, 0, 1, 1], False),
    ]
    df = spark.createDataFrame([(i, 1, t, r and [None if x is None else float(x) for x in r]) for i, (t, r, _) in enumerate(rows)], "id int, doc int, t string, rect array<double>").withColumn("action", variants.parsed(F.col("t")))
    got = {r.id: r for r in variants.links(df, spark.createDataFrame([(1, 5)], "doc int, n_pages int"), ["doc"]).drop("action").collect()}
    assert [got[i].broken for i in range(len(rows))] == [b for _, _, b in rows]
    assert (got[0].page, got[0].fit, got[0].left, got[0].top, got[0].zoom) == (3, "XYZ", 1.0, None, 2.5) and (got[1].bottom, got[1].top, got[1].x0, got[1].x1) == (2.0, 4.0, 0.0, 10.0)
    assert got[4].page is None and got[13].left == 7.0 and got[13].file == "f"
    shape = variants.shapes(df.where("id < 2"), "action", F.lit("k")).first()
    assert shape.n == 2 and shape["shape"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('{"a":1,"z":2}', '{"a":1}', False), ('{"a":1,"z":[1,{"b":null}]}', ' { "z" : [1, {"b":null}], "a" : 1.0 }', True), ("x", "y", None), ("1", "1.0", True), ("10", "1e1", True), ("1.5", "1.50", True), ('"1.0"', '"1"', False),
        ("[1,2]", "[2,1]", False), ("null", "null", True), ('"a\\u00e9"', '"aé"', True), (None, "1", None), ('{"k":"x 2.0"}', '{"k":"x 2"}', False), ("true", "1", False), ("100.0", "100", True), ("0.10", "0.1", True),
    ],
)
def test_json_texts_that_say_the_same(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(variants.same_json(F.col("a"), F.col("b")).alias("s")).first().s is same
    if same is not None:
        assert (json.dumps(json.loads(a), sort_keys=True) == json.dumps(json.loads(b), sort_keys=True)) <= same


def test_gaps_overlaps_and_tails_of_ranges(spark):
    rng = random.Random(4)
    ranges, sizes = [], []
    for f in range(60):
        sizes.append((f, rng.choice([0, 30, 40, None]) if f % 7 == 0 else 40))
        ranges += [(f, rng.randrange(-2, 45), rng.randrange(-1, 20)) for _ in range(rng.randrange(6))] + [(f, 5, 5)] * (f % 3)
    ranges += [(0, None, 5), (1000, 0, 5)]
    df, z = spark.createDataFrame(ranges, "file int, start int, length int"), spark.createDataFrame(sizes, "file int, size int")
    got = {tuple(r) for r in intervals.integrity_findings(df, z, ["file"]).collect()}
    expected = set()
    for f, size in sizes:
        if size is None:
            continue
        own = [(s, n) for g, s, n in ranges if g == f]
        expected |= {(f, "invalid", s, s + n if s is not None else None) for s, n in own if s is None or s < 0 or n <= 0}
        times = [sum(s <= b < s + n for s, n in own if s is not None and s >= 0 and n > 0) for b in range(70)]
        held = [b for b in range(70) if times[b]]
        lo, hi = (held[0], held[-1] + 1) if held else (None, None)
        names = [[] for _ in range(70)]
        for b in range(70):
            if lo is None:
                names[b] += ["uncovered"] * (b < size)
                continue
            names[b] += ["head"] * (b < lo and b < size) + ["tail"] * (hi <= b < size) + ["beyond"] * (size <= b and lo <= b < hi) + ["gap"] * (lo <= b < hi and not times[b]) + ["overlap"] * (times[b] > 1)
        for name in ("uncovered", "head", "tail", "beyond", "gap", "overlap"):
            b = 0
            while b < 70:
                if name in names[b]:
                    e = b
                    while e < 70 and name in names[e]:
                        e += 1
                    expected.add((f, name, b, e))
                    b = e
                b += 1
    assert got == expected


def test_tails_that_mean_something(spark):
    rows = [("abc\n% x\n  \n", 3, False), ("abc\n% x\r q", 3, True), ("abc", 3, False), ("abc", 9, False), ("abcd", 3, True), (None, 0, None), ("abc\n%q\r\nz", 3, True), ("ab%c", 2, False)]
    df = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(rows)], "id int, t string, e int")
    assert [r.m or False for r in df.select("id", intervals.meaningful_tail(F.col("t"), F.col("e")).alias("m")).orderBy("id").collect()] == [bool(m) for _, _, m in rows]
