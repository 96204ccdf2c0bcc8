"""Edit logs, rules as rows, chains of matrices, the split sink, the streaming snapshot and budgets."""

import json
import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from quillspark.operators import edits, matrices, rulebook, variants
from quillspark.sources import sinks
from quillspark.streaming import budget, upsert


def test_edit_logs_equal_plain_lists(spark):
    rng = random.Random(1)
    base, log, expected, refused = [], [], [], []
    for d in range(12):
        items = [f"i{d}.{k}" for k in range(rng.randrange(6))]
        base += [(d, k, x) for k, x in enumerate(items)]
        for s in range(rng.randrange(30)):
            op, at, to = rng.choice(["insert", "insert", "delete", "move", "clear" if s == 20 else "insert", "turn"]), rng.choice([None, *range(-2, 9)]), rng.choice([None, *range(-1, 8)])
            item = f"n{d}.{s}"
            log.append((d, s, op, at, to, item))
            n, fine = len(items), True
            if op == "insert" and at is not None:
                items.insert(max(0, min(n, at)), item)
            elif op == "delete" and at is not None and 0 <= at < n:
                del items[at]
            elif op == "move" and at is not None and to is not None and 0 <= at < n and 0 <= to < n:
                items.insert(to, items.pop(at))
            elif op == "clear":
                items.clear()
            else:
                fine = False
            if not fine:
                refused.append((d, s))
        expected += [(d, k, x) for k, x in enumerate(items)]
    rng.shuffle(log)
    b, e = spark.createDataFrame(base, "doc int, position int, item string"), spark.createDataFrame(log, "doc int, seq int, op string, at int, `to` int, item string")
    assert sorted(map(tuple, edits.replay(b, e, ["doc"]).collect())) == sorted(expected)
    assert sorted(map(tuple, edits.refused_edits(b, e, ["doc"]).collect())) == sorted(refused)
    assert edits.replay(b, e.where("false"), ["doc"]).count() == len(base)


GOOD = {
    "trailer": [{"ID": ["a", "b"]}],
    "header": [{"version": "1.4"}, {"version": 1.3}, {}],
    "catalog": [{"StructTreeRoot": {}, "MarkInfo": {"Marked": True, "Suspects": False}, "Lang": "en", "ViewerPreferences": {"DisplayDocTitle": True}, "Title": "t"}],
    "form": [{"NeedAppearances": False}, {}],
    "metadata": [{"text": "<x pdfuaid:part='1'/>"}],
    "page": [{"Group": {"S": "Other"}}, {"Annots": [1], "Tabs": "S"}, {"Annots": []}],
    "annotation": [{"Subtype": "Text", "F": 4, "CA": 1, "AP": {"N": 1}, "Contents": "c", "StructParent": 3}, {"Subtype": "Popup", "StructParent": 0, "F": 0}],
    "action": [{"S": "GoTo"}, {}],
    "gstate": [{"TR": "Identity", "TR2": "Default", "SMask": "None", "BM": ["Normal", "Compatible"], "CA": 1.0, "ca": 1}, {"BM": "/Normal"}, {}],
    "xobject": [{"Subtype": "Image", "Interpolate": False, "SMask": None}, {"Subtype": "Form", "Group": {"S": "x"}}, {"Subtype": "Form", "Interpolate": True, "SMask": {}}],
    "file": [{"AFRelationship": "Data"}],
    "font": [{"FontDescriptor": {"FontFile2": 9}}, {"Subtype": "Type3"}],
}
BAD = {
    "trailer-id": ("1b", {"ID": []}), "version-1.4": ("1a", {"version": "1.5"}), "version-1.7": ("3b", {"version": "2.0"}), "catalog-actions": ("2b", {"AA": {}}), "catalog-layers": ("1b", {"OCProperties": {}}),
    "catalog-requirements": ("3u", {"Requirements": []}), "form-appearances": ("1b", {"NeedAppearances": True}), "form-xfa": ("2b", {"XFA": "x"}), "metadata-filter": ("2b", {"Filter": "f"}), "page-actions": ("1b", {"AA": {}}),
    "page-transparency": ("1b", {"Group": {"S": "Transparency"}}), "annotation-kind": ("2b", {"Subtype": "Movie"}), "annotation-file": ("2b", {"Subtype": "FileAttachment"}), "annotation-print": ("1b", {"Subtype": "Text"}),
    "annotation-hidden": ("3b", {"F": 6}), "annotation-opacity": ("1b", {"CA": 0.5}), "annotation-appearance": ("2b", {"Subtype": "Text", "AP": {}}), "action-kind": ("2b", {"S": "Launch"}), "state-transfer": ("2b", {"TR": "Default"}),
    "state-transfer-2": ("2b", {"TR2": {"a": 1}}), "state-mask": ("1b", {"SMask": {"S": 1}}), "state-blend": ("1b", {"BM": ["Normal", "Multiply"]}), "state-stroke-alpha": ("1b", {"CA": 0.9}), "state-fill-alpha": ("1b", {"ca": 0}),
    "object-script": ("2b", {"Subtype": "PS"}), "image-interpolation": ("2b", {"Subtype": "Image", "Interpolate": True}), "image-mask": ("1b", {"Subtype": "Image", "SMask": {}}), "form-reference": ("2b", {"Subtype": "Form", "Ref": 1}),
    "form-transparency": ("1b", {"Subtype": "Form", "Group": {"S": "Transparency"}}), "file-relationship": ("3b", {"F": "x"}), "level-a-tree": ("2a", {}), "level-a-marked": ("1a", {"MarkInfo": {"Marked": False}}), "level-a-language": ("3a", {}),
    "font-embedded": ("ua", {"Subtype": "TrueType", "FontDescriptor": {}}), "ua-title-shown": ("ua", {"ViewerPreferences": {}}), "ua-title": ("ua", {"Title": ""}), "ua-metadata": ("ua", {"text": "x"}),
    "ua-suspects": ("ua", {"MarkInfo": {"Suspects": True}}), "ua-tab-order": ("ua", {"Annots": [1]}), "ua-annotation-structure": ("ua", {"F": 4}), "ua-annotation-text": ("ua", {"Subtype": "Link", "Contents": ""}),
}
PROFILES = ("1a", "1b", "2a", "2b", "2u", "3a", "3b", "3u", "ua")


def facts(spark, rows):
    df = spark.createDataFrame([(i, p, s, json.dumps(v) if v is not None else None) for i, (p, s, v) in enumerate(rows)], "id int, profile string, scope string, t string")
    return df.withColumn("props", variants.parsed(F.col("t"))).drop("t")


def test_every_rule_has_a_good_and_a_bad_row(spark):
    assert set(BAD) == {r.rule for r in rulebook.RULES} and {r.scope for r in rulebook.RULES} == set(GOOD)
    good = [(p, s, v) for s, vs in GOOD.items() for v in vs for p in PROFILES]
    assert rulebook.rule_findings(facts(spark, [*good, (None, "trailer", {}), ("1b", "trailer", None), ("1b", "unknown", {}), ("9z", "trailer", {})]), ["id"]).collect() == []
    scope = {r.rule: r.scope for r in rulebook.RULES}
    names = sorted(BAD)
    found = rulebook.rule_findings(facts(spark, [(BAD[n][0], scope[n], BAD[n][1]) for n in names]), ["id"]).collect()
    assert {names[r.id] for r in found if names[r.id] == r.rule} == set(names)


def test_rules_hold_for_their_profiles_only(spark):
    rows = [(p, s, v) for p in PROFILES for s, v in (("header", {"version": "1.5"}), ("annotation", {"Subtype": "FileAttachment", "F": 4, "AP": {"N": 1}, "Contents": "c", "StructParent": 1}))]
    found = {(rows[r.id][0], r.rule) for r in rulebook.rule_findings(facts(spark, rows), ["id"]).collect()}
    assert found == {("1a", "version-1.4"), ("1b", "version-1.4"), *((p, "annotation-file") for p in PROFILES if p[0] in "12")}


def test_rules_can_be_kept_as_a_table(spark):
    df = rulebook.as_table(spark)
    assert rulebook.from_table(df.orderBy("rule")) == sorted(rulebook.RULES, key=lambda r: r.rule)
    own = spark.createDataFrame([("r", "page", "$.n", "at_most", "3", "error", "m")], "rule string, scope string, path string, test string, argument string, severity string, message string")
    rows = facts(spark, [("x", "page", {"n": 3}), ("x", "page", {"n": 4})])
    assert [r.id for r in rulebook.rule_findings(rows, ["id"], rulebook.from_table(own)).collect()] == [1]
    assert rulebook.rule_findings(rows, ["id"], []).count() == 0
    with pytest.raises(ValueError):
        rulebook.rule_findings(rows, ["id"], rulebook.from_table(own.withColumn("test", F.lit("odd"))))


def test_chains_of_matrices_are_exact(spark):
    rng = random.Random(2)
    rows = [(g, i, *(rng.choice(["0.1", "-3.25", "1e-7", "12345678901234567890", "0", "1"]) for _ in range(6))) for g in range(4) for i in range(9)] + [(9, 0, "1", "0", "0", "1", None, "2"), (9, 1, "1", "0", "0", "1", "1", "2")]
    df = spark.createDataFrame(rows, "g int, i int, a string, b string, c string, d string, e string, f string").repartition(3)
    got = {(r.g, r.i): r["product"] for r in matrices.chain_products(df, ["g"], ["i"], list("abcdef")).collect()}
    assert got[(9, 0)] is None and got[(9, 1)] is None
    with localcontext() as c:
        c.prec = 80
        for g in range(4):
            m = None
            for row in sorted(r for r in rows if r[0] == g):
                n = [Decimal(x) for x in row[2:]]
                m = n if m is None else [m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5]]
                assert [Decimal(x) for x in got[(g, row[1])]] == m and all("E" not in x for x in got[(g, row[1])])
    doubles = spark.createDataFrame([(1, 0, 0.1, 0.0, 0.0, 0.1, 0.2, 0.3), (1, 1, 3.0, 0.0, 0.0, 3.0, 1.0, 1.0)], "g int, i int, a double, b double, c double, d double, e double, f double")
    assert matrices.chain_products(doubles, ["g"], ["i"], list("abcdef")).where("i = 1").first()["product"] == ["0.3", "0", "0", "0.3", "0.3", "0.4"]


def test_a_split_can_run_again(spark, tmp_path):
    df = spark.createDataFrame([(d, p, f"{d}.{p}.{k}") for d in (1, 2, 3) for p in range(3) for k in range(1 + p)] + [(None, 0, "x"), (4, None, "y")], "doc long, page_index long, text string")
    path = str(tmp_path / "out")
    first = sorted(map(tuple, sinks.split_pages(df, path, "doc").collect()))
    assert [(d, p, n) for d, p, n, _ in first] == [(d, p, 1 + p) for d in (1, 2, 3) for p in range(3)]
    assert len(list((tmp_path / "out" / "pages").glob("doc=*/page_index=*/*.parquet"))) == 9
    assert sorted(map(tuple, sinks.split_pages(df, path, "doc").collect())) == first
    changed = sinks.split_pages(df.where("doc = 2 AND page_index = 1").withColumn("text", F.lit("new")), path, "doc").collect()
    assert len(changed) == 9 and sorted(tuple(r) for r in changed if r.doc != 2) == [x for x in first if x[0] != 2]
    assert spark.read.parquet(f"{path}/pages").where("doc = 2 AND page_index = 1").select("text").distinct().collect()[0].text == "new"


def revisions(spark, tmp_path, name, rows):
    spark.createDataFrame(rows, "id long, rev long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def test_a_snapshot_survives_a_restart_in_the_middle(spark, tmp_path, monkeypatch):
    schema = "id long, rev long, v string"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rng = random.Random(3)
    rows = [[(rng.randrange(20), rng.randrange(100), f"v{rng.randrange(1000)}") for _ in range(15)] for _ in range(4)]
    for some in rows:
        revisions(spark, tmp_path, "in", some)
    snapshot = upsert.Snapshot(spark, str(tmp_path / "out"), ["id"], ["rev"], buckets=4)
    with pytest.raises(ValueError):
        snapshot.read()
    commit, calls = upsert.Snapshot._commit, []

    def fails(self, manifest):
        calls.append(manifest["batch"])
        if len(calls) == 3:
            raise OSError("lost")
        commit(self, manifest)

    monkeypatch.setattr(upsert.Snapshot, "_commit", fails)
    with pytest.raises(Exception, match="lost"):
        snapshot.follow(stream(), str(tmp_path / "cp")).awaitTermination()
    assert snapshot.manifest()["batch"] == 1
    monkeypatch.setattr(upsert.Snapshot, "_commit", commit)
    snapshot.follow(stream(), str(tmp_path / "cp")).awaitTermination()
    newest = {}
    for r in sorted(r for some in rows for r in some):
        newest[r[0]] = max(newest.get(r[0], (-1, "")), r[1:])
    expected = sorted((k, *v) for k, v in newest.items())
    assert sorted((r.id, r.rev, r.v) for r in snapshot.read().collect()) == expected
    assert snapshot.merge(spark.createDataFrame([(1, 999, "again")], schema), snapshot.manifest()["batch"]) is False  # sent again
    assert snapshot.clean() > 0 and sorted((r.id, r.rev, r.v) for r in snapshot.read().collect()) == expected
    assert snapshot.merge(spark.createDataFrame([], schema), 100) and snapshot.merge(spark.createDataFrame([(1, 1000, "last")], schema), 101)
    assert {r.v for r in snapshot.read().where("id = 1").collect()} == {"last"}


def test_rows_after_the_cap_are_refused(spark, tmp_path):
    for some in ([("a", 1, 4), ("a", 2, 5), ("b", 1, 11), ("c", 1, 10)], [("a", 4, 1), ("a", 3, 2), ("b", 2, 1), ("c", 2, None)], [("a", 5, 1), ("c", 3, 0), ("c", 4, 1), ("c", 5, 0)]):
        spark.createDataFrame(some, "owner string, n long, cost long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set(*budget.STATE_STORE)
    stream = spark.readStream.schema("owner string, n long, cost long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = budget.within_budget(stream, ["owner"], "n", "cost", 10)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.owner, r.n, r.within, r.spent) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # a: 4 + 5 leaves 1; 2 is beyond, so 1 after it is refused too
    assert got == [("a", 1, True, 4), ("a", 2, True, 9), ("a", 3, False, 9), ("a", 4, False, 9), ("a", 5, False, 9), ("b", 1, False, 0), ("b", 2, False, 0), ("c", 1, True, 10), ("c", 2, True, 10), ("c", 3, True, 10), ("c", 4, False, 10), ("c", 5, False, 10)]
