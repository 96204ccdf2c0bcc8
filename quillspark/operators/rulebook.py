"""Rules as rows: a table of rules becomes one expression, which finds every breach in one pass over the facts.

Facts are rows (keys, profile, scope, props): what of a file is described (header, trailer, catalog, page, annotation, font and so on), and a variant
with its entries. A rule names a scope, a path, a test with an argument, and for which profiles and under which condition it holds.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of more rules is refused: rules become one expression.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """A fact of `scope` must pass the test at path, for profiles that the pattern `profiles` matches, if the condition (when_path, when_test, when_argument) holds.

    Tests: present, absent, true, not_true, nonempty, not_object; at_most, at_least (a number; a text's leading number); in, not_in (a JSON list; of an array each
    item), contains (a text); bits_on, bits_off (a number of bits; missing is 0); any_present (a JSON list of paths, path is left out). All but present,
    true, nonempty, contains, bits_on and any_present pass where the path is missing.
    """

    rule: str
    scope: str
    path: str
    test: str
    argument: str | None
    severity: str
    message: str
    profiles: str = ".*"
    when_path: str | None = None
    when_test: str | None = None
    when_argument: str | None = None


# Kinds of annotations and actions that archives may not have, kinds of annotations that should have a text, flags.
BANNED_ANNOTATIONS = ["Sound", "Movie", "Screen", "RichMedia", "3D"]
BANNED_ACTIONS = ["Launch", "Sound", "Movie", "ResetForm", "ImportData", "JavaScript", "SetOCGState", "Rendition", "GoTo3DView", "Trans"]
MARKUP = ["Link", "Text", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Ink", "FileAttachment", "Redact"]
INVISIBLE, HIDDEN, PRINT, NO_VIEW = 1, 2, 4, 32
UNSEEN, NEVER_SEEN = HIDDEN + NO_VIEW, HIDDEN + NO_VIEW + INVISIBLE

NOT_POPUP = ("$.Subtype", "not_in", '["Popup"]')
#: Profiles: 1a, 1b, 2a, 2b, 2u, 3a, 3b, 3u (archives, by part and level) and ua (accessible files).
ARCHIVES, PART_1, LATER, LEVEL_A, ACCESSIBLE = "^[123]", "^1", "^[23]", "^[123]a$", "^ua$"

RULES = [
    Rule("trailer-id", "trailer", "$.ID[0]", "present", None, "error", "the trailer has no file identifier", ARCHIVES),
    Rule("version-1.4", "header", "$.version", "at_most", "1.4", "error", "the version is above 1.4", PART_1),
    Rule("version-1.7", "header", "$.version", "at_most", "1.7", "error", "the version is above 1.7", LATER),
    Rule("catalog-actions", "catalog", "$.AA", "absent", None, "error", "the document has additional actions", ARCHIVES),
    Rule("catalog-layers", "catalog", "$.OCProperties", "absent", None, "error", "the document has layers", PART_1),
    Rule("catalog-requirements", "catalog", "$.Requirements", "absent", None, "error", "the document states requirements", ARCHIVES),
    Rule("form-appearances", "form", "$.NeedAppearances", "not_true", None, "error", "the form needs appearances", ARCHIVES),
    Rule("form-xfa", "form", "$.XFA", "absent", None, "error", "the form is dynamic", ARCHIVES),
    Rule("metadata-filter", "metadata", "$.Filter", "absent", None, "error", "the metadata are filtered", ARCHIVES),
    Rule("page-actions", "page", "$.AA", "absent", None, "error", "the page has additional actions", ARCHIVES),
    Rule("page-transparency", "page", "$.Group.S", "not_in", '["Transparency"]', "error", "the page is a transparency group", PART_1),
    Rule("annotation-kind", "annotation", "$.Subtype", "not_in", json.dumps(BANNED_ANNOTATIONS), "error", "the annotation is of a kind that isn't allowed", ARCHIVES),
    Rule("annotation-file", "annotation", "$.Subtype", "not_in", '["FileAttachment"]', "error", "the annotation attaches a file", "^[12]"),
    Rule("annotation-print", "annotation", "$.F", "bits_on", str(PRINT), "error", "the annotation isn't printed", ARCHIVES, *NOT_POPUP),
    Rule("annotation-hidden", "annotation", "$.F", "bits_off", str(NEVER_SEEN), "error", "the annotation is hidden", ARCHIVES, *NOT_POPUP),
    Rule("annotation-opacity", "annotation", "$.CA", "at_least", "1", "error", "the annotation is transparent", PART_1, *NOT_POPUP),
    Rule("annotation-appearance", "annotation", "$.AP.N", "present", None, "warning", "the annotation has no appearance", ARCHIVES, "$.Subtype", "not_in", '["Popup", "Link"]'),
    Rule("action-kind", "action", "$.S", "not_in", json.dumps(BANNED_ACTIONS), "error", "the action is of a kind that isn't allowed", ARCHIVES),
    Rule("state-transfer", "gstate", "$.TR", "in", '["Identity"]', "error", "the graphics state has a transfer function", ARCHIVES),
    Rule("state-transfer-2", "gstate", "$.TR2", "in", '["Identity", "Default"]', "error", "the graphics state has a transfer function", ARCHIVES),
    Rule("state-mask", "gstate", "$.SMask", "not_object", None, "error", "the graphics state has a soft mask", PART_1),
    Rule("state-blend", "gstate", "$.BM", "in", '["Normal", "Compatible"]', "error", "the graphics state blends", PART_1),
    Rule("state-stroke-alpha", "gstate", "$.CA", "at_least", "1", "error", "lines are transparent", PART_1),
    Rule("state-fill-alpha", "gstate", "$.ca", "at_least", "1", "error", "areas are transparent", PART_1),
    Rule("object-script", "xobject", "$.Subtype", "not_in", '["PS"]', "error", "the object is a program", ARCHIVES),
    Rule("image-interpolation", "xobject", "$.Interpolate", "not_true", None, "error", "the image is interpolated", ARCHIVES, "$.Subtype", "in_present", '["Image"]'),
    Rule("image-mask", "xobject", "$.SMask", "not_object", None, "error", "the image has a soft mask", PART_1, "$.Subtype", "in_present", '["Image"]'),
    Rule("form-reference", "xobject", "$.Ref", "absent", None, "error", "the object refers to another file", ARCHIVES, "$.Subtype", "in_present", '["Form"]'),
    Rule("form-transparency", "xobject", "$.Group.S", "not_in", '["Transparency"]', "error", "the object is a transparency group", PART_1, "$.Subtype", "in_present", '["Form"]'),
    Rule("file-relationship", "file", "$.AFRelationship", "present", None, "error", "the embedded file has no relationship", "^3"),
    Rule("level-a-tree", "catalog", "$.StructTreeRoot", "present", None, "error", "the document has no structure", LEVEL_A),
    Rule("level-a-marked", "catalog", "$.MarkInfo.Marked", "true", None, "error", "the document isn't marked", LEVEL_A),
    Rule("level-a-language", "catalog", "$.Lang", "present", None, "warning", "the document has no language", LEVEL_A),
    Rule("font-embedded", "font", "$", "any_present", '["$.FontDescriptor.FontFile", "$.FontDescriptor.FontFile2", "$.FontDescriptor.FontFile3"]', "error", "the font isn't embedded", ACCESSIBLE, "$.Subtype", "not_in", '["Type3"]'),
    Rule("ua-title-shown", "catalog", "$.ViewerPreferences.DisplayDocTitle", "true", None, "error", "the title isn't shown", ACCESSIBLE),
    Rule("ua-title", "catalog", "$.Title", "nonempty", None, "error", "the document has no title", ACCESSIBLE),
    Rule("ua-metadata", "metadata", "$.text", "contains", "pdfuaid:part", "error", "the metadata don't declare the part", ACCESSIBLE),
    Rule("ua-suspects", "catalog", "$.MarkInfo.Suspects", "not_true", None, "error", "the marking is suspect", ACCESSIBLE),
    Rule("ua-tab-order", "page", "$.Tabs", "in_present", '["S"]', "error", "the page's annotations aren't in the order of the structure", ACCESSIBLE, "$.Annots[0]", "present", None),
    Rule("ua-annotation-structure", "annotation", "$.StructParent", "present", None, "warning", "the annotation isn't in the structure", ACCESSIBLE, "$.F", "bits_off", str(UNSEEN)),
    Rule("ua-annotation-text", "annotation", "$.Contents", "nonempty", None, "warning", "the annotation has no text", ACCESSIBLE, "$.Subtype", "in_present", json.dumps(MARKUP)),
]


def _passes(props: Column, path: str, test: str, argument: str | None) -> Column:
    """Whether the test holds at path; never null."""
    there = F.try_variant_get(props, path, "variant")
    missing = there.isNull() | F.is_variant_null(there)
    text = F.try_variant_get(props, path, "string")
    if test == "any_present":
        every = [F.try_variant_get(props, p, "variant") for p in json.loads(argument or "[]")]
        return F.coalesce(*[F.when(v.isNotNull() & ~F.is_variant_null(v), True) for v in every], F.lit(False))
    if test in ("in", "not_in", "in_present"):
        allowed = json.loads(argument or "[]")
        several = F.coalesce(F.try_variant_get(props, path, "array<string>"), F.array(text))
        plain = F.transform(several, lambda x: F.ltrim(x, F.lit("/")))
        if test == "not_in":
            return missing | ~F.coalesce(F.exists(plain, lambda x: x.isin(*allowed)), F.lit(False))
        inside = F.coalesce(F.forall(plain, lambda x: x.isNotNull() & x.isin(*allowed)), F.lit(False))
        return inside if test == "in_present" else missing | inside
    if test in ("bits_on", "bits_off"):
        mask = int(argument or 0)
        found = F.coalesce(F.try_variant_get(props, path, "long"), F.lit(0)).bitwiseAND(F.lit(mask))
        return found == (mask if test == "bits_on" else 0)
    number = F.regexp_extract(F.trim(text), r"^[+-]?\d+(\.\d+)?", 0).try_cast("double")
    yes = F.coalesce((F.schema_of_variant(there) == "BOOLEAN") & F.try_variant_get(props, path, "boolean"), F.lit(False))  # numbers and texts aren't true
    bound = float(argument or 0) if test.startswith("at_") else 0.0
    tests = {
        "present": ~missing,
        "absent": missing,
        "true": yes,
        "not_true": ~yes,
        "nonempty": F.coalesce(text != "", F.lit(False)),
        "not_object": missing | ~F.coalesce(F.schema_of_variant(there).startswith("OBJECT"), F.lit(False)),
        "at_most": F.coalesce(number <= bound + 1e-9, F.lit(True)),
        "at_least": F.coalesce(number >= bound - 1e-9, F.lit(True)),
        "contains": F.coalesce(text.contains(argument or ""), F.lit(False)),
    }
    if test not in tests:
        raise ValueError(f"unknown test {test!r}")
    return tests[test]


def rule_findings(facts: DataFrame, keys: list[str], rules: list[Rule] = RULES, profile: str = "profile", scope: str = "scope", props: str = "props") -> DataFrame:
    """(keys, scope, rule, severity, message): one row for each rule that a fact breaks. Facts without profile, scope or props break none."""
    broken = []
    for r in rules:
        holds = (F.col(scope) == r.scope) & F.col(profile).rlike(r.profiles)
        if r.when_test:
            holds = holds & _passes(F.col(props), r.when_path or "$", r.when_test, r.when_argument)
        breach = F.coalesce(holds & ~_passes(F.col(props), r.path, r.test, r.argument), F.lit(False))
        broken.append(F.when(breach, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))))
    if not broken:
        return facts.select(*keys, scope, *[F.lit("").alias(c) for c in ("rule", "severity", "message")]).where("false")
    judged = facts.where(F.col(profile).isNotNull() & F.col(props).isNotNull())
    return judged.select(*keys, scope, F.explode(F.array_compact(F.array(*broken))).alias("f")).select(*keys, scope, "f.*")


def as_table(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    """Rules as rows, to be written, changed and read again."""
    return spark.createDataFrame([tuple(getattr(r, f.name) for f in fields(Rule)) for r in rules], ", ".join(f"{f.name} string" for f in fields(Rule)))


def from_table(df: DataFrame) -> list[Rule]:
    """The rules of a table; columns that it lacks, and nulls, have their defaults."""
    rows = df.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names = [f.name for f in fields(Rule)]
    optional = {"argument": None, "profiles": ".*"}
    return [Rule(**{**optional, **{k: v for k, v in r.asDict().items() if k in names and (v is not None or k not in ("profiles",))}}) for r in rows]
