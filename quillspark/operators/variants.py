"""Rows of many shapes in one VARIANT column, and typed views of them: actions, destinations, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands after the page and the kind in a destination, by kind.
DESTINATIONS = {
    "XYZ": ("left", "top", "zoom"),
    "Fit": (),
    "FitB": (),
    "FitH": ("top",),
    "FitBH": ("top",),
    "FitV": ("left",),
    "FitBV": ("left",),
    "FitR": ("left", "bottom", "right", "top"),
}


def parsed(c: Column) -> Column:
    """JSON text as a variant; null for what isn't JSON."""
    return F.try_parse_json(c)


def shredded(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a typed column for each name -> (path, type) of a variant column; null where the path is missing or of another type. All in one pass."""
    return df.withColumns({name: F.try_variant_get(column, path, kind) for name, (path, kind) in fields.items()})


def shapes(df: DataFrame, column: str, kind: Column) -> DataFrame:
    """(kind, n, shape): how many variants there are of each kind, and the schema that all of them fit."""
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.schema_of_variant_agg(column).alias("shape"))


def same_json(a: Column, b: Column) -> Column:
    """Whether two JSON texts say the same, whatever the order of keys, the white space and how numbers are written; null if one is no JSON.

    Of repeated keys no text is JSON here. Variants keep keys sorted and numbers by value, so equal ones print alike.
    """

    def canonical(c: Column) -> Column:
        # whole numbers print the same as integers, decimals and doubles
        return F.regexp_replace(F.to_json(F.try_parse_json(c)), r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0+(?![\d])(?:E0)?', "$1$2")

    return canonical(a) == canonical(b)


def destination(d: Column) -> dict[str, Column]:
    """page, fit, left, bottom, right, top and zoom of a destination, a variant array [page, kind, numbers...].

    A destination of an unknown kind, without a whole page number from 0 on, or with more numbers than its kind has is none: all columns are null. Numbers that are missing or null stay null.
    """
    kind = F.ltrim(F.try_variant_get(d, "$[1]", "string"), F.lit("/"))
    page = F.try_variant_get(d, "$[0]", "int")
    size = F.size(F.try_variant_get(d, "$", "array<variant>"))
    most = F.lit(None).cast("int")
    for name, params in DESTINATIONS.items():
        most = F.when(kind == name, F.lit(len(params) + 2)).otherwise(most)
    fine = (page >= 0) & (size <= most)
    out = {"page": F.when(fine, page), "fit": F.when(fine, kind)}
    for param in ("left", "bottom", "right", "top", "zoom"):
        value = F.lit(None).cast("double")
        for name, params in DESTINATIONS.items():
            if param in params:
                value = F.when(kind == name, F.try_variant_get(d, f"$[{params.index(param) + 2}]", "double")).otherwise(value)
        out[param] = F.when(fine, value)
    return out


def actions(df: DataFrame, column: str = "action") -> DataFrame:
    """df with the typed columns of an action, a variant object whose S names its kind.

    action_kind: GoTo (D, a destination), GoToR (F, a file; perhaps D), URI (URI), Named (N), Launch (F), JavaScript (JS), SubmitForm (F, where to; Flags, Fields); a bare
    array is a destination, so GoTo. Adds action_kind, uri, name, file, script, flags, fields and the columns of destination. Objects without S, and what is no object, have no kind.
    """
    a = F.col(column)
    bare = F.try_variant_get(a, "$[0]", "variant").isNotNull()
    kind = F.when(bare, "GoTo").otherwise(F.ltrim(F.try_variant_get(a, "$.S", "string"), F.lit("/")))
    view = F.when(bare, a).when(kind.isin("GoTo", "GoToR"), F.try_variant_get(a, "$.D", "variant"))

    def only(kinds: tuple[str, ...], path: str) -> Column:
        return F.when(kind.isin(*kinds), F.try_variant_get(a, path, "string"))

    uri = F.coalesce(only(("URI",), "$.URI"), only(("SubmitForm",), "$.F"))
    form = {"flags": F.when(kind == "SubmitForm", F.try_variant_get(a, "$.Flags", "int")), "fields": F.when(kind == "SubmitForm", F.try_variant_get(a, "$.Fields", "array<string>"))}
    typed = {"action_kind": kind, "uri": uri, **form, "name": only(("Named",), "$.N"), "file": only(("GoToR", "Launch"), "$.F"), "script": only(("JavaScript",), "$.JS")}
    return df.withColumns({**typed, **destination(view)})


def links(df: DataFrame, page_count: DataFrame, owner: list[str], column: str = "action") -> DataFrame:
    """Link annotations (owner, rect: array of 4, action) as rows with the columns of actions, x0, y0, x1, y1 in order, and broken.

    broken: the rectangle hasn't four numbers or no area, the action has no known target, or it goes to a page that its owner (owner, n_pages) hasn't; pages of other files aren't known.
    """
    typed = actions(df, column).join(page_count, owner, "left")
    r = [F.get("rect", F.lit(i)) for i in range(4)]
    corners = {"x0": F.least(r[0], r[2]), "y0": F.least(r[1], r[3]), "x1": F.greatest(r[0], r[2]), "y1": F.greatest(r[1], r[3])}
    whole = (F.size("rect") == 4) & F.forall("rect", lambda x: x.isNotNull()) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    kind = F.col("action_kind")
    target = F.when(kind == "GoTo", F.col("page") < F.col("n_pages")).when(kind == "GoToR", F.col("file").isNotNull()).when(kind.isin("URI", "SubmitForm"), F.col("uri").isNotNull() & (F.col("uri") != ""))
    target = target.when(kind == "Named", F.col("name").isNotNull()).when(kind == "Launch", F.col("file").isNotNull()).when(kind == "JavaScript", F.col("script").isNotNull())
    return typed.withColumns(corners).withColumn("broken", ~(F.coalesce(whole, F.lit(False)) & F.coalesce(target, F.lit(False)))).drop("n_pages")
