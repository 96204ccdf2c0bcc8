"""Phrase, regex and line search with exact offsets; replace and redact.

Offsets count code points from 0, ends are exclusive. Every operator keeps the columns named by keys and
runs in built-in expressions. Offsets are summed up within the row of a text, so search needs no exchange and rows
with equal keys don't mix; only quotas look at all pages of a document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"[ \t\r\x0B\f]"


#: Pieces whose offsets are summed up together, and such groups: a running sum copies what it has, so it goes over few at once.
TOGETHER, GROUPS = 16, 64


def _running(values: Column, start: Column) -> Column:
    """For each number of an array the sum of start and those before it."""
    begin = F.struct(F.array().cast("array<int>").alias("before"), start.cast("int").alias("sum"))
    return F.aggregate(values, begin, lambda acc, x: F.struct(F.concat(acc["before"], F.array(acc["sum"])).alias("before"), (acc["sum"] + x).alias("sum")))["before"]


def _parts(values: str, many: int) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(values) - 1) / many).cast("int"))


def _part(values: str, b: Column, many: int) -> Column:
    return F.slice(values, b * many + 1, F.lit(many))


def _with_sums_before(rows: DataFrame, sizes: str, name: str) -> DataFrame:
    """rows with name: for each number of an array column, which isn't empty, the sum of those before it; sums of groups, and of groups of groups, come first."""

    def total(values: str, many: int) -> Column:
        return F.transform(_parts(values, many), lambda b: F.aggregate(_part(values, b, many), F.lit(0), lambda acc, x: acc + x))

    def spread(values: str, starts: str, many: int) -> Column:
        return F.flatten(F.zip_with(_parts(values, many), F.col(starts), lambda b, start: _running(_part(values, b, many), start)))

    rows = rows.withColumn("_few", total(sizes, TOGETHER))
    rows = rows.withColumn("_fewer", _running(total("_few", GROUPS), F.lit(0)))
    return rows.withColumn("_few", spread("_few", "_fewer", GROUPS)).withColumn(name, spread(sizes, "_few", TOGETHER)).drop("_few", "_fewer")


def _with_offsets(rows: DataFrame, keys: list[str], pieces: str, sizes: Column) -> DataFrame:
    """One row for each piece of an array column: its number n, the piece, and the sum of the sizes before it."""
    rows = _with_sums_before(rows.where(F.size(pieces) > 0).withColumn("_sizes", sizes), "_sizes", "_before")
    every = F.arrays_zip(F.col(pieces).alias("piece"), F.col("_before").alias("before"))
    return rows.select(*keys, F.posexplode(every).alias("n", "p")).select(*keys, "n", "p.piece", "p.before")


def _pieces_with_offsets(df: DataFrame, pieces: Column, keys: list[str]) -> DataFrame:
    rows = df.select(*keys, pieces.alias("_pieces"))
    return _with_offsets(rows, keys, "_pieces", F.transform("_pieces", lambda x: F.length(x)))


def line_fragments(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Each line without surrounding blanks, with its offsets; lines of blanks only are left out."""
    rows = _pieces_with_offsets(df, F.split(text, "\n"), keys)
    txt = F.regexp_replace("piece", f"^{BLANK}+|{BLANK}+$", "")
    lead = F.length("piece") - F.length(F.regexp_replace("piece", f"^{BLANK}+", ""))
    start = F.col("before") + F.col("n") + lead
    return rows.select(*keys, F.col("n").cast("long").alias("line_no"), start.cast("long").alias("start"), txt.alias("txt")).where("txt != ''").withColumn("end", F.col("start") + F.length("txt"))


def _literal(phrase: str, case_sensitive: bool) -> tuple[str, str]:
    """(flag, pattern) of a phrase. Without case, letters of all scripts are folded one to one."""
    return "" if case_sensitive else "(?iu)", re.sub(r"([^\w\s])", r"\\\1", phrase)


def phrase_fragments(df: DataFrame, phrase: str, keys: list[str], text: str = "text", case_sensitive: bool = True) -> DataFrame:
    """Every occurrence of a phrase, overlapping ones too."""
    if not phrase:
        raise ValueError("the phrase is empty")
    flag, literal = _literal(phrase, case_sensitive)
    hits = df.where(F.col(text).rlike(flag + literal))
    # cut before every occurrence; the character put in front keeps one at the beginning apart
    pieces = F.split(F.concat(F.lit("\n"), F.col(text)), f"{flag}(?={literal})")
    rows = _pieces_with_offsets(hits, pieces, keys).where("n > 0")
    start = (F.col("before") - 1).cast("long")
    return rows.select(*keys, start.alias("start"), (start + len(phrase)).alias("end"))


def phrase_counts(df: DataFrame, phrase: str, keys: list[str], text: str = "text") -> DataFrame:
    """How often a phrase occurs without overlaps."""
    n = F.length(text) - F.length(F.replace(F.col(text), F.lit(phrase), F.lit("")))
    return df.select(*keys, (n / len(phrase)).cast("long").alias("n_matches"))


def regex_fragments(df: DataFrame, pattern: str, keys: list[str], text: str = "text", case_sensitive: bool = True, whole_words: bool = False, groups: int = 0) -> DataFrame:
    """Leftmost non-overlapping matches (none of them empty), with offsets and, in group_1 and so on, what so many groups of the pattern have matched (else "")."""
    used = ("" if case_sensitive else "(?iu)") + (rf"\b(?:{pattern})\b" if whole_words else pattern)
    hits = df.where(F.col(text).rlike(used))
    found = [F.regexp_extract_all(text, F.lit(used), F.lit(i)).alias("txt" if i == 0 else f"group_{i}") for i in range(groups + 1)]
    rows = hits.select(*keys, F.arrays_zip(F.split(text, used).alias("gap"), *found).alias("_found"))
    out = _with_offsets(rows, keys, "_found", F.transform("_found", lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["txt"]), F.lit(0))))
    start = (F.col("before") + F.length("piece.gap")).cast("long")
    out = out.where("piece.txt IS NOT NULL").select(*keys, start.alias("start"), (start + F.length("piece.txt")).alias("end"), "piece.txt", *[f"piece.group_{i}" for i in range(1, groups + 1)])
    return out


def regex_counts(df: DataFrame, pattern: str, keys: list[str], text: str = "text") -> DataFrame:
    """How often a pattern matches without overlaps."""
    return df.select(*keys, F.regexp_count(text, F.lit(pattern)).cast("long").alias("n_matches"))


def list_marker(line: Column) -> Column:
    """"ul" for a line that begins with a bullet or dash, alone or before white space; "ol" for a number, letter or small roman numeral closed by . or ); else null."""
    s = F.trim(line)
    # fixed values: the bullets, and the form of an ordered marker
    bullet = r"^[•·◦‣▪●■\u2043\u2013—*\x95-](\s|$)"
    ordered = r"^\(?([0-9]{1,3}|[ivxlcdmIVXLCDM]{1,5}|[A-Za-z])[.)](\s|$)"
    return F.when(s.rlike(bullet), "ul").when(s.rlike(ordered), "ol")


def _replaced(text: str, search: str, replacement: str, case_sensitive: bool, take: Column | None = None) -> Column:
    """Text with its first take occurrences (all, if none is given) replaced; the others stay as they are written."""
    if case_sensitive and take is None:
        return F.replace(F.col(text), F.lit(search), F.lit(replacement))
    flag, literal = _literal(search, case_sensitive)
    pieces = F.split(text, flag + literal)
    found = F.regexp_extract_all(text, F.lit(flag + literal), F.lit(0))
    new = (lambda m, i: F.lit(replacement)) if take is None else (lambda m, i: F.when(i < take, F.lit(replacement)).otherwise(m))
    parts = F.transform(found, lambda m, i: F.concat(new(m, i), F.get(pieces, i + 1)))
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(parts, ""))


def _occurrences(text: str, search: str, case_sensitive: bool) -> Column:
    if case_sensitive:
        return ((F.length(text) - F.length(F.replace(F.col(text), F.lit(search), F.lit("")))) / len(search)).cast("long")
    return F.regexp_count(text, F.lit("".join(_literal(search, False)))).cast("long")


def replace_text(df: DataFrame, search: str, replacement: str, text: str = "text", case_sensitive: bool = True) -> DataFrame:
    """Replace all occurrences in text, leftmost first and without overlaps; adds n_replaced."""
    if not search:
        raise ValueError("the search text is empty")
    return df.withColumns({"n_replaced": _occurrences(text, search, case_sensitive), text: _replaced(text, search, replacement, case_sensitive)})


def redact_text(df: DataFrame, search: str, text: str = "text", case_sensitive: bool = True, max_count: int = 0, document: list[str] | None = None, page: str = "page_index") -> DataFrame:
    """Take occurrences out of text: all, or at most max_count in each document, in page order; adds n_replaced."""
    if max_count:
        return replace_with_quota(df, search, "", max_count, document or [], page, text, case_sensitive)
    return replace_text(df, search, "", text, case_sensitive)


def replace_with_quota(df: DataFrame, search: str, replacement: str, max_count: int, document: list[str], page: str, text: str = "text", case_sensitive: bool = True) -> DataFrame:
    """Replace at most max_count occurrences in each document, in page order (0: no limit)."""
    if not search or max_count < 0:
        raise ValueError("empty search or negative count")
    if max_count == 0:
        return replace_text(df, search, replacement, text, case_sensitive)
    if not document:
        raise ValueError("a quota needs the columns that tell documents apart")
    n = _occurrences(text, search, case_sensitive)
    before = Window.partitionBy(*document).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.lit(max_count) - F.coalesce(F.sum(n).over(before), F.lit(0)))
    rows = df.withColumn("_take", F.least(n, left).cast("int"))
    done = _replaced(text, search, replacement, case_sensitive, F.col("_take"))
    changed = F.when(F.col("_take") == 0, F.col(text)).otherwise(done)
    return rows.withColumn(text, changed).withColumn("n_replaced", F.col("_take").cast("long")).drop("_take")


def text_of_documents(df: DataFrame, document: list[str], page: str, text: str = "text", between: str = "\n") -> DataFrame:
    """The texts of a document's pages in order, joined. A page without text (null) counts in n_pages and adds nothing, no separator either."""
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return df.groupBy(*document).agg(F.array_join(ordered[text], between).alias("text"), F.count("*").alias("n_pages"))
