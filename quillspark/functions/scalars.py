"""Scalar functions as column expressions: text, numbers, dates, geometry, colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape_literal(c: Column) -> Column:
    """Backslashes and parentheses with a backslash in front; line feed, return, tab, backspace and form feed as escapes."""
    c = F.regexp_replace(c, r"([\\()])", r"\\$1")
    for char, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(char), F.lit(escaped))
    return c


def _latin_1(c: Column) -> Column:
    """Bytes as text, each byte one character."""
    return F.decode(c, "ISO-8859-1")


def literal_operand(raw: Column) -> Column:
    """Bytes as a literal string in parentheses: as escape_literal, and all other bytes but 0x20 to 0x7E as three octal digits."""
    plain = escape_literal(_latin_1(raw))
    # what is left outside of printable ASCII, each kind once: split keeps few pieces where bytes are mostly text
    odd = F.regexp_extract_all(plain, F.lit(r"[^\x20-\x7E]"), F.lit(0))
    pieces = F.split(plain, r"[^\x20-\x7E]")
    octal = F.transform(odd, lambda x, i: F.concat(F.lit("\\"), F.lpad(F.conv(F.ascii(x).cast("string"), 10, 8), 3, "0"), F.get(pieces, i + 1)))
    return F.concat(F.lit("("), F.get(pieces, F.lit(0)), F.array_join(octal, ""), F.lit(")"))


def decode_operand(raw: Column) -> Column:
    """Bytes as text: UTF-16BE after the mark FE FF, else each byte one character."""
    rest = F.substring(raw, 3, 1 << 30)
    return F.when(F.hex(F.substring(raw, 1, 2)) == "FEFF", F.decode(rest, "UTF-16BE")).otherwise(_latin_1(raw))


def encode_operand(text: Column, utf16: Column) -> Column:
    """Text as bytes: after the mark FE FF as UTF-16BE where utf16 holds, else one byte a character; null if a character is above U+00FF then."""
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    return F.when(utf16, wide).when(~text.rlike(r"[^\x00-\xFF]"), F.encode(text, "ISO-8859-1"))


def hex_literal(raw: Column) -> Column:
    """Bytes as a hexadecimal string in angle brackets."""
    return F.concat(F.lit("<"), F.hex(raw), F.lit(">"))


def default_appearance(c: Column) -> Column:
    """A struct (font, size, colour) of an appearance text like "/Helv 12 Tf 0 g": the operands of the last Tf and of the last g, rg or k; 0 and "0 g" where there are none.

    An operator takes the operands since the operator before it; stroke and colour-space operators take theirs away.
    """
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    start = F.struct(F.array().cast("array<string>").alias("operands"), F.lit(None).cast("string").alias("font"), F.lit(0.0).alias("size"), F.lit("0 g").alias("colour"))

    def step(acc: Column, t: Column) -> Column:
        ops = acc["operands"]
        n = F.size(ops)
        name, size = F.get(ops, n - 2), F.get(ops, n - 1)
        is_font = (t == "Tf") & (n >= 2)
        font = F.when(is_font & name.startswith("/"), F.substring(name, 2, 1 << 30)).otherwise(acc["font"])
        new_size = F.when(is_font & size.rlike(number), size.try_cast("double")).otherwise(acc["size"])
        need = F.when(t == "g", 1).when(t == "rg", 3).when(t == "k", 4)
        last = F.slice(ops, F.greatest(n - need + 1, F.lit(1)), need)
        fine = need.isNotNull() & (n >= need) & F.forall(last, lambda x: x.rlike(number))
        colour = F.when(fine, F.concat(F.array_join(last, " "), F.lit(" "), t)).otherwise(acc["colour"])
        ends = t.isin("Tf", "g", "rg", "k", "G", "RG", "K", "cs", "CS", "sc", "scn")
        return F.struct(F.when(ends, F.array().cast("array<string>")).otherwise(F.concat(ops, F.array(t))).alias("operands"), font.alias("font"), F.coalesce(new_size, F.lit(0.0)).alias("size"), F.coalesce(colour, acc["colour"]).alias("colour"))

    tokens = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")
    return F.aggregate(tokens, start, step, lambda acc: F.struct(acc["font"].alias("font"), acc["size"].alias("size"), acc["colour"].alias("colour")))


def without_subset_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^[A-Z]{6}\+", "")


def to_octal(c: Column) -> Column:
    """Decimal to octal; null for negative numbers."""
    return F.when(c >= 0, F.conv(c.cast("string"), 10, 8))


def from_octal(c: Column) -> Column:
    """Octal to decimal; null for anything but octal digits."""
    return F.when(c.rlike("^[0-7]+$"), F.conv(c, 8, 10).cast("long"))


def iso_to_tagged_date(ts: Column) -> Column:
    """A timestamp as D:YYYYMMDDHHmmSSZ."""
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("Z"))


def tagged_date_to_iso(c: Column) -> Column:
    """[D:]YYYY[MM[DD[HH[mm[SS]]]]] with an optional Z or offset after a time, to ISO; else an empty string.

    A missing month or day is 01, missing minutes and seconds are 00. Of an offset the first two pairs of digits count, however they are parted; what isn't an offset is left out.
    """
    form = r"(?s)^(?:[Dd]:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(.*)$"
    c = F.trim(c)
    part = [F.regexp_extract(c, form, i) for i in range(8)]
    or_ = lambda x, default: F.when(x == "", default).otherwise(x)
    day = F.concat_ws("-", part[1], or_(part[2], "01"), or_(part[3], "01"))
    time = F.concat_ws(":", part[4], or_(part[5], "00"), or_(part[6], "00"))
    rest = F.trim(part[7])
    pairs = F.regexp_extract_all(rest, F.lit(r"\d{2}"), F.lit(0))
    offset = F.concat(F.substring(rest, 1, 1), F.get(pairs, F.lit(0)), F.lit(":"), F.coalesce(F.get(pairs, F.lit(1)), F.lit("00")))
    zone = F.when(rest.rlike("^[Zz]"), "Z").when(rest.rlike("^[+-]") & (F.size(pairs) > 0), offset).otherwise("")
    return F.when(part[0] == "", "").when(part[4] == "", day).otherwise(F.concat(day, F.lit("T"), time, zone))


def iso_text_to_tagged(c: Column) -> Column:
    """ISO text YYYY[-MM[-DD]][Thh:mm[:ss]][Z or offset] to D:YYYYMMDD[HHmmSS[Z or +HH'mm']]; else an empty string. What follows is left out."""
    form = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?([Zz]|[+-]\d{2}:?\d{2})?"
    c = F.trim(c)
    part = [F.regexp_extract(c, form, i) for i in range(8)]
    or_ = lambda x, default: F.when(x == "", default).otherwise(x)
    day = F.concat(F.lit("D:"), part[1], or_(part[2], "01"), or_(part[3], "01"))
    digits = F.replace(part[7], F.lit(":"), F.lit(""))
    zone = F.when(part[7] == "", "").when(F.upper(part[7]) == "Z", "Z").otherwise(F.concat(F.substring(digits, 1, 3), F.lit("'"), F.substring(digits, 4, 2), F.lit("'")))
    return F.when(part[0] == "", "").when(part[4] == "", day).otherwise(F.concat(day, part[4], part[5], or_(part[6], "00"), zone))


def date_of(c: Column) -> Column:
    """A tagged date as a timestamp: offsets are taken off, a missing offset is UTC; null for what is no date."""
    iso = tagged_date_to_iso(c)
    return F.when(iso != "", F.try_to_timestamp(iso))


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def quadratic_roots(a: Column, b: Column, c: Column, eps: float = 1e-12) -> Column:
    """Real roots in ascending order; linear where a is nearly 0, none where b is too."""
    disc = b * b - 4 * a * c
    none = F.array().cast("array<double>")
    linear = F.when(F.abs(b) < eps, none).otherwise(F.array(-c / b))
    two = F.array_sort(F.array((-b - F.sqrt(disc)) / (2 * a), (-b + F.sqrt(disc)) / (2 * a)))
    return F.when(F.abs(a) < eps, linear).when(disc < 0, none).otherwise(two)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [F.floor((255 - x) * (255 - k) / 255).cast("int") for x in (c, m, y)]


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def flags(c: Column, names: dict[str, int]) -> dict[str, Column]:
    """Named bits (from 0) of a whole number."""
    return {n: F.shiftright(c, bit).bitwiseAND(F.lit(1)) == 1 for n, bit in names.items()}


def localized(items: str, language: str) -> Column:
    """From an array of (lang, value): the first without language or in the wanted one, else the first."""
    fits = F.filter(items, lambda x: x["lang"].isNull() | x["lang"].isin("", language))
    return F.coalesce(F.get(fits, F.lit(0))["value"], F.get(F.col(items), F.lit(0))["value"])


def fit_within(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Whole dimensions scaled down to a cap, at least 1; a cap of 0 or less does nothing."""
    if most <= 0:
        return width, height
    larger = F.greatest(width, height)
    scale = lambda x: F.when(larger <= most, x).otherwise(F.greatest(F.lit(1), F.floor(x * most / larger)))
    return scale(width), scale(height)


def rotation(degrees: Column) -> Column:
    """A page rotation as 0, 90, 180 or 270; null for anything that isn't a multiple of 90."""
    turned = F.pmod(degrees, F.lit(360))
    return F.when(F.pmod(turned, F.lit(90)) == 0, turned.cast("int"))


def corner_box(x: Column, y: Column, w: Column, h: Column, m: tuple[float, float, float, float, float, float]) -> list[Column]:
    """Bounding box (x0, y0, x1, y1) of a rectangle's corners after an affine transform."""
    corners = [affine(x + dx, y + dy, m) for dx in (F.lit(0.0), w) for dy in (F.lit(0.0), h)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def cubic_bounds(p0: Column, p1: Column, p2: Column, p3: Column) -> tuple[Column, Column]:
    """Smallest and largest value of a cubic Bezier coordinate: its ends and where its derivative is zero within (0, 1)."""
    a, b, c = p3 - 3 * p2 + 3 * p1 - p0, 2 * (p2 - 2 * p1 + p0), p1 - p0
    inner = F.filter(quadratic_roots(a, b, c), lambda t: (t > 0) & (t < 1))
    values = F.transform(inner, lambda t: (1 - t) * (1 - t) * (1 - t) * p0 + 3 * (1 - t) * (1 - t) * t * p1 + 3 * (1 - t) * t * t * p2 + t * t * t * p3)
    every = F.concat(F.array(p0, p3), values)
    return F.array_min(every), F.array_max(every)


def typed(c: Column) -> dict[str, Column]:
    """A property's text as a whole number, a real number and a truth value; null where it isn't one."""
    low = F.lower(F.trim(c))
    return {
        "as_int": F.when(F.trim(c).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(c)).cast("long"),
        "as_real": F.when(F.trim(c).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), F.trim(c)).cast("double"),
        "as_bool": F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False),
    }


def normalized_rgb(r: Column, g: Column, b: Column) -> list[Column]:
    """Channels in 0..1: all divided by 255 if any is above 1; null if any is negative or still above 1."""
    most = F.greatest(r, g, b)
    bad = (F.least(r, g, b) < 0) | (most > 255)
    return [F.when(~bad, F.when(most > 1, x / 255).otherwise(x.cast("double"))) for x in (r, g, b)]


def samples_of(byte: Column, bits: int) -> Column:
    """The samples of 1, 2, 4 or 8 bits in a byte, highest first."""
    if bits not in (1, 2, 4, 8):
        raise ValueError("1, 2, 4 or 8 bits")
    return F.array(*[F.shiftright(byte, 8 - bits * (i + 1)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(8 // bits)])


def algorithm_name(c: Column, aliases: dict[str, str]) -> Column:
    """A name without case and separators, looked up among aliases; else as normalised."""
    plain = F.upper(F.regexp_replace(c, "[-_ /.]", ""))
    out = plain
    for alias, name in aliases.items():
        out = F.when(plain == alias.upper(), name).otherwise(out)
    return out


def matrix_product(m: list[Column], n: list[Column]) -> list[Column]:
    """The six numbers of the affine map that does m first and then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """The same rectangle with its lower left corner first."""
    return [F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)]


def crop(box: list[Column], to: list[Column]) -> list[Column]:
    """The part of a rectangle inside another; nulls if there is none."""
    x0, y0, x1, y1 = F.greatest(box[0], to[0]), F.greatest(box[1], to[1]), F.least(box[2], to[2]), F.least(box[3], to[3])
    return [F.when((x0 <= x1) & (y0 <= y1), v) for v in (x0, y0, x1, y1)]


def gray_to_rgb(g: Column) -> list[Column]:
    return [g, g, g]


def indexed_to_rgb(index: Column, palette: list[tuple[int, int, int]]) -> list[Column]:
    """Colours of a small palette (at most 256, as literals); black beyond its end."""
    if len(palette) > 256:
        raise ValueError("a palette has at most 256 colours")
    return [F.coalesce(F.get(F.array(*[F.lit(colour[i]) for colour in palette]), index), F.lit(0)) for i in range(3)]


def format_number(x: Column) -> Column:
    """A number with at most six decimals and no zeros behind them; null for what isn't finite."""
    near = F.when(F.abs(x) < 0.0000005, F.lit(0.0)).otherwise(x)
    text = F.regexp_replace(F.format_string("%.6f", near), r"\.?0+$", "")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), text)


def safe_name(c: Column, prefix: str) -> Column:
    """A name without leading slashes, with the prefix if it needs one, or null if it isn't safe even then."""
    bare, safe = F.regexp_replace(c, "^/+", ""), "^[A-Za-z_][A-Za-z0-9_]*$"
    return F.when(c == "", None).when(bare.rlike(safe), bare).when(F.concat(F.lit(prefix), bare).rlike(safe), F.concat(F.lit(prefix), bare))


def hex_operand(c: Column) -> Column:
    """The bytes of <...>: white space is skipped, an odd last digit counts as followed by 0; no bytes if other characters occur."""
    digits = F.regexp_replace(F.regexp_replace(c, "^<|>.*$", ""), r"[\x00\t\n\f\r ]", "")
    even = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(even.rlike("^[0-9A-Fa-f]*$"), F.unhex(even)).otherwise(F.lit(b""))


def image_kind(data: Column) -> Column:
    """File extension by the first bytes of an encoded image; null for anything else."""
    head = F.hex(F.substring(data, 1, 8))
    # fixed values: what the formats' files begin with
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8"), "jpg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("424D"), "bmp")
        .when(head.startswith("FF4FFF51") | (F.substring(head, 9, 8) == "6A502020"), "jp2")
    )


def known_algorithm(c: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """As algorithm_name; an unknown name is an error in the row's place: null."""
    name = algorithm_name(c, aliases)
    return F.when(name.isin(*known), name)
