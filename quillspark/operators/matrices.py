"""Products of chains of affine matrices (a, b, c, d, e, f), exact in decimals."""

from __future__ import annotations

from decimal import Context, Decimal

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType

from quillspark.operators.scan import ordered_scan

#: Digits that products keep; sums and products of fewer digits are exact.
DIGITS = 80
_context = Context(prec=DIGITS)


def _times(m: tuple, n: tuple) -> tuple:
    """m after n, rounded to DIGITS digits only."""
    add, mul = _context.add, _context.multiply

    def dot(*pairs: tuple) -> Decimal:
        total = mul(*pairs[0])
        for p in pairs[1:]:
            total = add(total, mul(*p))
        return total

    one = Decimal(1)
    return (
        dot((m[0], n[0]), (m[2], n[1])), dot((m[1], n[0]), (m[3], n[1])), dot((m[0], n[2]), (m[2], n[3])), dot((m[1], n[2]), (m[3], n[3])),
        dot((m[0], n[4]), (m[2], n[5]), (m[4], one)), dot((m[1], n[4]), (m[3], n[5]), (m[5], one)),
    )


def chain_products(df: DataFrame, group: list[str], order: list, matrix: list[str]) -> DataFrame:
    """df with product, the product of the matrices of a group from its first row to this one in order, as six decimals in text (no exponent, no trailing zeros).

    matrix names the six columns: whole numbers, decimals, doubles (taken as they print) or text. A matrix with a null makes its product, and those after it, null.
    Rows that share an order key multiply in any order, so the order should end with a row's id.
    """

    def entry(x: object) -> Decimal:
        return Decimal(repr(x)) if isinstance(x, float) else Decimal(str(x))

    def text(m: tuple | None) -> list | None:
        return None if m is None else [format(x.normalize(_context), "f") if x else "0" for x in m]

    def begin(row: tuple) -> tuple:
        m = None if None in row else tuple(map(entry, row))
        return m, text(m)

    def step(state: tuple | None, row: tuple) -> tuple:
        m = None if state is None or None in row else _times(state, tuple(map(entry, row)))
        return m, text(m)

    return ordered_scan(df, group, order, matrix, begin, step, "product", ArrayType(StringType()))
