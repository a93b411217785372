"""Cleaning of imported values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuedir.functions.text import trim_space

_DOUBLE = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_INTEGER = r"^\s*([+-]?\d+)"
_NUMBER_KIND = r"^(BIGINT|DOUBLE|DECIMAL)"


def null_sentinel(col: Column) -> Column:
    """``''`` and ``'-'`` mean "no value"."""
    return F.when(col.isin("", "-"), F.lit(None)).otherwise(col)


def lenient_double(col: Column) -> Column:
    """Leading number of a text (``'12.5%'`` is 12.5), NULL when there is none."""
    return F.regexp_extract(col, _DOUBLE, 1).try_cast("double")


def lenient_int(col: Column) -> Column:
    """Leading whole number of a text, NULL when there is none or outside the int range."""
    return F.regexp_extract(col, _INTEGER, 1).try_cast("int")


def _by_json_type(col: Column, number: Callable[[Column], Column], text: Callable[[Column], Column]) -> Column:
    """``number`` of a JSON number as a double, ``text`` of a JSON string, NULL for anything else; ``col`` is a VARIANT."""
    kind = F.schema_of_variant(col)
    return F.when(kind == "STRING", text(F.try_variant_get(col, "$", "string"))).when(
        kind.rlike(_NUMBER_KIND), number(F.try_variant_get(col, "$", "double")))


def json_double(col: Column) -> Column:
    """A JSON number as it is, a JSON string as :func:`lenient_double` reads it."""
    return _by_json_type(col, lambda x: x, lenient_double)


def json_int(col: Column) -> Column:
    """A JSON number cut towards zero (``1e7`` is 10,000,000), a JSON string as :func:`lenient_int` reads it (``"1e7"`` is 1)."""
    return _by_json_type(col, truncated_int, lenient_int)


def truncated_int(col: Column) -> Column:
    """A numeric column cut towards zero; NULL outside the int range."""
    return F.when(col < 0, F.ceil(col)).otherwise(F.floor(col)).try_cast("int")


def canonical_json(col: Column) -> Column:
    """Compact JSON text with sorted object keys; bad JSON, ``null`` and ``""`` become NULL."""
    text = F.to_json(F.try_parse_json(col))
    return F.when(text.isin("null", '""'), F.lit(None)).otherwise(text)


def split_items(col: Column) -> Column:
    """Comma list to an array of trimmed, non-empty items; NULL when none remain."""
    items = F.filter(F.transform(F.split(col, ","), trim_space), lambda item: item != "")
    return F.when(F.size(items) > 0, items)


def parse_items(text: str | None) -> list[str]:
    """:func:`split_items` for one request parameter; an empty list means "no filter"."""
    return [item.strip() for item in (text or "").split(",") if item.strip()]


def fixed_decimals(col: Column, digits: int = 2) -> Column:
    """Number with a fixed count of decimals, ``'-'`` for NULL (and for 0 without decimals).

    The exact binary value is rounded, ties away from zero, as browsers do: 1.005
    shows as 1.00. ``format_string`` rounds the shortest decimal form instead
    (1.01), so the product ``x * 10^d`` is taken with its exact rounding error. Good
    while ``x * 10^d`` stays below 2^52.
    """
    scale = float(10**digits)
    x = F.abs(col.cast("double"))
    product = x * scale
    # Dekker split of x into two halves whose products with `scale` are exact.
    c = x * 134217729.0
    high = c - (c - x)
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product)
    tie = whole + F.lit(0.5)
    up = (product > tie) | ((product == tie) & (error >= 0))
    n = whole + up.cast("long")
    sign = F.when(col < 0, "-").otherwise("")
    unit = 10**digits
    # `div` is whole-number division, so no digit passes through a double again.
    body = F.call_function("div", n, F.lit(unit)).cast("string")
    if digits:
        decimals = F.lpad((n % unit).cast("string"), digits, "0")
        body = F.concat(body, F.lit("."), decimals)
    hidden = col.isNull() | (F.lit(digits == 0) & (col == 0))
    return F.when(hidden, "-").otherwise(F.concat(sign, body))


def text_length_between(col: Column, low: int, high: int) -> Column:
    """Character count inside ``[low, high]``; NULL fails."""
    return F.coalesce(F.char_length(col).between(low, high), F.lit(False))


def valid_entry_id(col: Column) -> Column:
    return F.coalesce(col >= 1, F.lit(False))


def valid_tag_name(col: Column) -> Column:
    return text_length_between(col, 1, 20)


def valid_username(col: Column) -> Column:
    return text_length_between(col, 3, 32)


def percentage_value(col: Column) -> Column:
    """``'12.5%'`` as 12.5."""
    return lenient_double(col).cast(T.DoubleType())
