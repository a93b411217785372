"""Tag arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from venuedir import schema
from venuedir.functions.text import fold_ascii, fold_ascii_text


def decode_tags(json_text: Column) -> Column:
    """JSON array text to an array; NULL for ``null`` and unreadable text."""
    return F.from_json(json_text, schema.TAGS)


def no_tags() -> Column:
    return F.array().cast(schema.TAGS)


def has_tag(tags: Column, name: str) -> Column:
    """Exact element, blind to ASCII case (the wildcard test of a tag search, as intended)."""
    wanted = fold_ascii_text(name)
    return F.coalesce(F.exists(tags, lambda tag: fold_ascii(tag) == wanted), F.lit(False))


def without_tag(tags: Column, name: Column | str) -> Column:
    """The array without one value, order kept."""
    value = F.lit(name) if isinstance(name, str) else name
    return F.filter(tags, lambda tag: tag != value)


def toggled_tag(tags: Column, name: Column | str) -> Column:
    """Remove the value when present, else append it."""
    value = F.lit(name) if isinstance(name, str) else name
    return F.when(F.array_contains(tags, value), without_tag(tags, value)).otherwise(
        F.array_append(tags, value)
    )
