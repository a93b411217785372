"""Text helpers: ASCII folding, markup stripping, small pattern extractors."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the whitespace set of the source pages' language runtime. Java's
# \s is ASCII only, so the rest of the set is spelled out.
SPACE_CLASS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACE_CLASS}]"
# The same set; one comparison decides for ASCII, which matters where every character is tested.
_WS_RUN = r"[\s[\u00a0-\ufeff&&[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]+"
NOT_WS = f"[^{SPACE_CLASS}]"

_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def fold_ascii(col: Column) -> Column:
    """Lower-case ASCII letters only; other letters keep their case."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def fold_ascii_text(text: str) -> str:
    """:func:`fold_ascii` for a plain Python string."""
    return text.translate(_FOLD)


def contains_folded(col: Column, needle: str) -> Column:
    """Literal substring test, blind to ASCII case; ``%``, ``_``, ``\\`` are plain characters."""
    return fold_ascii(col).contains(fold_ascii_text(needle))


def trim_space(col: Column) -> Column:
    """Trim every whitespace character, not only the blank that ``trim`` removes."""
    return F.regexp_replace(col, rf"\A{WS}+|{WS}+\z", "")


def strip_markup(col: Column) -> Column:
    """Tags to blanks, two entities decoded, whitespace collapsed and trimmed.

    One pass: a run of tags, blanks and ``&nbsp;`` is one blank. The possessive loop needs no stack.
    """
    text = F.regexp_replace(col, rf"(?:<[^>]+>|{_WS_RUN}|&nbsp;)++", " ")
    return F.trim(F.replace(text, F.lit("&amp;"), F.lit("&")))


def first_number(col: Column) -> Column:
    """First run of digits and dots, ``''`` when there is none."""
    return F.regexp_extract(col, r"[\d.]+", 0)


def first_percentage(col: Column) -> Column:
    """First run of digits and dots followed by ``%``, ``''`` when there is none."""
    return F.regexp_extract(col, r"[\d.]+%", 0)


def first_token(col: Column) -> Column:
    """Text before the first whitespace character."""
    return F.regexp_extract(col, rf"\A{NOT_WS}*", 0)


def remove_first(col: Column, pattern: str) -> Column:
    """Remove the first match of ``pattern``; later matches stay."""
    return F.regexp_replace(col, rf"(?s)\A(.*?)(?:{pattern})", "$1")


def drop_label(col: Column, label: str) -> Column:
    """Remove the first ``label`` with its optional colon and blanks, then trim."""
    return trim_space(remove_first(col, rf"{label}[：:]?{WS}*"))


def normalize_name(col: Column) -> Column:
    """Upper case, keep only ``A-Z`` and ``0-9``. All-CJK names become ``''``."""
    return F.regexp_replace(F.upper(col), "[^A-Z0-9]", "")
