"""Predicates of the list query, and the quality predicates of pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuedir.functions.tags import has_tag
from venuedir.functions.text import contains_folded
from venuedir.functions.zones import is_top_venue, zone_text
from venuedir.operators.owners import Owner, rows_of

# Zone systems and where each keeps its zone. All nested fields are typed at
# ingest, so the test is a pushed-down IN list and not a search in JSON text.
ZONE_SYSTEMS = {
    "cas2025": "cas2025.bigZone",
    "cas2023": "cas2023.bigZone",
    "xinrui": "xinrui.bigZone",
    "wos_zone": "wos_zone",
}

KEYWORD_COLUMNS = ("ccf_abbr", "ccf_full", "ccf_publisher")

# Phrases of a page served instead of content.
BLOCKED_PHRASES = ["速度过快", "过于频繁"]
MIN_PAGE_CHARS = 1000


def of_type(kind: str) -> Column:
    return F.col("type") == kind


def in_domains(domains: Sequence[str]) -> Column:
    return F.col("ccf_domain").isin(list(domains))


def in_levels(levels: Sequence[str]) -> Column:
    return F.col("ccf_level").isin(list(levels))


def in_zones(zones: Sequence[str], system: str = "cas2025") -> Column:
    """Zone filter on any zone system; accepts ``"1"`` and ``"1区"``."""
    if system not in ZONE_SYSTEMS:
        raise ValueError(f"unknown zone system {system!r}")
    return F.col(ZONE_SYSTEMS[system]).isin([zone_text(z) for z in zones])


def matches_keyword(text: str, columns: Sequence[str] = KEYWORD_COLUMNS) -> Column:
    """Literal, ASCII-case-blind substring of abbreviation, full name or publisher.

    Non-ASCII letters compare exactly. Such a search scans three columns and shuffles nothing;
    ``keyword_index`` answers it from trigrams.
    """
    return reduce(lambda a, b: a | b, (contains_folded(F.col(c), text) for c in columns))


def is_top() -> Column:
    return is_top_venue(F.col("cas2025"), F.col("xinrui"))


def all_of(predicates: Sequence[Column]) -> Column:
    """Conjunction of whichever filters are set."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def favorites_of(favorites: DataFrame, owner: Owner, tag: str = "") -> DataFrame:
    """Entry ids of an owner's favourites, optionally only those carrying a tag."""
    own = rows_of(favorites, owner)
    if tag:
        own = own.where(has_tag(F.col("tags"), tag))
    return own.select("entry_id")


def keep_favorites(entries: DataFrame, favorites: DataFrame, owner: Owner, tag: str = "") -> DataFrame:
    """Semi join against the owner's favourites. Not hinted: an owner may hold very many rows."""
    own = favorites_of(favorites, owner, tag)
    return entries.join(own, entries["id"] == own["entry_id"], "left_semi")


def by_id(entries: DataFrame, entry_id: int) -> DataFrame:
    """Point lookup; an empty result means "not found"."""
    return entries.where(F.col("id") == entry_id)


def by_ids(entries: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """Batched point lookup."""
    wanted = ids.select(F.col(id_column).alias("_wanted")).distinct()
    return entries.join(wanted, entries["id"] == wanted["_wanted"], "left_semi")


def is_blocked_page(html: Column) -> Column:
    return reduce(lambda a, b: a | b, (html.contains(phrase) for phrase in BLOCKED_PHRASES))


def is_unusable_page(html: Column, min_chars: int = MIN_PAGE_CHARS) -> Column:
    """Blocked or too short. Lengths are code points."""
    return is_blocked_page(html) | (F.length(html) < min_chars)
